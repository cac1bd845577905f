import numpy as np

from crossgrain.llm import attention_lm as A


def made(n=60, seed=0):
    """Texts with a rule: an even id is followed by the next number, an odd one by a random even id."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = []
        for _ in range(int(r.integers(1, 120))):
            a = int(r.integers(0, 20)) * 2
            t += [a, a + 1]
        out.append(np.array(t))
    return out


def counts(texts):
    c = np.bincount(np.concatenate(texts), minlength=A.VOCABULARY)
    c[A.END] += len(texts)
    return c


def pairs(model, texts):
    total = np.zeros(A.CLASSES * A.VOCABULARY, np.int32)
    model.add_pairs(texts, total)
    at = np.flatnonzero(total)
    return at // A.VOCABULARY, at % A.VOCABULARY, total[at].astype(np.int64)


def plain(model, text):
    """log10 chance of a text, position by position, from its windows' definition."""
    ids, targets = [A.START, *text.tolist()], [*text.tolist(), A.END]
    w, total = {k: v.astype(float) for k, v in model.w.items()}, 0.0
    for t, y in enumerate(targets):
        k = t // A.STRIDE
        a = max(0, k * A.STRIDE - A.CONTEXT)
        shift = A.CONTEXT - k * A.STRIDE
        x = np.array([w["e"][model.row[ids[j]]] + w["p"][j + shift] for j in range(a, t + 1)])
        s = x[-1] @ w["q"] @ (x @ w["k"]).T / np.sqrt(A.WIDTH)
        s = np.exp(s - s.max())
        h = x[-1] + (s / s.sum()) @ (x @ w["v"]) @ w["o"]
        f = h + np.maximum(h @ w["a"] + w["ab"], 0) @ w["b"]
        l = f @ w["u"] + w["ub"]
        c = model.cls[y]
        total += (l[c] - l.max() - np.log(np.exp(l - l.max()).sum())) / np.log(10)
        total += model.in_class(model.cls[ids[t]][None], np.array([y]))[0]
    return total


def test_each_token_is_scored_once_with_its_own_context():
    texts = [np.zeros(0, np.int64), *made(6)]
    model = A.Model.of_counts(counts(texts))
    model.set_pairs(*pairs(model, texts[:4]))
    got = model.score(texts)
    assert np.allclose(got, [plain(model, t) for t in texts], rtol=1e-4, atol=1e-3)
    assert len(model.id_chances(texts)) == sum(len(t) + 1 for t in texts)
    model.w["q"] *= 1e4  # scores beyond single precision's range
    assert np.isfinite(model.score(texts)).all()


def test_chances_sum_to_one():
    texts = made(5)
    model = A.Model.of_counts(counts(texts))
    every = np.arange(A.VOCABULARY)
    for known in ([], texts):
        if known:
            model.regroup(counts(texts), *pairs(model, texts))
            model.set_pairs(*pairs(model, texts))
        for before in (0, 3, A.CLASSES - 6):
            chance = 10.0 ** model.in_class(np.full(len(every), before), every)
            assert np.allclose(np.bincount(model.cls, chance, A.CLASSES), 1, atol=1e-4)
    want = {}
    for t in texts:
        for a, b in zip([A.START, *t.tolist()], [*t.tolist(), A.END], strict=True):
            want[int(model.cls[a]), b] = want.get((int(model.cls[a]), b), 0) + 1
    assert want == {(a, b): c for a, b, c in zip(*(x.tolist() for x in pairs(model, texts)), strict=True)}


def test_clusters_follow_what_stands_ahead(monkeypatch):
    monkeypatch.setattr(A, "ALONE", 3)
    monkeypatch.setattr(A, "CLASSES", 5)
    r = np.random.default_rng(8)
    texts = []
    for _ in range(300):  # ids 100 to 119 follow id 1, ids 200 to 219 follow id 2
        for lead, base in ((1, 100), (2, 200)):
            texts.append(np.array([lead, base + int(r.integers(0, 20))] * 3))
    model = A.Model.of_counts(counts(texts))
    model.regroup(counts(texts), *pairs(model, texts))
    assert len(set(model.cls[100:120].tolist())) == len(set(model.cls[200:220].tolist())) == 1
    assert model.cls[100] != model.cls[200]


def test_windows_survive_packing():
    texts = [np.zeros(0, np.int64), *made(3)]
    model = A.Model.of_counts(counts(texts))
    shown = A.windows(texts, model)
    for a, b in zip(shown, A.unpacked_windows(A.packed_windows(shown).ravel()), strict=False):
        assert (a == b).all()


def test_gradients():
    texts = made(4)
    model = A.Model.of_counts(counts(texts))
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = A.windows(texts, model)[:4]
    _, g = model.slopes(*x)
    r = np.random.default_rng(2)
    for name, slope in g.items():
        at = np.unravel_index(np.argmax(np.abs(slope)), slope.shape) if r.random() < 2 else None
        had = model.w[name][at]
        model.w[name][at] = had + 1e-4
        up = model.slopes(*x)[0]
        model.w[name][at] = had - 1e-4
        down = model.slopes(*x)[0]
        model.w[name][at] = had
        assert np.isclose((up - down) / 2e-4, slope[at], rtol=2e-2, atol=1e-5), name


def test_gradients_do_not_depend_on_how_many_windows_are_taken_at_once(monkeypatch):
    """In single precision, as in use; input rows that occur once, often and never."""
    texts = made(12)
    model = A.Model.of_counts(counts(texts))
    x = A.windows(texts, model)[:4]
    whole = {}
    for at_once in (1, 7, len(x[0])):
        monkeypatch.setattr(A, "LEARNT_AT_ONCE", at_once)
        loss, g = model.slopes(*x)
        whole = whole or g | {"loss": loss}
        assert np.isclose(loss, whole["loss"], rtol=1e-5)
        for name, slope in g.items():
            assert slope.dtype == np.float32 and slope.shape == model.w[name].shape
            assert np.allclose(slope, whole[name], rtol=1e-3, atol=1e-6), name
    unused = np.setdiff1d(np.arange(A.INPUTS), x[0])
    assert len(unused) and not whole["e"][unused].any()


def test_it_learns_the_order():
    train, held = made(80, 1), made(20, 2)
    model = A.Model.of_counts(counts(train))
    before = model.score(held).sum()
    model.descend(A.windows(train, model)[:4], 250, 7)
    after = model.score(held).sum()
    tokens = sum(len(t) + 1 for t in held)
    assert (before - after) / tokens < -0.5  # half of the ids become certain: 0.8 digits each


def test_a_pass_learns_from_every_window(monkeypatch):
    texts = made(30)
    model = A.Model.of_counts(counts(texts))
    shown = A.packed_windows(A.windows(texts, model))
    seen, slopes = [], A.Model.slopes
    monkeypatch.setattr(A.Model, "slopes", lambda self, *x: (seen.append(A.packed_windows(x)), slopes(self, *x))[1])
    model.descend(shown, -(-len(shown) // A.BATCH), 3)
    assert len(shown) > A.BATCH
    assert {x.tobytes() for x in shown} == {x.tobytes() for one in seen for x in one}
    assert sum(map(len, seen)) < len(shown) + A.BATCH
