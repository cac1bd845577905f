import numpy as np

from crossgrain.llm import mixing as M


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 10_000, (3, 4, 2)).astype(float)
    marginals = [rng.dirichlet(np.ones(n)) for n in tokens.shape]
    fit = M.rake(tokens, marginals)
    for axis, m in enumerate(marginals):
        assert np.allclose(fit.sum(axis=tuple(k for k in range(3) if k != axis)), m, atol=1e-8)
    # the fit keeps the table's odds ratios
    odds = lambda t: t[0, 0, 0] * t[1, 1, 0] / (t[0, 1, 0] * t[1, 0, 0])
    assert np.isclose(odds(fit), odds(tokens))
    p = M.probabilities(tokens, fit, 0.2)
    assert np.isclose((p * tokens).sum(), 0.2 * tokens.sum())
    assert M.probabilities(tokens, fit, 1.0).max() <= 1


def test_absent_strata_share_out_their_targets():
    fit = M.rake(np.array([[5.0, 0.0], [3.0, 0.0]]), [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    assert np.allclose(fit.sum(axis=0), [1, 0]) and np.allclose(fit.sum(axis=1), 0.5)


def brute(rows, targets):
    cells = {}
    for _, text, lang, source in rows:
        n = len((text or "").encode().split())
        t = text or ""
        topic = "note" if n < 20 else "table" if 10 * t.count("|") > n else "noise" if 2 * sum(t.count(c) for c in "#*$%&<>!") > n else "prose"
        key = (source if source in targets.source else "other", lang if lang in targets.lang else "other", topic if topic in targets.topic else "other")
        cells[key] = cells.get(key, 0) + n
    return cells


def test_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "word " * int(rng.integers(0, 300)), ["en", "de", "xx", None][k % 4], ["src0", "src1", None][k % 3]) for k in range(600)]
    rows += [(None, "a | b " * 40, "en", "src0"), (7, None, "fr", "src0"), (7, "", "fr", "src0"), (8, "### " * 50, "es", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS topic2", "2 AS u", "3 AS n_tokens", "4 AS weight")
    targets = M.Targets()
    got = M.calibrated(docs, targets).collect()
    assert len(got) == len(rows)
    cells = brute(rows, targets)
    have = {}
    for r in got:
        have[r["source_stratum"], r["lang_stratum"], r["topic"]] = have.get((r["source_stratum"], r["lang_stratum"], r["topic"]), 0) + r["n_tokens"]
        assert 0 <= r["probability"] <= 1
    assert have == cells
    expected = sum(r["probability"] * r["n_tokens"] for r in got)
    total = sum(r["n_tokens"] for r in got)
    assert expected <= targets.budget * total * 1.000001
    kept = M.sample(docs, targets)
    assert kept.columns == docs.columns
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1)
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in got if r["sampled"])
    empty = docs.limit(0)
    assert M.calibrated(empty).count() == 0 and M.sample(empty).count() == 0


def test_bounds_do_not_bend_targets_that_can_be_met():
    """One cell is short: its budget goes where the marginals still hold, not to all cells alike."""
    tokens = np.array([[100.0, 900.0], [3000.0, 6000.0]])
    marginals = [np.array([0.12, 0.88]), np.array([0.5, 0.5])]
    plain = M.probabilities(tokens, M.rake(tokens, marginals), 0.6) * tokens
    assert np.abs(plain.sum(axis=1) / plain.sum() - marginals[0]).max() > 0.001  # what clipping alone gives
    kept = M.bounded(tokens, marginals, 0.6)
    assert (kept <= tokens).all() and np.isclose(kept.sum(), 6000)
    for axis in (0, 1):
        assert np.allclose(kept.sum(axis=1 - axis) / 6000, marginals[axis], atol=1e-6)


def test_a_short_stratum_is_kept_whole_and_reported(spark):
    rows = [(k, "word " * 100, "en", "src0" if k < 20 else "src1") for k in range(400)]  # 5 % of the tokens; 15 % of 60 % wanted
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(a, k): x for a, k, *x in M.report(docs)}
    assert np.allclose(got["source_stratum", "src0"], [0.15, 0.05, 0.05 / 0.6])
    assert np.allclose(got["source_stratum", "other"], [0.85, 0.95, 0.55 / 0.6])
