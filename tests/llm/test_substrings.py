import hashlib

import numpy as np
import pandas as pd
import pytest

from crossgrain.llm import substrings as S


def brute(rows):
    """rows: (order, text); what is covered, by looking at every window in order."""
    seen, out = set(), []
    for _, t in rows:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - S.LENGTH + 1):
            w = t[i : i + S.LENGTH]
            if w in seen:
                cover[i : i + S.LENGTH] = True
            seen.add(w)
        out.append(cover)
    return out


def made(seed):
    rng = np.random.default_rng(seed)
    word = lambda n, a=6: bytes(rng.integers(97, 97 + a, n).astype(np.uint8))
    shared = [word(150), word(100), word(400), word(99), "é€ü".encode() * 30]
    texts = []
    for k in range(40):
        parts = [word(int(rng.integers(0, 250)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(len(shared)))], word(int(rng.integers(0, 60)))]
        texts.append(b"".join(parts))
    texts += [b"a" * 350, b"a" * 100 + b"b", b"ab" * 200, word(37) * 12, word(81) * 5, word(90) * 4, word(99) * 3, b"", b"short", texts[3], texts[3], b"\0" * 120, b"x" + b"\0" * 130]
    return texts


def covering(texts):
    """Covered bytes by runs and chunks, without Spark. texts in order of precedence."""
    rows = []
    for who, key, start, n, at in S.runs(texts):
        for i, k, s, c, p in zip(who.tolist(), key.tolist(), start.tolist(), n.tolist(), at.tolist(), strict=True):
            rows.append((k, i, 0, s, c, p, texts[i][s : s + c + S.LENGTH - 1]))
    x = pd.DataFrame(rows, columns=["key", "ord", "tag", "start", "n", "at", "part"]).sort_values(["key", "ord", "start"], ignore_index=True)
    out = [np.zeros(len(t), bool) for t in texts]
    for got in S.sort_chunks(x.iloc[k : k + 50] for k in range(0, len(x), 50)):
        for i, a, b in zip(got["ord"], got["a"], got["b"], strict=True):
            out[i][a:b] = True
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chunks_against_brute_force(monkeypatch, seed):
    monkeypatch.setattr(S, "SEGMENT", 300)
    monkeypatch.setattr(S, "CHUNK", [2000, 1 << 20][seed % 2])
    texts = made(seed)
    texts = [texts[i] for i in np.random.default_rng(seed).permutation(len(texts))]
    for got, want in zip(covering(texts), brute(list(enumerate(texts))), strict=True):
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("residues", [(0,), (3, 17), tuple(range(S.PERIOD))])
def test_suffixes_are_sorted(residues):
    r = np.random.default_rng(8)
    text = b"".join([bytes(r.integers(97, 99, 150).astype(np.uint8)), b"abcab" * 60, b"b" * 150]) * 2
    at = np.array([i for i in range(len(text)) if i % S.PERIOD in residues])
    order = S.SuffixSorter(np.frombuffer(text, np.uint8), residues).order(at)
    depth = S.LENGTH + S.PERIOD
    strings = [text[i : i + depth].ljust(depth, b"\0") for i in order.tolist()]
    assert strings == sorted(strings) and sorted(order.tolist()) == at.tolist()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    w = bytes(rng.integers(97, 100, 100).astype(np.uint8))
    texts = [b"zz" + w + b"q", w, b"k" * 50 + w]
    keys = {}
    for who, key, start, n, at in S.runs(texts):
        for i, k, s, c, p in zip(who, key, start, n, at, strict=True):
            for j in range(c):
                keys[int(i), int(s) + j] = int(k), int(p) - j
    assert keys[0, 2] == keys[1, 0] == keys[2, 50]
    assert len(keys) == sum(len(t) - 99 for t in texts)


@pytest.mark.parametrize("seed", range(2))
def test_documents_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(S, "SEGMENT", 400)
    monkeypatch.setattr(S, "CHUNK", 2000)
    rows = [(k * 3 % 101, t.decode()) for k, t in enumerate(made(seed))] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tag", "2 AS ord", "3 AS block", "4 AS key")
    got = {r["doc_id"]: r for r in S.deduplicate(docs.repartition(5)).collect()}
    rows = sorted((k, (t or "").encode()) for k, t in rows)
    for (k, t), cover in zip(rows, brute(rows), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate(([0], cover.astype(int), [0]))) == 1).sum())
        want = (len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == want, k
        assert bytes(got[k]["kept"]) == kept


def test_nulls_repeated_ids_and_empty_tables(spark):
    t = "".join(chr(97 + int(k)) for k in np.random.default_rng(2).integers(0, 26, 300))
    rows = [(None, t), (5, t), (5, t), (4, "q" + t[:150])]
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in got)
    assert removed == [(-1, 300), (4, 0), (5, 150), (5, 150)]
    assert S.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
