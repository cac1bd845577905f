import random

import numpy as np
from pyspark.sql import functions as F

from crossgrain.llm import simhash
from crossgrain.llm import similar as S
from tests.llm.test_simhash import roots


def jaccard(a, b, size=5):
    a, b = (set(zip(*(t.split()[k:] for k in range(size)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_pairs_near_the_threshold(spark):
    """No pair under 0.8 is linked; of those between 0.8 and 0.9 at least 95 %."""
    r, rows, similarity = random.Random(5), [], []
    words = [f"w{k}" for k in range(20_000)]
    for k in range(600):
        base = r.sample(words, 304)  # 300 shingles; the last n words are replaced, so 300 - n of 300 + n are shared
        n = (33, 30, 24, 16, 36)[k % 5]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-n] + [f"x{k}y{i}" for i in range(n)]))]
        similarity.append((300 - n) / (300 + n))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    linked = np.array([got[2 * k + 1] == 2 * k for k in range(600)])
    near = np.array(similar := similarity) >= 0.8
    assert all(got[2 * k] == 2 * k for k in range(600)) and len(similar) == 600
    assert not linked[~near].any()
    assert linked[near].mean() >= 0.95


def test_recall_on_the_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    names = sorted(texts)
    sets = [set(simhash.shingle_hashes(texts[d], 5).tolist()) for d in names]
    holders = {}
    for k, s in enumerate(sets):
        for h in s:
            holders.setdefault(h, []).append(k)
    pairs = {(i, j) for x in holders.values() if len(x) > 1 for i in x for j in x if i < j}
    pairs = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    empty = [k for k, s in enumerate(sets) if not s]
    pairs += list(zip(empty, empty[1:], strict=False))
    root = roots(len(names), pairs)
    want = {d: names[r] for d, r in zip(names, root, strict=True)}
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    different = [(i, j) for i, j in pairs if sets[i] != sets[j]]
    assert len(different) > 10
    found = sum(got[names[i]] == got[names[j]] for i, j in different)
    assert found >= 0.9 * len(different)
    # no group goes beyond the exact one
    assert all(want[d] == want[got[d]] for d in names)


def test_refused_links_hide_no_other(spark, monkeypatch):
    """Candidates that are closer or come first in their order, but are refused, don't keep a true link from being found."""
    monkeypatch.setattr(S, "MOST", 40)  # nearly all that share an anchor are candidates
    monkeypatch.setattr(S, "LOOK", 2)
    r = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(40):
        base = [r.choice(words) for _ in range(150)]
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(base[:70] + ["new"] + base[70:])), (3 * k + 2, " ".join(base[:100] + [f"y{k}z{i}" for i in range(50)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    assert jaccard(rows[0][1], rows[1][1]) > 0.9 and jaccard(rows[0][1], rows[2][1]) < 0.7
    assert got == {3 * k + i: 3 * k + (2 if i == 2 else 0) for k in range(40) for i in range(3)}


def test_pairs_that_are_tested_grow_with_a_group_not_its_square(spark):
    """Copies that differ from each other by about a fifth of their shingles."""
    r = random.Random(9)
    base = [f"w{r.randrange(900)}" for _ in range(300)]
    rows = []
    for k in range(200):
        t = list(base)
        for i in r.sample(range(300), 3):
            t[i] = f"c{k}x{i}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = S.sketches(docs, 5).select("c", "bits", F.col("c").alias("root"))
    assert S.pairs_of(S.some_candidates(table, 0)).count() <= 400
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(200) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = roots(200, pairs)
    assert len(pairs) > 2000
    assert sum(got[k] == want[k] for k in range(200)) >= 198


def test_null_and_repeated_ids_lose_no_text(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("abcdefghij") + str(r.randrange(10_000)) for _ in range(60))
    alone = [text() for _ in range(12)]
    twice, other, last = text(), text(), text()
    rows = [(None, t) for t in alone]  # each is its own group
    rows += [(None, twice), (5, twice), (6, twice)]  # an id is ahead of null
    rows += [(7, other), (7, last), (8, last), (3, last)]  # an id with a unique text and a copy
    rows += [(None, None), (None, ""), (9, other + " "), (9, other + " ")]
    docs = spark.createDataFrame([(*x, "en", 1) for x in rows], "doc_id long, text string, lang string, root int").repartition(3)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [(x["doc_id"], x["text"] or "") for x in got.collect()]
    want = [(None, t) for t in alone] + [(5, twice), (7, other), (3, last), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(900)}" for _ in range(400)]
    rows = [(k, " ".join(base[: k % 397] + [f"c{k}"] + base[k % 397 :])) for k in range(700)]
    rows += [(1000 + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(50))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(x["doc_id"] for x in simhash.one_of_each(docs).collect())
    assert kept == [0, *range(1000, 1050)]


def test_rarest_shingles_lose_no_similar_pair(spark):
    """A large group around 0.65 to 0.9 of each other, with shingles that all have: brute force over the sets."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 140, dtype=np.int64)
    sets = []
    for _ in range(260):
        keep = base[rng.random(len(base)) > rng.uniform(0, 0.2)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, len(base) - len(keep), dtype=np.int64)])).astype(np.uint64))
    roots = [k - k % 2 if k < 40 else k for k in range(len(sets))]
    bits = [r.tobytes() for r in S.fingerprints(sets, S.PARTS)]
    active = spark.createDataFrame([(k, bits[k], roots[k]) for k in range(len(sets))], "c long, bits binary, root long")
    made = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "c long, shingles binary")
    got = {(r["a"], r["b"]) for r in S.rare_pairs(active, made, 0.8).collect()}
    want, every = set(), 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            every += roots[a] != roots[b]
            if roots[a] != roots[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert len(want) > 500 and len(want & got) >= 0.995 * len(want) and len(got) < every / 2
    empty = spark.createDataFrame([], active.schema), spark.createDataFrame([], made.schema)
    assert S.rare_pairs(*empty, 0.8).count() == 0
