import numpy as np
import xxhash

from crossgrain.llm import simhash as H
from crossgrain.llm.components import components


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))
    for a, b in pairs:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    for k in range(n):
        up[k] = up[up[k]]
    return up


def test_golay_code_is_perfect_and_anchors_are_complete():
    golay = H.Golay()
    first, words = golay.near[0]
    assert np.diff(first).tolist() == [1] * 2048
    rng = np.random.default_rng(3)
    for bits in range(4):
        for _ in range(100):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            blocks = lambda z: (np.array([z & (2**23 - 1)]), np.array([z >> 23 & (2**23 - 1)]))
            a, b = (H.covering_anchors(golay, *blocks(z))[1] for z in (x, y))
            assert len(set(a.tolist()) & set(b.tolist()))
            assert len(set(a.tolist())) == len(a)


def test_groups_and_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{k}" for k in range(500)]
    texts = [None, "", " \t", "One", "one two", "A B C", "a b c\n", "É é ß"]
    for _ in range(25):
        base = [vocab[int(k)] for k in rng.integers(0, 500, int(rng.integers(30, 400)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            other = list(base)
            for k in rng.integers(0, len(base), 2):
                other[int(k)] = "changed"
            texts.append(" ".join(other))
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS f0", "2 AS c", "3 AS anchor", "4 AS node", "5 AS root")
    got = H.near_duplicates(docs.repartition(3)).collect()
    prints = [brute_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert len({p for p in pairs if prints[p[0]] != prints[p[1]]}) > 5
    root = roots(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, 10**9), d if d is not None else 10**9)
    want = sorted((d or -1, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, root, strict=True))
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in got) == want


def test_bit_counts_of_many_hashes():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    begin = np.array([0, 1, 255, 256, 511, 1300])
    got = H.bit_counts(h, begin)
    for k, part in enumerate(np.split(h, begin[1:])):
        assert got[k].tolist() == [int((part >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


def test_search_in_large_groups():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 63, (4, 60)).astype(np.uint64))]).ravel()
    groups = np.zeros(len(prints), np.int64)
    pairs = list(H.near_pairs(prints, groups, 3))
    every = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 3]
    assert roots(len(prints), pairs) == roots(len(prints), every)
    assert len(pairs) < len(prints)


def test_components_of_paths_stars_and_none(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(200, k) for k in range(201, 240)] + [(300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 200 for k in range(200, 240)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert H.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
