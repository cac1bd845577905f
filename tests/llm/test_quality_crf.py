import itertools
import random

import numpy as np

from crossgrain.llm import quality_crf as C


def test_marginals_against_all_paths():
    r = np.random.default_rng(0)
    count = np.array([1, 4, 2, 6])
    unary, pair = r.normal(size=count.sum()), r.normal(size=(2, 2))
    got, moves = C.marginals(unary, count, pair)
    want, total, at = [], np.zeros((2, 2)), 0
    for n in count:
        weight, paths = [], list(itertools.product((0, 1), repeat=int(n)))
        for p in paths:
            weight.append(sum(unary[at + i] * s for i, s in enumerate(p)) + sum(pair[a, b] for a, b in itertools.pairwise(p)))
        w = np.exp(weight) / np.exp(weight).sum()
        want += [sum(x for x, p in zip(w, paths, strict=True) if p[i]) for i in range(n)]
        for x, p in zip(w, paths, strict=True):
            for a, b in itertools.pairwise(p):
                total[a, b] += x
        at += int(n)
    assert np.allclose(got, want) and np.allclose(moves, total)


def corpus(n, seed):
    r, texts, labels = random.Random(seed), [], []
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "is"]) for _ in range(r.randint(1, 4)))
    for k in range(n):
        good = k % 4 > 0
        lines = []
        for _ in range(r.randint(1, 6)):
            words = [word() for _ in range(r.randint(3, 20))]
            lines.append(" ".join(words) + "." if good else " ".join(w + r.choice(["***", "!!", "$$$"]) for w in words))
        if not good and r.random() < 0.5:
            lines.insert(0, " ".join(word() for _ in range(8)) + ".")
        texts.append("\n".join(lines).encode())
        labels.append(int(good))
    return texts, labels


def test_accuracy_on_held_out_documents():
    chain = C.train(*corpus(400, 1))
    texts, labels = corpus(200, 2)
    p = chain.score(texts)
    assert np.mean((p >= C.THRESHOLD) == np.array(labels)) > 0.97
    assert np.allclose(chain.score(texts[:7]), p[:7])  # documents don't depend on their batch


def test_queries_edge_cases(spark):
    texts, labels = corpus(120, 3)
    rows = [(k, t.decode(), "en", "s") for k, t in enumerate(texts)] + [(None, "x y", "en", "s"), (500, None, None, None), (501, "", "en", "s"), (502, "\n" * 50, "en", "s"), (503, "w " * 60_000, "en", "s"), (3, "again", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS score", "0 AS quality", "true AS held_out")
    known = spark.createDataFrame([(k, y, 0) for k, y in enumerate(labels)] + [(0, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = C.classify(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and r["doc_id"] != 3]
    assert np.mean(right) > 0.95
    none = C.classify(docs, known.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1
    assert C.classify(docs.limit(0), known).count() == 0
