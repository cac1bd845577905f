import zlib
from collections import Counter
from math import log10

import numpy as np

from crossgrain.llm import attention_lm as A
from crossgrain.llm import lm_scoring as L


def test_counts_and_base_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(3)
    vocab = ["The", "the", "é", "Ünder", "b.", "\x85x", "w" * 40, "end", "<end>"] + [f"v{k}" for k in range(50)]
    rows = [(k, " ".join(vocab[int(i)] for i in rng.integers(0, len(vocab), int(rng.integers(0, 60))))) for k in range(60)]
    rows += [(None, "the unseen word"), (200, None), (201, ""), (202, " \t\n"), (3, "again 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS word", "true AS held_out", "3 AS c")
    monkeypatch.setattr(L, "STEPS", 5)
    got = L.score(docs.repartition(3)).collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    seen, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            seen.update(words(t))
            ends += 1
    n, v = sum(seen.values()) + ends, len(seen) + 1
    want = []
    for d, t in rows:
        c = [seen[w] for w in words(t)] + [ends]
        want.append((-1 if d is None else d, held(d), len(c), sum(x > 0 for x in c), n, round(sum(log10((x + 1) / (n + v + 1)) for x in c), 6)))
    have = [(-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(have) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    empty = {r["score"] for r in got if r["n_tokens"] == 1}
    assert max(empty) - min(empty) < 1e-9  # the end alone


def test_empty_table(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_are_counted_over_word_borders(spark):
    texts = [[5, 6, 7], [6, 5], [], [7, 7, 7]]
    rows = [(np.array(t, "<u2").tobytes(), k == 1) for k, t in enumerate(texts)]
    model = A.Model.of_counts(np.arange(A.VOCABULARY)[::-1])
    before, ids, n = L.pair_counts(spark.createDataFrame(rows, "ids binary, held_out boolean"), model)
    want = Counter()
    for k, t in enumerate(texts):
        if k != 1:
            want.update((int(model.cls[a]), b) for a, b in zip([A.START, *t], [*t, A.END], strict=True))
    assert {(a, b): c for a, b, c in zip(before.tolist(), ids.tolist(), n.tolist(), strict=True)} == want


def test_mixed_scores_against_word_by_word(spark):
    """Words of several ids; counts by levels, each at most an octave's LEVELS-th below its count."""
    words = [[5, 6], [7], [8, 9, 10], [5]]
    model = A.Model.of_counts(np.arange(A.VOCABULARY)[::-1])
    c = np.array([3, 0, 100, 7])
    level = np.floor(L.LEVELS * np.log2(c + 1.0) + 1e-9).astype(np.uint8)
    text = np.concatenate(words)
    last = np.packbits(np.concatenate([[0] * (len(w) - 1) + [1] for w in words])).tobytes()
    empty = np.zeros(0, np.int64)
    got = L.mixed_scores(model, [text, empty, text], [last, b"", last], [level.tobytes(), b"", level.tobytes()], -2.0, 4.0)
    chances = model.id_chances([text])
    ends = np.cumsum([0] + [len(w) for w in words])
    total = log10(L.MIX * 10 ** chances[-1] + (1 - L.MIX) * 1e-2)
    for k in range(4):
        by_count = level[k] * log10(2) / L.LEVELS - 4
        assert log10(c[k] + 1) - 4 - log10(2) / L.LEVELS <= by_count <= log10(c[k] + 1) - 4 + 1e-9
        total += log10(L.MIX * 10 ** chances[ends[k] : ends[k + 1]].sum() + (1 - L.MIX) * 10**by_count)
    alone = log10(L.MIX * 10 ** model.id_chances([empty])[0] + (1 - L.MIX) * 1e-2)
    assert np.allclose(got, [total, alone, total], atol=1e-4)


def test_all_training_documents_are_learned_from(spark, monkeypatch):
    """Also beyond any number of ids of a text, and from held-out ones nothing."""
    monkeypatch.setattr(L, "STEPS", 300)
    long = np.array([1, 2] * 3000 + [900] * 4000)
    rows = [(k, False, x.astype("<u2").tobytes()) for k, x in enumerate([np.array([3, 4]), long, np.array([5, 6] * 2000)])]
    rows.append((9, True, np.array([700] * 9000, "<u2").tobytes()))
    texts = spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary").repartition(3)
    count = L.id_counts(texts)
    assert (count[900], count[5], count[700], count[A.END]) == (4000, 2000, 0, 3)
    model = L.trained(texts)
    assert model.cls[900] == 0 and model.row[900] == 0  # the most frequent id, though late in one text
    start = A.Model.of_counts(count)
    for text in (np.array([5, 6] * 50), np.array([900] * 100), np.array([1, 2] * 50)):
        assert model.score([text])[0] > start.score([text])[0] + 50


def test_held_out_cost_is_below_the_add_one_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.score(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert got["s"] / got["n"] > got["b"] / got["n"] + 0.15


def test_the_turns_learn_from_all_windows(spark, monkeypatch):
    """Without a start, the windows of all documents are enough to learn a rule by; a 64th of them is not."""
    monkeypatch.setattr(L, "STEPS", 1)
    rng = np.random.default_rng(4)
    made = lambda: np.stack([2 * rng.integers(0, 20, 2400), np.zeros(2400, int)], axis=1)
    pairs = [(x + [0, 1] + np.stack([np.zeros(len(x), int), x[:, 0]], axis=1)).ravel() for x in (made() for _ in range(400))]  # an even id, then the next number
    texts = spark.createDataFrame([(k, False, x.astype("<u2").tobytes()) for k, x in enumerate(pairs)], "doc_id long, held_out boolean, ids binary").repartition(1)
    model = L.trained(texts)
    assert -model.score([pairs[0]])[0] / (len(pairs[0]) + 1) < 0.75  # 0.65 by the rule, 1.3 without


def test_every_training_document_falls_to_one_turn_and_only_its_turn_is_sent_it(spark):
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 900, int(n)).astype("<u2").tobytes() for n in rng.integers(0, 30, 200)] + [b"", b""]
    texts = spark.createDataFrame([(k % 7 == 2, x) for k, x in enumerate(ids)], "held_out boolean, ids binary")
    turns = [Counter(bytes(r["ids"]) for r in L.of_turn(texts, turn).collect()) for turn in range(A.ROUNDS)]
    assert sum(turns, Counter()) == Counter(x for k, x in enumerate(ids) if k % 7 != 2)
    assert all(zlib.crc32(x) % A.ROUNDS == turn for turn, got in enumerate(turns) for x in got)
    assert all(turns)
