import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from crossgrain.llm import packing
from crossgrain.llm.tokens import WordTokenizer, tokenizer_path

TEXTS = [
    None, "", "   ", "Hello, World! it's a TEST's 12.5%", "École Ünïcode ǅ ß ŒUVRE don't", " nbsp x\u0085y", "Σίσυφος ΣΑΣ 中文 字",
    "<|endoftext|> is <|ENDOFTEXT|>", "é combining", "a\tb\x0bc\x1cd", "!!! ...,, #$%", "word " * 5000, "x" * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_words_give_the_tokenizers_ids(text):
    path = tokenizer_path()
    want = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    mine = WordTokenizer(path)
    for _ in range(2):
        assert np.frombuffer(mine.ids(text.encode() if text is not None else None), "<u4").tolist() == want


def test_best_fill_is_closest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for size, n in counts.items():
            sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= room}
        used = packing.best_fill(counts, room)
        assert all(0 < n <= counts[size] for size, n in used.items())
        assert sum(size * n for size, n in used.items()) == max(sums)


def test_pieces_fill_sequences_without_gaps(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3]), (77, "some more words " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS task", "3 AS rank", "4 AS n")
    got = packing.pack(docs.repartition(3)).toPandas()
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want.append((-1 if doc_id is None else doc_id, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got[cols].fillna(-1).astype("int64").values.tolist())) == sorted(want)
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]]
        assert x["length"].sum() <= 2048
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
