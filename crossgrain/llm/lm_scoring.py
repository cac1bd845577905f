"""Language-model scores of whole texts: word counts over all training documents, and the attention model.

Word counts never gather on one machine, nor does a table of all words. Documents are written in blocks, each text as numbers
of its block's distinct words; a block sends those words once, dealt over shards by a hash. A shard sums its words' counts
over all blocks, splits each of its words into subword ids once, and sends counts and ids back to the blocks, in the order
that they came. A block's task then writes its documents' ids, with their scores by those counts; the model learns from and
scores these.

A word's chance is MIX parts of the attention model's for its ids and the rest of its share of all training words,
so that what the corpus repeats word for word weighs in a score too.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention_lm import BATCH, CLASSES, DRAWN, END, LATER_RATE, ROUNDS, STEPS, STRIDE, VOCABULARY, Model, packed_windows, unpacked_windows, windows
from .common import materialize
from .tokens import WordTokenizer, tokenizer_path

#: Bytes of text in a block, about, and of all text for each shard of words; at least so many shards.
BLOCK_BYTES, SHARD_BYTES, LEAST_SHARDS = 16 << 20, 16 << 20, 16
#: Partitions of a shuffle, which otherwise are as many as shards.
MOST_PARTS = 100_000
#: Ids that are learned from or scored at once, about.
PART_IDS = 200_000
#: Windows that a task learns from before it reads on, about.
HELD = 1 << 15
#: Weight of the attention model in a word's chance.
MIX = 0.8
#: Steps for each doubling of a count, by which counts travel in one byte.
LEVELS = 6


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that nothing is learned from; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def binary_array(n: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values of n bytes each, one after the other in data."""
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of binary values, and their bytes one after the other."""
    values = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, np.frombuffer(b"".join(values.drop_null().to_pylist()), np.uint8)


CODED = pa.schema(
    [("doc_id", pa.string()), ("held_out", pa.bool_()), ("block", pa.int64()), ("codes", pa.binary()), ("shard", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]
)


def coded_block(block: int, docs: pa.Table, shards: int) -> Iterator[pa.RecordBatch]:
    """The rows of coded() for one block."""
    texts = pa.concat_arrays(docs["text"].chunks).view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = lists.flatten()
    real = pc.not_equal(found, "").to_numpy(zero_copy_only=False)  # ends of texts may leave empty ones
    before = np.concatenate(([0], np.cumsum(real)))
    edges = lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    n = before[edges[1:]] - before[edges[:-1]]
    coded_ = found.filter(pa.array(real)).dictionary_encode()
    words = coded_.dictionary.view(pa.binary())
    shard = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % shards
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    codes = place[coded_.indices.to_numpy(zero_copy_only=False)]
    held = docs["held_out"].to_numpy()
    counts = np.bincount(codes[np.repeat(~held.astype(bool), n)], minlength=len(words))
    rows = len(n)
    none = lambda kind, m: pa.nulls(m, kind)
    yield pa.record_batch(
        [pa.concat_arrays(docs["doc_id"].chunks), pa.concat_arrays(docs["held_out"].chunks), pa.array(np.full(rows, block)), binary_array(4 * n, codes),
         none(pa.int64(), rows), none(pa.binary(), rows), none(pa.binary(), rows)], schema=CODED,
    )
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(cut))
    parts = [(int(cut[k]), int(cut[k + 1])) for k in full]
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut[full], len(words)).astype(np.int32)), words.take(pa.array(order)))
    sent = pc.binary_join(lists, pa.scalar(b"\n", pa.binary()))
    sums = [counts[a:b].astype("<i8").tobytes() for a, b in parts]
    m = len(parts)
    yield pa.record_batch(
        [none(pa.string(), m), none(pa.bool_(), m), pa.array(np.full(m, block)), none(pa.binary(), m),
         pa.array(full.astype(np.int64)), sent, pa.array(sums, pa.binary())], schema=CODED,
    )


def coded(docs: DataFrame, shards: int) -> DataFrame:
    """Writes two kinds of rows for each block of about BLOCK_BYTES of a task's texts: documents (doc_id, held_out, block, codes),
    codes being 32-bit numbers of the block's words, and its words by shard (block, shard, words, counts): joined by line feeds,
    with their 64-bit counts over the block's training documents. Words are numbered shard by shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("string"), held_out().alias("held_out"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, turn, size, held = TaskContext.get().partitionId(), 0, 0, []
        for x in batches:
            first = 0
            for k, n in enumerate(pc.binary_length(x.column("text")).to_pylist()):
                if size and size + n > BLOCK_BYTES:
                    held.append(x.slice(first, k - first))
                    yield from coded_block((task << 32) | turn, pa.Table.from_batches(held), shards)
                    turn, size, held, first = turn + 1, 0, [], k
                size += n
            held.append(x.slice(first))
        if sum(map(len, held)):
            yield from coded_block((task << 32) | turn, pa.Table.from_batches(held), shards)

    form = "doc_id string, held_out boolean, block long, codes binary, shard long, words binary, counts binary"
    return materialize(rows.mapInArrow(run, form), "coded")


def counted(blocks: DataFrame, shards: int, path: str) -> DataFrame:
    """Writes rows (block, shard, c, size, ids) for each block and shard of words: the words' 64-bit counts over all training documents,
    how many ids they have, and those ids as 16-bit numbers; and one row of each shard with block -1, its words' sum and number."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        lists = [w.split(b"\n") for w in x["words"]]
        number: dict[bytes, int] = {}
        index = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in lists]
        total = np.bincount(np.concatenate(index), np.frombuffer(b"".join(x["counts"]), "<i8"), len(number)).astype(np.int64)
        size, ids = WordTokenizer.of(path).words(list(number))
        first, ids = np.cumsum(size) - size, ids.astype("<u2")
        out = []
        for block, i in zip(x["block"], index, strict=True):
            n = size[i]
            at = np.arange(int(n.sum())) + np.repeat(first[i] - (np.cumsum(n) - n), n)
            out.append((block, total[i].astype("<i8").tobytes(), n.astype("<u4").tobytes(), ids[at].tobytes()))
        out.append((-1, np.array([total.sum(), (total > 0).sum()], "<i8").tobytes(), b"", b""))
        return pd.DataFrame(out, columns=["block", "c", "size", "ids"]).assign(shard=x["shard"].iloc[0])

    dealt = blocks.where("shard IS NOT NULL").select("block", "shard", "words", "counts").repartition(min(shards, MOST_PARTS), "shard")
    return materialize(dealt.groupBy("shard").applyInPandas(run, "block long, c binary, size binary, ids binary, shard long"), "counted")


def as_ids(blocks: DataFrame, counts: DataFrame, shards: int, total: int, distinct: int) -> DataFrame:
    """Writes rows (doc_id, held_out, n_tokens, n_known, base_words, ids, last, levels, lost) for each document: its 16-bit ids, a bit for
    each that says whether it ends a word, and a byte for each of those words: its count, by LEVELS steps for a doubling. base_words
    is its words' score by counts; lost that of words without ids, to which the attention model has nothing to say."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("shard")
        c, size, ids = (bytes_of(counts[n])[1].view(kind) for n, kind in (("c", "<i8"), ("size", "<u4"), ("ids", "<u2")))
        size = size.astype(np.int64)
        first = np.cumsum(size) - size
        chance = np.log10(c + 1.0) - np.log10(total + distinct + 1.0)
        level = np.minimum(255, np.floor(LEVELS * np.log2(c + 1.0) + 1e-9)).astype(np.uint8)
        n, word = bytes_of(docs["codes"])
        n, word, rows = n // 4, word.view("<u4"), len(docs)
        owner = np.repeat(np.arange(rows), n)
        sums = lambda x, o: np.bincount(o, x, rows)
        known, base = sums(c[word] > 0, owner), sums(chance[word], owner)
        lost = sums(np.where(size[word] == 0, chance[word] + np.log10(1 - MIX), 0.0), owner)
        some = size[word] > 0
        word, owner = word[some], owner[some]
        m = size[word]
        at = np.arange(int(m.sum())) + np.repeat(first[word] - (np.cumsum(m) - m), m)
        length = sums(m, owner).astype(np.int64)
        # the bits of each document start at a byte
        room = -(-length // 8)
        shift = 8 * (np.cumsum(room) - room) - (np.cumsum(length) - length)
        last = np.zeros(8 * int(room.sum()), bool)
        last[np.cumsum(m) - 1 + shift[owner]] = True
        words = np.bincount(owner, minlength=rows)
        return pa.table(
            {"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(n + 1), "n_known": pa.array(known.astype(np.int64)), "base_words": pa.array(base),
             "ids": binary_array(2 * length, ids[at]), "last": binary_array(room, np.packbits(last)), "levels": binary_array(words, level[word]), "lost": pa.array(lost)}
        )

    parts = min(shards, MOST_PARTS)
    texts = blocks.where("shard IS NULL").select("doc_id", "held_out", "block", "codes").repartition(parts, "block")
    both = texts.groupBy("block").cogroup(counts.where("block >= 0").repartition(parts, "block").groupBy("block"))
    form = "doc_id string, held_out boolean, n_tokens long, n_known long, base_words double, ids binary, last binary, levels binary, lost double"
    return materialize(both.applyInArrow(run, form), "ids", row_group=16 << 20)


def in_parts(ids: Iterable[bytes]) -> Iterator[list[np.ndarray]]:
    """The id sequences in parts of about PART_IDS."""
    part, size = [], 0
    for t in ids:
        part.append(np.frombuffer(t, "<u2").astype(np.int64))
        size += len(part[-1])
        if size > PART_IDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def id_counts(texts: DataFrame) -> np.ndarray:
    """How often each id, and the end, occurs in all training documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(VOCABULARY, np.int64)
        for x in batches:
            total += np.bincount(np.frombuffer(b"".join(x["ids"]), "<u2"), minlength=VOCABULARY)
            total[END] += len(x)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    by_task = texts.where("NOT held_out").select("ids").mapInPandas(count, "id long, n long")
    got = by_task.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCABULARY, np.int64)
    out[got["id"].to_numpy()] = got["n"].to_numpy()
    return out


def pair_counts(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, id, count) over all training documents and their ends; at most classes x ids rows, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES * VOCABULARY, np.int32)
        for x in batches:
            for part in in_parts(x["ids"]):
                model.add_pairs(part, total)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 18):
            key = at[a : a + (1 << 18)]
            yield pd.DataFrame({"key": key, "n": total[key].astype(np.int64)})

    by_task = texts.where("NOT held_out").select("ids").mapInPandas(count, "key long, n long")
    got = by_task.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = got["key"].to_numpy(), got["n"].to_numpy()
    return key // VOCABULARY, key % VOCABULARY, n


def started(texts: DataFrame, model: Model, ids: int) -> dict[str, np.ndarray]:
    """First weights, fitted in one task to about DRAWN windows of all training documents, drawn evenly: each task
    sends its share of them, whatever the texts' lengths. ids: how many there are to learn from."""
    share = min(1.0, DRAWN * STRIDE / max(1, ids))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        r = np.random.default_rng([11, task])
        for x in batches:
            for part in in_parts(x["ids"]):
                found = packed_windows(windows(part, model, r, share))
                if len(found):
                    yield pd.DataFrame({"task": [task], "rows": [found.tobytes()]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [np.frombuffer(b, "<u2") for x in batches for b in x["rows"]]
        if got:
            model.descend(unpacked_windows(np.concatenate(got)), STEPS, 7)
        yield pd.DataFrame({"w": [pickle.dumps(model.w)]})

    drawn = texts.where("NOT held_out").select("ids").mapInPandas(draw, "task long, rows binary")
    got = drawn.repartition(1).sortWithinPartitions("task", F.xxhash64("rows")).select("rows").mapInPandas(fit, "w binary").collect()
    return pickle.loads(got[0]["w"]) if got else model.w


def of_turn(texts: DataFrame, turn: int) -> DataFrame:
    """The ids of the training documents that fall to a turn, by their crc32; others are not sent to Python."""
    return texts.where("NOT held_out").where(F.crc32("ids") % ROUNDS == turn).select("ids")


def averaged(texts: DataFrame, model: Model, turn: int) -> dict[str, np.ndarray]:
    """Weights after a turn over the training documents: each task goes on from the model's on all windows of those that fall to
    the turn, each window once; every document falls to one of ROUNDS turns. A task holds about HELD windows.
    Weights are averaged by their windows; 16 sums reach the driver. The step size falls by turns."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, held, n, state = TaskContext.get().partitionId(), [], 0, {}
        parts = (part for x in batches for part in in_parts(x["ids"]))
        for part in itertools.chain(parts, [None]):
            held += [] if part is None else [packed_windows(windows(part, model))]
            size = sum(map(len, held))
            if size and (part is None or size >= HELD):
                model.descend(np.concatenate(held), -(-size // BATCH), turn, LATER_RATE * (1 - turn / ROUNDS), 1.0, state)
                held, n = [], n + size
        if n:
            yield pd.DataFrame({"slot": [task % 16], "n": [n], "w": [pickle.dumps({k: x * np.float64(n) for k, x in model.w.items()})]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        w = None
        for one in map(pickle.loads, x["w"]):
            w = one if w is None else {k: w[k] + one[k] for k in w}
        return pd.DataFrame({"slot": x["slot"].iloc[:1], "n": [x["n"].sum()], "w": [pickle.dumps(w)]})

    form = "slot long, n long, w binary"
    got = of_turn(texts, turn).mapInPandas(fit, form).groupBy("slot").applyInPandas(add, form).toPandas()
    if not len(got):
        return model.w
    all_ = add(got)
    return {k: (x / all_["n"].iloc[0]).astype(np.float32) for k, x in pickle.loads(all_["w"].iloc[0]).items()}


def trained(texts: DataFrame) -> Model:
    """A model fitted to all training documents: after its start, every one of their windows is learned from."""
    counts = id_counts(texts)
    model = Model.of_counts(counts)
    model.regroup(counts, *pair_counts(texts, model))
    model.w = started(texts, model, int(counts.sum()))
    for turn in range(ROUNDS):
        model.w = averaged(texts, model, turn)
    model.set_pairs(*pair_counts(texts, model))
    return model


def mixed_scores(model: Model, ids: list[np.ndarray], last: list[bytes], levels: list[bytes], end: float, size: float) -> np.ndarray:
    """log10 chances of texts and their ends: each word's is mixed of the attention model's and that of its count's level.

    end: log10 of the end's share of the tokens; size: log10 of what counts are divided by.
    """
    n = np.array([len(t) + 1 for t in ids], np.int64)
    ends = np.cumsum(n) - 1
    room = 8 * ((n + 6) // 8)  # a text's bits and what fills their last byte
    bits = np.unpackbits(np.frombuffer(b"".join(last), np.uint8)).astype(bool)
    stop = np.ones(int(n.sum()), bool)
    inner = np.ones(len(stop), bool)
    inner[ends] = False
    stop[inner] = bits[np.arange(len(stop) - len(n)) + np.repeat(np.cumsum(room) - room - (np.cumsum(n - 1) - (n - 1)), n - 1)]
    at = np.flatnonzero(stop)
    by_count = np.full(len(at), end)
    by_count[inner[at]] = np.frombuffer(b"".join(levels), np.uint8) * (np.log10(2) / LEVELS) - size
    by_model = np.add.reduceat(model.id_chances(ids), np.concatenate(([0], at[:-1] + 1)))
    chance = np.log10(MIX * 10.0**by_model + (1 - MIX) * 10.0**by_count)
    return np.bincount(np.repeat(np.arange(len(ids)), n)[at], chance, len(ids))


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are white-space separated words with A-Z in lower case, and one end. base_score: log10 of add-one
    word chances. score: the model's log10 chance of the text's words, split into subword ids, and its end. Null or empty text: the end alone.
    """
    path = path or tokenizer_path()
    text_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-text_bytes // SHARD_BYTES))
    blocks = coded(docs, shards)
    counts = counted(blocks, shards, path)
    ends = blocks.where("NOT held_out").count()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([np.frombuffer(c, "<i8") for c in x["c"]], columns=["n", "v"])

    words = counts.where("block = -1").select("c").mapInPandas(sums, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = (words["n"] or 0) + ends, (words["v"] or 0) + (ends > 0)
    texts = as_ids(blocks, counts, shards, total, distinct)
    model = trained(texts)
    size = float(np.log10(total + distinct + 1.0))
    end = float(np.log10(ends + 1.0)) - size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            scores, a = [np.zeros(0)], 0
            for part in in_parts(x["ids"]):
                b = a + len(part)
                scores.append(mixed_scores(model, part, x["last"].iloc[a:b], x["levels"].iloc[a:b], end, size))
                a = b
            out = x[["doc_id", "held_out", "n_tokens", "n_known"]]
            yield out.assign(
                n_known=out["n_known"] + (ends > 0), train_tokens=total, base_score=x["base_words"] + end, score=np.concatenate(scores) + x["lost"].to_numpy()
            )

    columns = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.mapInPandas(run, columns).withColumn("doc_id", F.col("doc_id").cast("long"))
