"""Exact removal of repeated strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. To find these strings:

1. Every window of LENGTH bytes gets an anchor: the GRAM-byte string within it whose hash is smallest (the
   leftmost such). Equal windows have equal anchors in equal places, and neighbouring windows mostly share one, so
   a text becomes a list of runs of windows. Hashes are counted over blocks of documents; a window whose
   anchor's hash occurs once is unique and is done with.
2. The other runs are dealt by hash, with their bytes. A task takes hashes in order, a chunk of whole ones at a time.
3. In a chunk the suffixes that start at anchors are sorted, and the reversed prefixes that end there. The sort is
   blockwise: ranks of the suffixes at a difference cover's positions (modulo PERIOD) are made first; then one
   bucket of suffixes (by first byte) at a time is sorted by its first PERIOD bytes, and ties are resolved by cover
   ranks: for any two positions in use there is a shift below PERIOD that takes both into the cover.
   Memory is bounded by the chunk, and by the bucket within it.
4. A window with k bytes before its anchor equals another if their prefixes agree in k bytes and their suffixes in
   LENGTH - k, which are stretches of the two orders. All but the earliest window of a class are covered.

Exact copies of a text are settled beforehand: all but the first are covered throughout. So are equal runs in
one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, GRAM, PERIOD = 100, 20, 32
#: Bytes of text that are hashed at once, in a block of documents, and in a chunk of keys.
SEGMENT, BLOCK_BYTES, CHUNK = 1 << 18, 16 << 20, 12 << 20
#: Bits that tell positions in a segment's bytes.
PLACE = 22


def window_anchors(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each GRAM-byte string of b, place of each window's anchor); b is longer than LENGTH and under 2^PLACE."""
    n = len(b) - GRAM + 1
    word = lambda k: np.ndarray(n, "<u8", b, k, (1,)).astype(np.uint64)  # noqa: E731  eight bytes from each place + k
    with np.errstate(over="ignore"):
        g = word(0) * np.uint64(0x9E3779B97F4A7C15)
        g += word(8)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += word(GRAM - 8) * np.uint64(0xC2B2AE3D27D4EB4F)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
    # the smallest upper bits, then the leftmost place, by doubling: a window has 81 = 64 + 17 strings
    m = g & ~np.uint64((1 << PLACE) - 1) | np.arange(n, dtype=np.uint64)
    k = 1
    while k < 64:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = LENGTH - GRAM + 1 - 64
    return g, (np.minimum(m[: len(m) - rest], m[rest:]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one anchor: arrays (text's index, hash, first window, windows, bytes from it to the
    anchor), segment by segment."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - LENGTH + 1), SEGMENT):  # windows a to a + SEGMENT
            part = t[a : a + SEGMENT + LENGTH - 1]
            batch.append((i, a, part))
            size += len(part)
            if size >= SEGMENT:
                yield _runs(batch)
                batch, size = [], 0
    if batch:
        yield _runs(batch)


def _runs(batch: list[tuple[int, int, bytes]]):
    size = np.array([len(p) for _, _, p in batch])
    begin = np.cumsum(size) - size
    g, anchor = window_anchors(b"".join(p for _, _, p in batch) + b"\0" * 8)
    count = size - LENGTH + 1
    owner = np.repeat(np.arange(len(batch)), count)  # of each window that lies in one text
    at = np.arange(len(owner)) + np.repeat(begin - (np.cumsum(count) - count), count)
    anchor = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    n = np.diff(np.append(first, len(anchor)))
    who, place = owner[first], anchor[first]
    start = at[first] - begin[who] + np.array([a for _, a, _ in batch])[who]
    return np.array([i for i, _, _ in batch])[who], g[place].view(np.int64), start, n, place - at[first]


@cache
def difference_cover(residues: tuple[int, ...], v: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """(whether a residue is in the cover, shift[r, s] that takes residues r and s into it) for residues in use.

    One residue is covered by itself; for more the cover has all differences modulo v.
    """
    inside = np.zeros(v, bool)
    if len(residues) == 1:
        inside[residues[0]] = True
    else:
        r = int(np.ceil(np.sqrt(v)))
        inside[: r + 1] = True
        inside[r::r] = True
        inside[v - 1] = True
    d = np.arange(v)
    ok = inside[(d[:, None, None] + d) % v] & inside[(d[None, :, None] + d) % v]
    assert all(ok[r, s].any() for r in residues for s in residues)
    return inside, ok.argmax(axis=2)


class SuffixSorter:
    """Sorts suffixes of a text that start at residues in use, one bucket at a time; zeros follow the text's end.

    The order is that of the first LENGTH + PERIOD bytes at least.
    """

    def __init__(self, text: np.ndarray, residues: tuple[int, ...] = tuple(range(PERIOD))):
        self.n = len(text)
        self.text = np.concatenate((text, np.zeros(4 * PERIOD + LENGTH, np.uint8)))
        self.word = np.ndarray(len(self.text) - 7, ">u8", self.text, 0, (1,))
        self.inside, self.shift = difference_cover(residues)
        self._rank_cover()

    def words(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The eight bytes at these positions as whole numbers in byte order."""
        return self.word[at + offset].astype(np.uint64)

    def _rank_cover(self) -> None:
        """Ranks of the suffixes at cover positions: names of PERIOD bytes, then doubling by PERIOD."""
        at = np.flatnonzero(self.inside[np.arange(self.n + PERIOD) % PERIOD])
        rank = np.zeros(self.n + 2 * PERIOD + 1, np.int64)
        keys = [self.words(at, k) for k in range(0, PERIOD, 8)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        rank[at[order]] = np.cumsum(new) + 1
        reach, top = PERIOD, int(new.sum()) + 1
        while top < len(at) and reach < LENGTH + PERIOD:  # order beyond that is of no use here
            second = rank[np.minimum(at + reach, len(rank) - 1)]  # 0 beyond the end
            both = rank[at] * (top + 1) + second
            order = np.argsort(both, kind="stable")
            new = np.concatenate(([False], both[order[1:]] != both[order[:-1]]))
            now = int(new.sum()) + 1
            rank[at[order]] = np.cumsum(new) + 1
            if now == top:
                break
            top, reach = now, 2 * reach
        self.rank = rank

    def before(self, a: int, b: int) -> int:
        s = self.shift[a % PERIOD, b % PERIOD]
        return int(self.rank[a + s]) - int(self.rank[b + s])

    def sort(self, at: np.ndarray) -> np.ndarray:
        """The suffixes at these positions in order, those of one bucket."""
        keys = [self.words(at, k) for k in range(0, PERIOD, 8)]
        order = np.lexsort(keys[::-1])
        at = at[order]
        new = np.zeros(len(at), bool)
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        group = np.cumsum(new)
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            return at
        # groups in one residue: their shift is the same, so cover ranks are sort keys
        res = at % PERIOD
        first = np.concatenate(([0], np.flatnonzero(new)))
        mixed = np.zeros(len(size), bool)
        np.logical_or.at(mixed, group[tied], res[tied] != res[first[group[tied]]])
        plain = tied[~mixed[group[tied]]]
        if len(plain):
            p = at[plain]
            by = np.lexsort((self.rank[p + self.shift[res[plain], res[plain]]], group[plain]))
            at[plain] = p[by]
        for g in np.flatnonzero(mixed):
            a, b = first[g], first[g] + size[g]
            at[a:b] = self._sort_mixed(at[a:b])
        return at

    def _sort_mixed(self, at: np.ndarray) -> np.ndarray:
        """Ties of several residues. Each residue's suffixes are ranked first; one of each rank is compared."""
        heads: dict[int, np.ndarray] = {}
        for r in np.unique(at % PERIOD):
            own = at[at % PERIOD == r]
            key = self.rank[own + self.shift[r, r]]
            by = np.argsort(key, kind="stable")
            own, key = own[by], key[by]
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for part in np.split(own, cuts[1:]):
                heads[int(part[0])] = part
        order = sorted(heads, key=cmp_to_key(self.before))
        return np.concatenate([heads[h] for h in order])

    def order(self, at: np.ndarray) -> np.ndarray:
        """All these positions in the order of their suffixes, bucket by bucket."""
        at = np.sort(at)
        first = self.text[at]
        by_byte = np.argsort(first, kind="stable")
        edges = np.searchsorted(first[by_byte], np.arange(257))
        return np.concatenate([self.sort(at[by_byte[edges[k] : edges[k + 1]]]) for k in np.flatnonzero(np.diff(edges))]) if len(at) else at


def ordered_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers in suffix order, bytes in which each agrees with the one before). Rows are multiples of PERIOD wide."""
    wide = rows.shape[1]
    order = SuffixSorter(rows.ravel(), (0,)).order(np.arange(len(rows)) * wide) // wide
    differ = rows[order[1:]] != rows[order[:-1]]
    agree = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return order, np.concatenate(([0], agree))


def later_windows(parts: list[bytes], n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows equal one of a run before: a table runs x LENGTH, by bytes between window and anchor.

    Runs come in order of precedence; parts[i] holds n[i] windows, its anchor starts at at[i].
    """
    n, at, count = np.asarray(n, np.int64), np.asarray(at, np.int64), len(parts)
    later = np.zeros((count, LENGTH), bool)
    wide = -(-LENGTH // PERIOD) * PERIOD
    sides = []
    for side in ([p[a:] for p, a in zip(parts, at.tolist(), strict=True)], [p[:a][::-1] for p, a in zip(parts, at.tolist(), strict=True)]):
        rows = np.frombuffer(b"".join(p[:wide].ljust(wide, b"\0") for p in side), np.uint8).reshape(count, wide)
        order, agree = ordered_rows(rows)
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        sides.append((place, agree))
    (right, right_agree), (left, left_agree) = sides
    index = np.arange(count)
    stretch = lambda agree, k: np.maximum.accumulate(np.where(agree < k, index, 0))  # noqa: E731  by place
    for k in range(LENGTH - GRAM + 1):
        own = np.flatnonzero((at - n < k) & (k <= at))  # runs with such a window
        if len(own) < 2:
            continue
        cls = stretch(right_agree, LENGTH - k)[right[own]] * count + stretch(left_agree, k)[left[own]]
        order = np.argsort(cls, kind="stable")  # the first of a class takes precedence
        again = cls[order[1:]] == cls[order[:-1]]
        later[own[order[1:][again]], k] = True
    return later


def covered_in_chunk(x: pd.DataFrame) -> pd.DataFrame:
    """Intervals that the windows of whole hashes cover. x: rows (key, ord, tag, start, n, at, part) in order."""
    at, start = x["at"].to_numpy(np.int64), x["start"].to_numpy(np.int64)
    later = later_windows(x["part"].tolist(), x["n"].to_numpy(), at)
    later = np.pad(later, ((0, 0), (1, 1)))  # stretches of covered windows: their ends by bytes before the anchor
    step = np.diff(later.astype(np.int8), axis=1)
    run, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    anchor = start[run] + at[run]
    out = {"ord": x["ord"].to_numpy()[run], "tag": x["tag"].to_numpy()[run], "a": anchor - high, "b": anchor - low + LENGTH}
    return pd.DataFrame(out).astype("int64")


def sort_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Takes runs sorted by hash and precedence; works on chunks of whole hashes."""
    held, size = [], 0
    for batch in batches:
        whole = batch["part"].isna()
        if whole.any():
            x = batch[whole]
            yield pd.DataFrame({"ord": x["ord"], "tag": x["tag"], "a": x["start"], "b": x["start"] + x["n"] + LENGTH - 1})
            batch = batch[~whole]
        while len(batch):
            if size >= CHUNK:  # end the chunk where its last hash ends
                more = int(np.searchsorted(batch["key"].to_numpy(), held[-1]["key"].iloc[-1], side="right"))
                held.append(batch.iloc[:more])
                batch = batch.iloc[more:]
                if len(batch):
                    yield covered_in_chunk(pd.concat(held, ignore_index=True))
                    held, size = [], 0
                continue
            sizes = batch["part"].str.len().cumsum().to_numpy()
            n = min(len(batch), int(np.searchsorted(sizes, CHUNK - size)) + 1)
            held.append(batch.iloc[:n])
            size += int(sizes[n - 1])
            batch = batch.iloc[n:]
    if held:
        yield covered_in_chunk(pd.concat(held, ignore_index=True))


def remove_intervals(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, bytes that stay)."""
    removed, n, keep, at = 0, 0, [], 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            n += 1
            keep.append(text[at:a])
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    return removed, n, b"".join([*keep, text[at:]])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and what names a row's text: ord (doc_id, null last) and tag (a hash)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns(
        {"ord": F.coalesce("doc_id", F.lit(2**63 - 1)), "tag": F.xxhash64("text")}
    )


def covered(docs: DataFrame) -> DataFrame:
    """Rows (ord, tag, a, b): byte intervals of texts that earlier strings cover; they may overlap."""
    spark = docs.sparkSession
    short = F.length("text") < LENGTH
    ids = materialize(docs.select("ord", "tag", F.sha2("text", 256).alias("sha"), F.length("text").alias("n"), short.alias("short")), "texts")
    total = ids.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    least = ids.groupBy("sha").agg(F.min("ord").alias("least"))
    copies = ids.where("NOT short").join(least, "sha").where("ord > least").select("ord", "tag", "n").distinct()
    copies = materialize(copies, "copies")
    block = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n_blocks))
    texts = docs.where(~short).select("ord", "tag", "text", block("ord", "tag").alias("block"))

    def count_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            home = x["block"].to_numpy(np.int64)
            seen = [np.stack([key, home[who]]) for who, key, *_ in runs(x["text"].tolist())]
            if seen:
                key, at = np.concatenate(seen, axis=1)
                order = np.lexsort((at, key))
                key, at = key[order], at[order]
                new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1]))))
                yield pd.DataFrame({"key": key[new], "block": at[new], "n": np.minimum(np.diff(np.append(new, len(key))), 2)})

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of rows sorted by key: those whose key has two or more. One row of the last key is carried on."""
        held = pd.DataFrame({"key": [], "block": [], "n": [], "sent": []}).astype("int64")
        for x in batches:
            x = pd.concat([held, x.assign(sent=0)], ignore_index=True)
            if not len(x):
                continue
            key = x["key"].to_numpy()
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            many = np.add.reduceat(x["n"].to_numpy(), new) >= 2
            yield x.loc[np.repeat(many, np.diff(np.append(new, len(key)))) & (x["sent"] == 0), ["key", "block"]]
            held = x.iloc[new[-1] : new[-1] + 1]  # a key with fewer than two has but this row
            held = held.assign(n=2, sent=1) if many[-1] else held

    # deal keys in order, so that a task needs to hold one row of the current key alone
    counts = texts.select("block", "text").mapInPandas(count_keys, "key long, block long, n long")
    again = counts.repartition("key").sortWithinPartitions("key").mapInPandas(repeated, "key long, block long")
    marks = again.select("block", "key", F.lit(0).cast("long").alias("tag"), F.lit(False).alias("copy"))
    marks = marks.union(copies.select(block("ord", "tag"), "ord", "tag", F.lit(True)))

    def cut_runs(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        copy = marks["copy"].to_numpy(bool)
        gone = set(zip(marks["key"][copy].tolist(), marks["tag"][copy].tolist(), strict=True))
        wanted = np.sort(marks["key"].to_numpy(np.int64)[~copy])
        docs = docs[[k not in gone for k in zip(docs["ord"].tolist(), docs["tag"].tolist(), strict=True)]] if gone else docs
        docs = docs.drop_duplicates(["ord", "tag"]).sort_values(["ord", "tag"])
        texts, o, t, out, first = docs["text"].tolist(), docs["ord"].to_numpy(), docs["tag"].to_numpy(), [], set()
        for who, key, start, n, at in runs(texts) if len(wanted) else ():
            near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            hit = np.flatnonzero(wanted[near] == key)
            who, key, start, n, at = who[hit], key[hit], start[hit], n[hit], at[hit]
            fresh, spans = [], []
            for k, (i, s, c, p) in enumerate(zip(who.tolist(), start.tolist(), n.tolist(), at.tolist(), strict=True)):
                name = (p, texts[i][s : s + c + LENGTH - 1])
                if name not in first:
                    first.add(name)
                    fresh.append((k, name[1]))
                elif spans and spans[-1][0] == i and s <= spans[-1][2]:  # an equal run came before: covered throughout
                    spans[-1][2] = s + c + LENGTH - 1
                else:
                    spans.append([i, s, s + c + LENGTH - 1])
            k = np.array([k for k, _ in fresh], np.int64)
            out.append(pd.DataFrame({"key": key[k], "ord": o[who[k]], "tag": t[who[k]], "start": start[k], "n": n[k], "at": at[k], "part": [x for _, x in fresh]}))
            if spans:
                i, a, b = np.array(spans, np.int64).T
                out.append(pd.DataFrame({"key": 0, "ord": o[i], "tag": t[i], "start": a, "n": b - a - LENGTH + 1, "at": 0, "part": None}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("key", "ord", "tag", "start", "n", "at", "part")})

    parts = (
        texts.groupBy("block").cogroup(marks.groupBy("block"))
        .applyInPandas(cut_runs, "key long, ord long, tag long, start long, n long, at long, part binary")
    )
    # runs that are covered throughout need no sorting; their intervals go by other hashes, so that none is hot
    parts = parts.withColumn("key", F.when(F.col("part").isNull(), F.xxhash64("ord", "start")).otherwise(F.col("key")))
    spans = (
        parts.repartition("key").sortWithinPartitions("key", "ord", "tag", "start")
        .mapInPandas(sort_chunks, "ord long, tag long, a long, b long")
    )
    return spans.union(copies.select("ord", "tag", F.lit(0).cast("long"), F.col("n").cast("long")))


def deduplicate(docs: DataFrame, text: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what stays of each document; kept only if text is asked for.

    Every byte goes that a string of LENGTH bytes covers which also starts earlier: in a document with a smaller
    doc_id, or earlier in its own. Strings are judged on the input. Null doc_ids come last, rows with one doc_id in
    the order of a hash of their texts; rows equal in both are the same document and don't count against each
    other. Null texts are empty. Shorter texts than LENGTH stay whole.
    """
    docs = keyed(docs)
    spans = covered(docs).groupBy("ord", "tag").agg(F.collect_list(F.array("a", "b")).alias("spans"))  # bounded by a text's length

    with_text = bool(text)
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for doc_id, text, spans in zip(x["doc_id"], x["text"], x["spans"], strict=True):
                removed, n, kept = remove_intervals(text, [(int(a), int(b)) for a, b in spans] if spans is not None else [])
                rows.append((doc_id, len(text), removed, n, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            yield pd.DataFrame(rows, columns=names)

    # doc_id travels as a string: pandas has no whole numbers with nulls
    joined = docs.join(spans, ["ord", "tag"], "left").select(F.col("doc_id").cast("string"), "text", "spans")
    out = joined.mapInPandas(cut, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
