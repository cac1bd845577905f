"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: two binary Golay codes of 23 bits side by side, on 46 bits of a
fingerprint. Each Golay code is perfect with covering radius 3, so every point has an anchor within 3 in each
block. A fingerprint is replicated to every anchor within the covering radius plus a share of the threshold,
counted over both blocks, and fingerprints are compared per anchor.

Which share is enough: for fingerprints x, y that differ in at most 3 bits there is a point z between them
with d(x, z) <= 1 and d(z, y) <= 2. The anchor of z lies within radius + 1 of x and radius + 2 of y. So
radius + 2 finds all pairs within 3; each fingerprint has 61 such anchors of 2^24 on average.

Equal fingerprints are one class from the start. Within an anchor only a spanning forest of the links is
emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

SEED = 42
#: Bits in which linked fingerprints may differ, and what each side adds to the covering radius for that.
MAX_BITS, REACH = 3, 2
#: Generator polynomial of the [23, 12] Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY, BLOCK = 0b110001110101, 23
#: Shingles whose bits are counted at once, and groups that are compared by offsets instead of searched.
COUNT_BATCH, SMALL = 1 << 15, 24
#: For each byte a word whose bytes are its bits, the lowest first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


class Golay:
    """Words of the cosets of the Golay code, by syndrome and by weight above the covering radius."""

    def __init__(self, reach: int = REACH):
        bits = np.array([1 << k for k in range(BLOCK)], np.int64)
        points = [np.zeros(1, np.int64)] + [np.array([sum(c) for c in combinations(bits.tolist(), w)], np.int64) for w in range(1, 4 + reach)]
        #: excess -> (first index by syndrome, words in syndrome order)
        self.near = []
        for e in range(reach + 1):
            words = np.concatenate(points[:4]) if e == 0 else points[3 + e]
            syndrome = self.syndrome(words)
            order = np.argsort(syndrome, kind="stable")
            self.near.append((np.searchsorted(syndrome[order], np.arange(2049)), words[order]))

    @staticmethod
    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for k in range(BLOCK - 1, 10, -1):
            x ^= ((x >> k) & 1) * (GOLAY << (k - 11))
        return x

    def anchors(self, x: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """For points x: (index of the point, anchor) at exactly this distance beyond the radius."""
        first, words = self.near[excess]
        s = self.syndrome(x)
        n = first[s + 1] - first[s]
        at = np.repeat(np.arange(len(x)), n)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, x[at] ^ words[first[s[at]] + inner]


def covering_anchors(golay: Golay, low: np.ndarray, high: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) for all anchors whose distances beyond the radius sum to at most reach over both blocks of 23 bits.

    A code word is known by its highest 12 bits, so an anchor is a number of 24 bits.
    """
    at, anchors = [], []
    for e in range(reach + 1):
        i, one = golay.anchors(low, e)
        for f in range(reach + 1 - e):
            j, two = golay.anchors(high[i], f)
            at.append(i[j])
            anchors.append(((one[j] >> 11) << 12) | (two >> 11))
    return np.concatenate(at), np.concatenate(anchors)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits for a shingle: its hash itself, then independent mixes of it."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    rows = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(SEED)), np.uint64, len(words) - size + 1)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def bit_counts(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many of the hashes from each begin to the next have each of the 64 bits, the lowest first."""
    # a byte's bits become the bytes of a word, of which up to 255 are summed before one can overflow
    words = SPREAD[h.view(np.uint8).reshape(-1, 8)]
    size = np.diff(np.append(begin, len(h)))
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(begin, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    return np.add.reduceat(np.add.reduceat(words, at, axis=0).view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int64)


def fingerprints(hashes: Iterable[np.ndarray], parts: int = 1) -> np.ndarray:
    """A row of parts x 64 bits for each array of shingle hashes: a bit is 1 if over half of them have it."""
    ones, total, pending, held = [], [], [], 0

    def flush() -> None:
        full = [x for x in pending if len(x)]
        out = np.zeros((len(pending), parts * 64), np.int64)
        if full:
            h, size = np.concatenate(full), np.array([len(x) for x in full])
            at = np.flatnonzero([len(x) for x in pending])
            for k in range(parts):
                out[at, 64 * k : 64 * k + 64] = bit_counts(mixed(h, k), np.cumsum(size) - size)
        ones.append(out)
        total.extend(map(len, pending))
        pending.clear()

    for x in hashes:
        pending.append(x)
        held += len(x)
        if held >= COUNT_BATCH:
            flush()
            held = 0
    flush()
    set_bits = 2 * np.concatenate(ones) > np.array(total, np.int64)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8")


def fingerprint_table(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, f0): the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            prints = fingerprints(shingle_hashes(t, size) for t in x["text"])
            yield pd.DataFrame({"doc_id": x["doc_id"], "f0": prints[:, 0].view(np.int64)})

    # doc_id travels as a string: pandas has no whole numbers with nulls
    picked = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary").alias("text"))
    out = picked.mapInPandas(run, "doc_id string, f0 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


class Forest:
    """Union-find that says whether a link joined two trees."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (y := self.up.get(root, root)) != root:
            root = y
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def near_pairs(prints: np.ndarray, groups: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index pairs of fingerprints within most bits that span the links of each run of equal groups."""
    edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    size = np.diff(edges)
    small = np.repeat(size <= SMALL, size)
    for step in range(1, min(SMALL, len(prints))):
        i = np.flatnonzero((groups[:-step] == groups[step:]) & small[:-step])
        if not len(i):
            break
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= most]
        yield from zip(i.tolist(), (i + step).tolist(), strict=True)
    for k in np.flatnonzero(size > SMALL):  # a search that visits each member once
        left, ahead = np.arange(edges[k], edges[k + 1]), []
        while len(left):
            if ahead:
                i = ahead.pop()
            else:
                i, left = int(left[0]), left[1:]
            close = np.bitwise_count(prints[left] ^ prints[i]) <= most
            last = i
            for n, j in enumerate(left[close].tolist()):  # short chains where they can be, so that no member has all links
                yield (last if n % 32 and int(prints[last] ^ prints[j]).bit_count() <= most else i), j
                ahead.append(j)
                last = j
            left = left[~close]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that span the links between fingerprints within MAX_BITS. distinct: rows (f0, ...)."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        mask = np.uint64((1 << BLOCK) - 1)
        for batch in batches:
            for k in range(0, len(batch), 4096):
                f = batch["f0"].to_numpy(np.int64)[k : k + 4096]
                x = f.view(np.uint64)
                at, anchor = covering_anchors(golay, (x & mask).astype(np.int64), ((x >> np.uint64(BLOCK)) & mask).astype(np.int64))
                yield pd.DataFrame({"anchor": anchor, "f0": f[at]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = Forest(), None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held["anchor"].iloc[-1] if len(held) else None
            whole = held["anchor"].to_numpy() != last  # the last anchor may go on in the next batch
            yield spanned(forest, held[whole])
            held = held[~whole]
        if held is not None:
            yield spanned(forest, held)

    def spanned(forest: Forest, x: pd.DataFrame) -> pd.DataFrame:
        f, out = x["f0"].to_numpy(np.int64), []
        for i, j in near_pairs(f.view(np.uint64), x["anchor"].to_numpy(), MAX_BITS):
            a, b = int(f[i]), int(f[j])
            if a != b and forest.join(a, b):
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    spread = distinct.select("f0").mapInPandas(replicate, "anchor long, f0 long")
    # an anchor's rows come to one task in order; only those of one anchor are held at once
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): links at 3 or fewer differing bits of 64, closed transitively.

    Null and empty texts have fingerprint zero and are linked like any other. component_id is the smallest
    doc_id that is reachable; null doc_ids never are it (null if there is no other). Repeated rows give
    repeated rows; an empty table gives none.
    """
    table = materialize(fingerprint_table(docs, size), "fingerprints")
    classes = materialize(table.groupBy("f0").agg(F.min("doc_id").alias("least")), "classes")
    found = materialize(components(links(classes)), "components")
    # fingerprints without links are their own components
    roots = classes.join(found.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("f0", "component_id")
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return table.join(named, "f0").select("doc_id", hexed.alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, component_id): groups of texts whose sets of word shingles are similar, closed transitively; see similar.

    component_id is the smallest doc_id of a group; null doc_ids never are it (null if there is no other). Null and
    empty texts form one group.
    """
    from . import similar

    rows = materialize(similar.grouped(docs, size, similarity), "groups")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each group one row stays, that with the smallest doc_id, null ids last, and of rows
    that share that id one. Null and empty texts form one group. docs may have any columns but _id, _k and _key."""
    from . import similar

    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    keep = similar.grouped(docs, size, similarity).groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("_id"), F.col("o.k").alias("_k"))
    out = docs.withColumn("_key", similar.text_key())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_k"))
    return out.join(keep, same, "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key")
