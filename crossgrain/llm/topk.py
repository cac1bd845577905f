"""Exact top-k by inner product with vector-approximation files.

Vectors come in blocks. For a block a vector-approximation file is made: every component is quantised
to a cell of 2^BITS equal ones of its dimension's range, and kept as one byte. For a query, a cell's centre and
half width bound the inner product from above and below. The k-th largest lower bound, or the k-th result so far,
discards vectors; the others' exact products are taken, so the result is exact.

Vectors are dealt over tasks, each once for every GROUP queries, and every query goes to all tasks. A task holds the queries
of one group, streams its vectors past them in small batches, and returns the best k rows that it met for each query; the
best k of those are kept. So no row, batch or task grows with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 6
#: Vectors in a block, queries that meet it at once, and queries that a task holds.
ROWS, QUERIES, GROUP = 8192, 512, 1 << 18
#: Exact products that are taken at once.
PRODUCTS = 1 << 16
SCALE = 1024.0
#: Products of whole numbers below this sum exactly in doubles, and below that in 64-bit integers.
EXACT, WHOLE = 2.0**53, 2.0**62
#: Components above this are beyond bounds in single precision; all their products are taken.
LARGE = 1e15
LONG = 2**63 - 1
#: The score and id of places that are not taken yet.
NO_SCORE, NO_ID = -LONG - 1, LONG


def matrix(small: pa.Array, large: pa.Array) -> np.ndarray:
    """The vectors as rows; each is in one of the columns, and null in the other. Shorter ones are padded with zeros, which add
    nothing to a product."""
    n = len(small)
    sizes, values = [], []
    for part in (small, large):
        sizes.append(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        values.append(part.flatten().to_numpy(zero_copy_only=False))
    width = int(max(sizes[0].max(initial=0), sizes[1].max(initial=0)))
    out = np.zeros((n, width), np.float64 if len(values[1]) else np.int16)
    for size, v in zip(sizes, values, strict=True):
        out[np.arange(width)[None] < size[:, None]] = v
    return out


def padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def joined(parts: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in parts)
    return np.concatenate([padded(m, width) for m in parts])


class ApproximationFile:
    """Cells of a block's components, and the bounds that they give."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        self.vectors = vectors
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = np.maximum((high - low) / (1 << bits), np.maximum(np.abs(low), np.abs(high)) * 1e-12)
        self.width[self.width == 0] = 1.0
        self.low = low
        self.cells = np.clip((vectors - low) / self.width, 0, (1 << bits) - 1).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates by query and vector, the most that each query's estimates are off)."""
        centres = (self.cells.astype(np.float32) + 0.5) * self.width.astype(np.float32) + self.low.astype(np.float32)
        centre = queries.astype(np.float32) @ centres.T
        off = np.abs(queries) @ (self.width / 2)
        size = np.abs(queries) @ (np.maximum(np.abs(self.low), np.abs(self.low + self.width * 256)) + 1)
        # the second term covers rounding in single precision: a part in 2^24 at each of a product's sums
        return centre, off + max(1e-5, (len(self.low) + 8) * 2.0**-23) * size

    def top(self, query: np.ndarray, own: np.ndarray, centre: np.ndarray, off: float, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the query's best k, by score and smaller id; rows in own take no part."""
        centre = np.where(own, -np.inf, centre)
        there = len(ids) - int(own.sum())
        if not there:
            return np.zeros(0, np.int64), np.zeros(0)
        k = min(k, there)
        kth_low = np.partition(centre, len(centre) - k)[len(centre) - k] - off
        maybe = np.flatnonzero(centre + off >= kth_low)
        maybe = maybe[np.argsort(-centre[maybe], kind="stable")]
        got = np.zeros(0)
        at = 0
        while at < len(maybe):  # ties at the k-th score are read too
            if len(got) >= k and np.partition(got, len(got) - k)[len(got) - k] > centre[maybe[at]] + off:
                break
            step = maybe[at : at + 4 * k]
            got = np.concatenate((got, exact_products(self.vectors[step], query)))
            at += len(step)
        seen = maybe[:at]
        best = np.lexsort((ids[seen], -got))[:k]
        return seen[best], got[best]


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    most = float(np.abs(query).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, len(query))
    if most < EXACT:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors], dtype=object)


def pair_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a with those of b, whole numbers, as the nearest longs."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if most < WHOLE:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    whole = (sum(int(x) * int(y) for x, y in zip(v, w, strict=True)) for v, w in zip(a, b, strict=True))
    return np.array([max(-LONG, min(LONG, s)) for s in whole], np.int64)


class Best:
    """The best k rows so far of each query, by score and smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.queries, self.k = ids[order], queries[order], k
        self.scores = np.full((len(ids), k), NO_SCORE, np.int64)
        self.found = np.full((len(ids), k), NO_ID, np.int64)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Takes in a block of vectors."""
        width = max(self.queries.shape[1], vectors.shape[1])
        self.queries, vectors = padded(self.queries, width), padded(vectors, width)
        real = vectors.astype(np.float64)
        file = ApproximationFile(real)
        large = np.abs(real).max(initial=0) > LARGE
        place = np.searchsorted(self.ids, ids)
        own = np.flatnonzero(self.ids[np.minimum(place, len(self.ids) - 1)] == ids)
        for a in range(0, len(self.ids), QUERIES):
            b = min(a + QUERIES, len(self.ids))
            queries = self.queries[a:b].astype(np.float64)
            if large or np.abs(queries).max(initial=0) > LARGE:
                centre, off = np.zeros((b - a, len(ids)), np.float32), np.full(b - a, np.inf)
            else:
                centre, off = file.bounds(queries)
            mine = own[(place[own] >= a) & (place[own] < b)]
            centre[place[mine] - a, mine] = -np.inf
            least = self.least(centre, off, a, b)
            near = np.nextafter((least - off).astype(np.float32), np.float32(-np.inf))[:, None]
            q, v = np.nonzero((centre >= near) & (centre > -np.inf))
            for c in range(0, len(q), PRODUCTS):
                some, at = q[c : c + PRODUCTS] + a, v[c : c + PRODUCTS]
                self.add(some, ids[at], pair_products(self.queries[some], vectors[at]))

    def least(self, centre: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
        """What a score must reach: the k-th so far, or the k-th largest lower bound here, of queries a to b."""
        kth = self.scores[a:b, -1]
        out = np.where(kth == NO_SCORE, -np.inf, np.nextafter(kth.astype(np.float64), -np.inf))
        open_ = np.flatnonzero(kth == NO_SCORE)
        n = centre.shape[1]
        if len(open_) and n >= self.k:
            low = np.partition(centre[open_], n - self.k, axis=1)[:, n - self.k]
            out[open_] = np.where(np.isfinite(off[open_]), low - off[open_], -np.inf)
        return out

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows (query's place, id, score) that may be among the best; q is in order."""
        k = self.k
        better = (scores > self.scores[q, -1]) | ((scores == self.scores[q, -1]) & (ids < self.found[q, -1]))
        q, ids, scores = q[better], ids[better], scores[better]
        if not len(q):
            return
        which = np.unique(q)
        q = np.concatenate((q, np.repeat(which, k)))
        ids, scores = np.concatenate((ids, self.found[which].ravel())), np.concatenate((scores, self.scores[which].ravel()))
        order = np.lexsort((ids, ~scores, q))  # ~ turns the order of longs round without overflow
        first = np.searchsorted(q[order], which)
        take = order[first[:, None] + np.arange(k)]
        self.scores[which], self.found[which] = scores[take], ids[take]

    def rows(self, step: int = 1 << 13) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), step):
            taken = self.scores[a : a + step] != NO_SCORE
            q = np.repeat(self.ids[a : a + step], taken.sum(axis=1))
            yield pa.record_batch([pa.array(q), pa.array(self.found[a : a + step][taken]), pa.array(self.scores[a : a + step][taken])], names=["query_id", "vec_id", "score"])


def usable(x: Column) -> Column:
    """True for vectors that are not null and hold finite numbers alone."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest integer inner products.

    vectors: (vec_id, embedding). Components become floor(scale * x). Vectors that are null, or that hold
    null or non-finite components, and rows with a null id take no part. Candidates are all rows but those with
    the query's id. Fewer than k: all of them. Ties go to smaller ids. A shorter vector counts as padded with zeros.
    A query id that occurs in several rows is asked once, with its smallest vector; repeated candidates count one by one.
    Scores beyond a long are given as the nearest long.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(x))
    rows = rows.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("double")).alias("v"), is_query.alias("_q"))
    single = rows.where("_q").groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, -(-rows.where("_q").select("vec_id").distinct().count() // GROUP))
    tasks = max(8, 3 * spark.sparkContext.defaultParallelism)
    # a row goes to one task of each group, a query to all tasks of one group
    task, group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(tasks)).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    fits = F.forall("v", lambda v: F.abs(v) < 2**15)
    data = ["vec_id", F.when(fits, F.col("v").cast("array<smallint>")).alias("small"), F.when(~fits, F.col("v")).alias("large")]
    asked = single.select(*data, F.explode(F.sequence(group * tasks, group * tasks + (tasks - 1))).alias("_k"), F.lit(False).alias("met"))
    met = rows.select(*data, F.explode(F.sequence(task, task + (groups - 1) * tasks, F.lit(tasks))).alias("_k"), F.lit(True).alias("met"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n, best = [], [], 0, None

        def taken() -> tuple[np.ndarray, np.ndarray]:
            nonlocal n
            out = np.concatenate(ids), joined(parts)
            ids.clear(), parts.clear()
            n = 0
            return out

        for batch in batches:
            split = batch.num_rows - batch["met"].true_count  # queries come first
            for part in (batch.slice(0, split), batch.slice(split)):
                if part.num_rows and best is None and ids and part["met"][0].as_py():
                    best = Best(*taken(), k)
                if best is None and part.num_rows and part["met"][0].as_py():
                    continue  # no queries
                for a in range(0, part.num_rows, ROWS):
                    some = part.slice(a, ROWS)
                    ids.append(some["vec_id"].to_numpy(zero_copy_only=False))
                    parts.append(matrix(some["small"], some["large"]))
                    n += some.num_rows
                    if best is not None and n >= ROWS:
                        best.meet(*taken())
        if best is not None:
            if ids:
                best.meet(*taken())
            yield from best.rows()

    dealt = asked.unionByName(met).repartitionById(tasks * groups, F.col("_k")).sortWithinPartitions("met").select("vec_id", "small", "large", "met")
    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
