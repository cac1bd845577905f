"""Groups of texts whose sets of word shingles are similar: candidates by anchor-point covering of SimHash fingerprints, then
exact Jaccard.

Texts with equal sets are one class, numbered by a hash of the set. A class's fingerprint has SETS x 46 bits, each 46 of which are replicated
to their anchors (two Golay codes, see simhash), and 64 bits for a check of their own. Classes that share an anchor and differ in
few enough check bits are candidates; a link is the exact Jaccard similarity of two sets, so no link is false.

Texts of similarity s differ in a share arccos(2 s / (1 + s)) / pi of their bits, 15 % at 0.8: 63 % of such pairs share an
anchor in one set, 98 % in one of four; at 0.85 99.6 %.

So that a large group of near copies does not bring all its pairs, links are sought in rounds. In each of the first ROUNDS a class is
tested against two candidates of other groups: that with the smallest number, by an order of the round, to which most of a
large group turn, and the closest one. The last round tests, of the classes that have candidates, every pair that is still in different
groups and shares one of its rarest shingles, as all similar pairs do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .simhash import BLOCK, SEED, Forest, Golay, covering_anchors, fingerprints, mixed, shingle_set

#: Sets of 46 bits, and 64-bit parts of a fingerprint: those for the sets, and one for the check.
SETS, PARTS = 4, 4
#: Check bits in which candidates may differ (9.7 are expected at 0.8, with a deviation of 2.9, so 99.9 % of such pairs
#: pass, and 0.02 % of unrelated ones).
MOST = 18
#: The same for all bits, in the last round (39.4 are expected at 0.8, with a deviation of 5.8).
MOST_OF_ALL = 58
#: Rarer shingles of a set that go along with each, so that a pair is made once.
EARLIER = 16
#: Rounds with two candidates for each class, and how many of a large group of one anchor are looked at for each of them.
ROUNDS, LOOK = 2, 32
#: Anchors of a set are dealt over 2^bits buckets, of about so many entries, and sent for so many classes at once.
LEAST_BITS, MOST_BITS, BUCKET, AT_ONCE = 13, 24, 1 << 16, 1 << 12
#: Shingles with more than this part of all rows are frequent: there are fewer than HOT of them.
HOT = 1 << 16
#: Entries of several buckets that are searched at once, at least.
TOGETHER = 1 << 18
ENTRY = np.dtype([("anchor", "<u4"), ("c", "<i8"), ("check", "<u8")])


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, k, c, bits): the text's key, its set's class and fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a in range(0, len(x), 512):
                y = x.iloc[a : a + 512]
                sets = [shingle_set(t, size) for t in y["text"]]
                c = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": y["doc_id"], "k": y["k"], "c": c, "bits": [r.tobytes() for r in fingerprints(sets, PARTS)]})

    picked = docs.select(F.col("doc_id").cast("string"), text_key().alias("k"), F.col("text").cast("string").cast("binary").alias("text"))
    out = picked.mapInPandas(run, "doc_id string, k long, c long, bits binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def entries(golay: Golay, c: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(set, entries) of all anchors of these classes; bits: a row of PARTS x 64 each."""
    flat = np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
    blocks = flat[:, : SETS * 2 * BLOCK].reshape(len(bits), SETS * 2, BLOCK).astype(np.int64) @ (1 << np.arange(BLOCK))
    for turn in range(SETS):
        at, anchor = covering_anchors(golay, blocks[:, 2 * turn], blocks[:, 2 * turn + 1])
        out = np.empty(len(at), ENTRY)
        out["anchor"], out["c"], out["check"] = anchor | (turn << 24), c[at], bits[at, PARTS - 1]
        yield turn, out


def dealt(classes: DataFrame, more: str | None = None) -> DataFrame:
    """Rows (bucket, data) with the entries of all classes' anchors; a class's number in column more, if any, goes along as data2."""
    width = (classes.count() * 61 // BUCKET).bit_length()
    width = min(max(width, LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        golay = Golay()
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                x = batch.iloc[a : a + AT_ONCE]
                c = x["c"].to_numpy(np.int64)
                bits = np.frombuffer(b"".join(x["bits"]), "<u8").reshape(-1, PARTS)
                root = dict(zip(c.tolist(), x[more].tolist(), strict=True)) if more else None
                for turn, found in entries(golay, c, bits):
                    # anchors are dealt by their hash, so that neighbours part
                    bucket = ((found["anchor"] & np.uint32(0xFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - width)
                    order = np.argsort(bucket, kind="stable")
                    found, edges = found[order], np.searchsorted(bucket[order], np.arange((1 << width) + 1))
                    full = np.flatnonzero(np.diff(edges))
                    out = {"bucket": (turn << width) + full, "data": [found[edges[k] : edges[k + 1]].tobytes() for k in full]}
                    if more:
                        numbers = np.fromiter(map(root.__getitem__, found["c"].tolist()), np.int64, len(found))
                        out["data2"] = [numbers[edges[k] : edges[k + 1]].tobytes() for k in full]
                    yield pd.DataFrame(out)

    return classes.mapInPandas(run, "bucket long, data binary" + (", data2 binary" if more else ""))


def by_bucket(found: DataFrame, f, form: str) -> DataFrame:
    """f(entries, roots) of whole buckets, as many as make TOGETHER entries, in the order of anchor and check. A root is a class's own
    number where none came along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, size = None, [], 0

        def done() -> pd.DataFrame:
            x = np.frombuffer(b"".join(r[0] for r in held), ENTRY)
            roots = np.frombuffer(b"".join(r[1] for r in held), "<i8") if len(held[0]) > 1 else x["c"]
            order = np.lexsort((x["c"], x["check"], x["anchor"]))
            return f(x[order], roots[order])

        for x in batches:
            for row in x.itertuples(index=False):
                if row[0] != now and size >= TOGETHER:
                    yield done()
                    held, size = [], 0
                now = row[0]
                held.append(row[1:])
                size += len(row[1]) // ENTRY.itemsize
        if held:
            yield done()

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, form)


def two_candidates(x: np.ndarray, root: np.ndarray, turn: int) -> pd.DataFrame:
    """Rows (a, order, b, bits, near): for each entry with a candidate of another root the candidate that is first in the round's
    order, and the closest. Of groups of one anchor beyond LOOK only the LOOK first ones and the LOOK next ones by check bits are
    looked at; their members come with order null too, so that none is taken for done."""
    n, c = len(x), x["c"]
    rank = mixed(c.view(np.uint64), 20 + turn) >> np.uint64(1)
    last = np.uint64(2**64 - 1)
    first, first_c = np.full(n, last), np.zeros(n, np.int64)
    near, near_c = np.full(n, 255, np.int64), np.zeros(n, np.int64)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        """Shows j to i; no i twice."""
        d = np.bitwise_count(x["check"][i] ^ x["check"][j]).astype(np.int64)
        ok = (d <= MOST) & (root[i] != root[j])
        i, j, d = i[ok], j[ok], d[ok]
        better = rank[j] < first[i]
        first[i[better]], first_c[i[better]] = rank[j[better]], c[j[better]]
        better = (d < near[i]) | ((d == near[i]) & (c[j] < near_c[i]))
        near[i[better]], near_c[i[better]] = d[better], c[j[better]]

    for step in range(1, min(LOOK, n - 1) + 1):
        i = np.flatnonzero(x["anchor"][:-step] == x["anchor"][step:])
        if not len(i):
            break
        meet(i, i + step)
        meet(i + step, i)
    edges = np.flatnonzero(np.concatenate(([True], x["anchor"][1:] != x["anchor"][:-1], [True])))
    size = np.diff(edges)
    large = np.flatnonzero(size > LOOK)
    for k in large:
        own = np.arange(edges[k], edges[k + 1])
        for j in own[np.argpartition(rank[own], LOOK)[:LOOK]]:
            meet(own, np.full(len(own), j))
    at = np.flatnonzero(near < 255)
    found = pd.DataFrame({"a": c[at], "order": first[at].view(np.int64), "b": first_c[at], "bits": near[at], "near": near_c[at]})
    more = c[np.concatenate([np.arange(edges[k], edges[k + 1]) for k in large] or [np.zeros(0, np.int64)])]
    return pd.concat([found.astype({"order": "Int64", "b": "Int64", "bits": "Int64", "near": "Int64"}), pd.DataFrame({"a": np.unique(more)})], ignore_index=True)


def some_candidates(classes: DataFrame, turn: int) -> DataFrame:
    """Rows (a, b, near): two candidates of each class (c, bits, root) that has any, null for others that may have some."""
    form = "a long, order long, b long, bits long, near long"
    got = by_bucket(dealt(classes, "root" if turn else None), lambda x, root: two_candidates(x, root, turn), form)
    best = got.groupBy("a").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("order", "b"))).alias("f"), F.min(F.when(F.col("b").isNotNull(), F.struct("bits", "near"))).alias("n"))
    return best.select("a", F.col("f.b").alias("b"), F.col("n.near").alias("near"))


def pairs_of(chosen: DataFrame) -> DataFrame:
    """Rows (a, b) of some_candidates, each pair once."""
    both = chosen.select("a", F.explode(F.array("b", "near")).alias("b")).where("b IS NOT NULL")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rare_pairs(active: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b): of the classes (c, bits, root) those of different roots that can still be similar.

    Two sets of this similarity share one of their rarest shingles: of n in order of frequency one of the first n - ceil(similarity n) + 1.
    From there on both must have enough shingles left for the overlap. So texts of a large group that have too much of their own are not
    compared with all of it. Frequent
    shingles, of which there are fewer than HOT, are broadcast, so that no task gets all rows of one.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a in range(0, len(x), 512):
                y = x.iloc[a : a + 512]
                held = [np.frombuffer(b, "<i8") for b in y["shingles"]]
                if sum(map(len, held)):
                    yield pd.DataFrame({k: np.repeat(y[k].to_numpy(np.int64), [len(h) for h in held]) for k in ("c", "root")} | {"h": np.concatenate(held)})

    rows = sets.join(active.select("c", "root"), "c").mapInPandas(cut, "c long, root long, h long")
    size = (F.length("shingles") / 8).cast("long")
    total = sets.agg(F.sum(size)).first()[0] or 0
    # what one group alone has is shared by no pair
    shared = materialize(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("h", "n"), "shared")
    hot = F.broadcast(shared.where(F.col("n") > total / HOT))
    rest = rows.join(hot.select("h"), "h", "left_anti").join(shared.where(F.col("n") <= total / HOT).hint("merge"), "h")
    both = rows.join(hot, "h").select("c", "h", "n").union(rest.select("c", "h", "n"))
    listed = both.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("l")).join(sets.select("c", size.alias("size")), "c")
    # shingles of one group alone come first of all
    take = F.size("l") + 1 - F.ceil(similarity * F.col("size") - 1e-9)
    parts = [F.conv(F.hex(F.substring("bits", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"bits{k}_") for k in range(PARTS)]
    rare = listed.where(take > 0).select("c", "size", "l", F.posexplode(F.slice("l", F.lit(1), take.cast("int"))).alias("at", "s"))
    first = F.greatest(F.col("at") + 1 - EARLIER, F.lit(1))
    earlier = F.slice("l", first, F.col("at") + 1 - first)["h"]
    rare = rare.select("c", "size", "s.h", (F.size("l") - F.col("at")).cast("long").alias("left"), earlier.alias("earlier"))
    rare = materialize(rare.join(active.select("c", "root", *parts), "c"), "rare")
    one, two = (rare.select("h", *[F.col(x).alias(x + k) for x in rare.columns if x != "h"]) for k in "12")
    near = sum(F.bit_count(F.col(f"bits{k}_1").bitwiseXOR(F.col(f"bits{k}_2"))) for k in range(PARTS)) <= MOST_OF_ALL
    # from the first shingle that two sets share on, no more are shared than either has left; pairs are made there (later, and so more
    # than once, only if they share one more than EARLIER places before)
    enough = F.least("left1", "left2") >= similarity / (1 + similarity) * (F.col("size1") + F.col("size2")) - 1e-9
    met = one.join(two.hint("merge"), (one["h"] == two["h"]) & (F.col("c1") < F.col("c2")) & (F.col("root1") != F.col("root2")) & near & enough & ~F.arrays_overlap("earlier1", "earlier2"))
    return met.select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()


def shingle_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Rows (c, shingles): the sets of the wanted classes, from one text of each."""
    named = classes.join(wanted, "c", "left_semi").select("c", F.col("doc_id").alias("_id"), F.col("k").alias("_k"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), F.col("text").cast("string").cast("binary").alias("text"))
    picked = texts.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k"))).select("c", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a in range(0, len(x), 512):
                y = x.iloc[a : a + 512]
                yield pd.DataFrame({"c": y["c"], "shingles": [shingle_set(t, size).tobytes() for t in y["text"]]})

    return materialize(picked.dropDuplicates(["c"]).mapInPandas(cut, "c long, shingles binary"), "sets")


def judged(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs, and whether their sets have this Jaccard similarity at least (same)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            same = []
            for one, two in zip(x["one"], x["two"], strict=True):
                both = len(np.intersect1d(np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64), assume_unique=True))
                same.append(both >= similarity * ((len(one) + len(two)) // 8 - both) - 1e-9)
            yield x.drop(columns=["one", "two"]).assign(same=np.array(same, bool))

    one, two = sets.toDF("a", "one"), sets.toDF("b", "two")
    joined = pairs.join(one, "a").join(two, "b").select(*pairs.columns, "one", "two")
    form = ", ".join(f"{n} {t}" for n, t in pairs.dtypes)
    return joined.mapInPandas(run, f"{form}, same boolean")


def spanning(links: DataFrame) -> DataFrame:
    """Of the edges (a, b) those that join two trees of their task: no more than it has nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for x in batches:
            yield x[[forest.join(a, b) for a, b in zip(x["a"].tolist(), x["b"].tolist(), strict=True)]]

    return links.select("a", "b").mapInPandas(run, "a long, b long")


def grouped(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Rows (doc_id, k, root): the key of each row's text, and a number of its group."""
    rows = materialize(sketches(docs, size), "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k")  # null ids last
    classes = rows.groupBy("c").agg(F.min(order).alias("o"), F.first("bits").alias("bits"))
    classes = materialize(classes.select("c", "o.doc_id", "o.k", "bits"), "classes")
    links, tested, roots = None, None, None
    active = classes.select("c", "bits", F.col("c").alias("root"))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            chosen = materialize(some_candidates(active, turn), "chosen")
            if not chosen.head(1):
                break
            pairs, sets = pairs_of(chosen), None
        else:
            sets = shingle_sets(docs, classes, active, size)
            pairs = rare_pairs(active, sets, similarity)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.head(1):
            continue
        if sets is None:
            sets = shingle_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), size)
        found = spanning(judged(pairs, sets, similarity).where("same"))
        links = materialize(found if links is None else links.union(found), "links")
        roots = materialize(components(links), "roots").withColumnRenamed("node", "c")
        if turn < ROUNDS:
            tested = pairs if tested is None else tested.union(pairs)
            left = classes.join(chosen.select(F.col("a").alias("c")), "c", "left_semi").join(roots, "c", "left")
            active = materialize(left.select("c", "bits", F.coalesce("root", "c").alias("root")), "active")
    if roots is None:
        return rows.select("doc_id", "k", F.col("c").alias("root"))
    return rows.select("doc_id", "k", "c").join(roots, "c", "left").select("doc_id", "k", F.coalesce("root", "c").alias("root"))
