"""Packing token pieces into fixed windows by minimum bin slack.

1. Each document's ids are cut at multiples of the window; only the last piece is shorter.
2. The pieces are counted by length: at most one count per length up to the window, whatever the corpus.
3. From those counts the driver plans windows. The longest piece left opens a window; a bitset
   subset-sum program over the remaining lengths (an integer whose bit t says "t can be filled") finds the
   multiset that comes closest to capacity; backtracking yields how often each length is used; the pattern
   is repeated while its lengths last.
4. Each piece gets a rank among the pieces of its length (task by task, then prefix sums over tasks), and
   its rank and the plan determine window and offset. No group is ever gathered in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import WordTokenizer, tokenizer_path

WINDOW = 2048
END_ID = 1


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset from counts whose sum is the largest not above room."""
    full, reach, steps, before = (1 << (room + 1)) - 1, 1, [], []
    for size in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, part = min(counts[size], room // size), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((size, part))
            before.append(reach)
            reach |= (reach << (size * part)) & full
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for (size, part), had in zip(reversed(steps), reversed(before), strict=True):
        if not had >> at & 1:
            at -= size * part
            used[size] = used.get(size, 0) + part
    return used


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to count) with repetitions that use every piece once."""
    left, plan = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill(rest, window - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[size] // n for size, n in pattern.items())
        plan.append((pattern, times))
        for size, n in pattern.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
    return plan


def plan_table(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first window, count in a window, offset), by length and first rank."""
    used, rows, base = {}, [], 0
    for pattern, times in plan:
        offset = 0
        for size, n in sorted(pattern.items(), reverse=True):
            rows.append((size, used.get(size, 0), base, n, offset))
            used[size] = used.get(size, 0) + n * times
            offset += size * n
        base += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, path: str, window: int) -> DataFrame:
    """A row per piece, with the task that made it and its rank among the task's pieces of that length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, seen, task = WordTokenizer.of(path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tokens.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    size = len(piece) // 4
                    rows.append((doc_id, start, size, zlib.crc32(piece), total, seen[size]))
                    seen[size] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]).assign(task=task)

    # doc_id travels as a string: pandas has no whole numbers with nulls
    picked = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary").alias("text"))
    return picked.mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, rank long, task long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    Null texts are empty: a piece with the end id alone. Null doc_ids stay null; repeated rows are packed
    again; an empty table gives no rows. Windows whose pieces leave slack are padded by the reader.
    """
    pieces = materialize(cut_pieces(docs, path or tokenizer_path(), window), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most one row per length
    table = plan_table(plan_windows(totals, window))
    wide = 1 << 48

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = table[:, 0] * wide + table[:, 1]
        for x in batches:
            size, rank = x["length"].to_numpy(np.int64), x["rank"].to_numpy(np.int64)
            row = table[np.searchsorted(keys, size * wide + rank, side="right") - 1] if len(x) else table[:0]
            turn = rank - row[:, 1]
            x["sequence_id"], x["offset"] = row[:, 2] + turn // np.maximum(row[:, 3], 1), row[:, 4] + turn % np.maximum(row[:, 3], 1) * size
            yield x.drop(columns="rank")

    # the counts have a row for each task and length, so they grow with the corpus and are never broadcast
    ranked = pieces.join(counts.select("length", "task", "before").hint("shuffle_merge"), ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")
    )
    out = ranked.mapInPandas(place, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
