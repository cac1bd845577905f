"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Measures per document are array expressions over its whole text. For each stratum (language) the rules' cutoffs are
tightened one step after the other, in an order that is fixed beforehand, as long as labelled good documents prove that all
rules together reject few of them: an exact (Clopper-Pearson) upper bound on the stratum's false rejection rate must stay under
RISK. The strata share the error level (Bonferroni); along the steps testing stops at the first failure (fixed
sequence), which needs no further correction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, materialize

STRATA = ("en", "de", "fr", "es")
#: Most that the rules may reject of a stratum's good documents, and the chance that any bound is wrong.
RISK, ERROR = 0.01, 0.05
#: Rules: share of symbols among word characters, of repeated lines, of words in repeated 8-word windows,
#: and mean word length. Cutoffs from lenient to strict; a document above one is rejected.
CUTOFFS = {
    "symbol_share": (0.50, 0.40, 0.30, 0.25, 0.20, 0.16, 0.13, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02),
    "dup_line_share": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10),
    "repeat_share": (0.30, 0.28, 0.26, 0.24, 0.22, 0.20, 0.18, 0.16, 0.14, 0.12, 0.10),
    "mean_word": (20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0),
}
WINDOW_WORDS = 8


def fence(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that the optimizer cannot copy into later expressions, so that it is made once."""
    return df.withColumn(name, F.explode(F.array(value)))


def measure(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Null or empty text: all zero. Words of a repeated 8-word window are found by sorting window hashes
    (64 bits, of the words' 64-bit hashes) within the document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("_t"))
    df = fence(df, "_w", F.array_remove(F.split("_t", WORD_BREAK), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = fence(df, "_l", lines)
    df = df.select(
        "doc_id", "lang", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    last = WINDOW_WORDS - 1
    df = fence(df, "_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")
    starts = F.sequence(F.lit(0), F.size("_h") - WINDOW_WORDS)
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW_WORDS)]))
    df = fence(df, "_g", F.when(F.size("_h") > last, grams).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    # only texts with a repeated window are sorted
    pairs = F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    empty = F.array().cast("array<struct<g:bigint,i:int>>")
    df = fence(df, "_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(pairs)).otherwise(empty)).drop("_g")
    g = lambda i: F.get("_s", i)["g"]
    same = lambda i: F.coalesce(g(i - 1) == g(i), F.lit(False)) | F.coalesce(g(i + 1) == g(i), F.lit(False))
    where = F.when(F.size("_s") > 0, F.filter(F.transform("_s", lambda x, i: F.when(same(i), x["i"])), lambda x: x.isNotNull()))
    df = fence(df, "_d", F.sort_array(F.coalesce(where, F.array().cast("array<int>")))).drop("_s")
    covered = F.aggregate(
        F.transform("_d", lambda x, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get("_d", i + 1) - x, F.lit(WINDOW_WORDS)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", covered).drop("_d")


def with_rules(df: DataFrame) -> DataFrame:
    """Adds the rules' values and the stratum; 0 where there are no words or lines."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return df.withColumns(
        {
            "stratum": F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "mean_word": share("word_chars", "n_words"),
        }
    )


def upper_bound(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which at most bad of n has a chance of level or more."""
    if n == 0 or bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]

    def tail(p: float) -> float:
        return sum(math.exp(c + k * math.log(p) + (n - k) * math.log1p(-p)) for k, c in enumerate(logs))

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > level else (low, mid)
    return high


def steps() -> list[tuple[str, float]]:
    """(rule, cutoff) in the order in which they are tried: every rule's first cutoff, then every rule's second."""
    longest = max(map(len, CUTOFFS.values()))
    return [(rule, cuts[j]) for j in range(longest) for rule, cuts in CUTOFFS.items() if j < len(cuts)]


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """The cutoff for each (stratum, rule); a pair without proof has none and rejects nothing.

    The holdout is every labelled good document (a doc_id with several labels counts by its smallest). No
    parameter of the rules is fitted to it but the cutoffs. What reaches the driver: one row per stratum and step.
    """
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id")
    order = steps()

    def first(rule: str) -> Column:
        """The first step at which this rule rejects a document."""
        out = F.lit(len(order))
        for k, cut in reversed([(k, cut) for k, (r, cut) in enumerate(order) if r == rule]):
            out = F.when(F.col(rule) > cut, F.lit(k)).otherwise(out)
        return out

    rejected = with_rules(measured).where("n_words > 0").join(good, "doc_id", "left_semi").select("stratum", F.least(*map(first, CUTOFFS)).alias("first"))
    counts: dict[str, list[int]] = {}
    for row in rejected.groupBy("stratum", "first").agg(F.count("*").alias("n")).collect():
        counts.setdefault(row["stratum"], [0] * (len(order) + 1))[row["first"]] = row["n"]
    level, found = error / (len(STRATA) + 1), {}
    for stratum, by_step in counts.items():
        n, bad = sum(by_step), 0
        for k, (rule, cut) in enumerate(order):
            bad += by_step[k]
            if upper_bound(bad, n, level) > risk:
                break
            found[stratum, rule] = cut
    return found


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule).

    Fails the base: under 20 words, or over 30 % of the words in repeated windows. Else the risk-controlled
    rules decide. Null or empty text: no words, not kept. Without labels no rule has a cutoff.
    """
    measured = materialize(measure(docs), "measures")
    cutoffs = choose_cutoffs(measured, labels, risk, error)
    failed = F.lit(None).cast("string")
    for (stratum, rule), cut in sorted(cutoffs.items(), reverse=True):
        failed = F.when((F.col("stratum") == stratum) & (F.col(rule) > cut), F.lit(rule)).otherwise(failed)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = with_rules(measured).withColumn("base_failed", base).withColumn("failed_rule", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule",
    )
