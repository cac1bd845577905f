"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells (source stratum, language stratum, topic). The strata are those that the targets name and
one for the rest, so the table of cells is bounded by the targets, whatever the corpus. Cell token counts come
from one aggregation over all documents; the driver rakes them to the three marginals of the wanted total, with each cell
bounded by its tokens, turns the ratios of fitted to present tokens into sampling probabilities, and every document is
kept if a hash of its own id and text falls below its cell's probability. No document moves. A stratum with fewer tokens than its
target is kept whole and the others of its marginal share the rest; report() says by how much targets are missed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

REST = "other"
AXES = ("source_stratum", "lang_stratum", "topic")


@dataclass(frozen=True)
class Targets:
    """Token shares by marginal; what is not named falls under ``other``. Shares are scaled to sum to one."""

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.15, REST: 0.85})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.10, REST: 0.01})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.80, "table": 0.12, "note": 0.04, "noise": 0.04})
    #: Tokens to keep, as a share of all, and the seed of the draws.
    budget: float = 0.6
    seed: int = 20

    def marginals(self) -> list[dict[str, float]]:
        out = []
        for m in (self.source, self.lang, self.topic):
            total = sum(m.values())
            out.append({k: v / total for k, v in m.items()})
        return out


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic from the text's form: note (under 20 words), table (cells), noise (symbols), else prose."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    signs = F.length(text) - F.length(F.translate(text, "#*$%&<>!", ""))
    return (
        F.when(tokens < 20, "note")
        .when(10 * bars > tokens, "table")
        .when(2 * signs > tokens, "noise")
        .otherwise("prose")
    )


def strata(docs: DataFrame, targets: Targets, topic: Column | None = None) -> DataFrame:
    """Adds n_tokens, the three strata and u, the document's draw in [0, 1). Null counts as other or as empty text.

    topic: a column of one's own in place of the form of the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    name = lambda c, known: F.when(c.isin(*known), c).otherwise(REST)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text, F.lit(targets.seed))
    out = docs.withColumn("n_tokens", F.explode(F.array(tokens)))  # a generator, so that tokens are counted once
    return out.withColumns(
        {
            "source_stratum": name(F.col("source").cast("string"), list(targets.source)),
            "lang_stratum": name(F.col("lang").cast("string"), list(targets.lang)),
            "topic": name(topic if topic is not None else topic_of(text, F.col("n_tokens")), list(targets.topic)),
            "u": F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53)),
        }
    )


def rake(tokens: np.ndarray, marginals: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Fits a table of shares to marginals by turns. Targets of strata without tokens are shared out to the others."""
    fit = tokens / tokens.sum()
    wanted = []
    for axis, m in enumerate(marginals):
        present = tokens.sum(axis=tuple(k for k in range(tokens.ndim) if k != axis)) > 0
        m = np.where(present, m, 0.0)
        wanted.append(m / m.sum() if m.sum() else present / present.sum())
    for _ in range(rounds):
        worst = 0.0
        for axis, m in enumerate(wanted):
            have = fit.sum(axis=tuple(k for k in range(tokens.ndim) if k != axis))
            ratio = np.divide(m, have, out=np.zeros_like(m), where=have > 0)
            worst = max(worst, float(np.abs(have - m).max()))
            fit = fit * ratio.reshape([-1 if k == axis else 1 for k in range(tokens.ndim)])
        if worst < tolerance:
            break
    return fit


def probabilities(tokens: np.ndarray, fit: np.ndarray, budget: float) -> np.ndarray:
    """Chances in proportion to fit / tokens, at most one, whose expected tokens are budget x all if that can be."""
    ratio = np.divide(fit, tokens, out=np.zeros_like(fit), where=tokens > 0)
    wanted = budget * tokens.sum()
    low, high = 0.0, 1.0
    while (np.minimum(1, high * ratio) * tokens).sum() < min(wanted, (tokens * (ratio > 0)).sum()) * (1 - 1e-12) and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * tokens).sum() < wanted else (low, mid)
    return np.minimum(1, high * ratio)


def filled(most: np.ndarray, parts: np.ndarray, total: float) -> np.ndarray:
    """min(most, s x parts) with the s at which it sums to total, or to all that can be."""
    out, some = np.zeros(len(parts)), np.flatnonzero((parts > 0) & (most > 0))
    if not len(some):
        return out
    t, x = most[some], parts[some]
    order = np.argsort(t / x)
    t, x, place = t[order], x[order], some[order]
    left, rest = total - np.concatenate(([0.0], np.cumsum(t)[:-1])), np.cumsum(x[::-1])[::-1]
    s = left / rest  # if those before are full
    open_ = np.flatnonzero(s * x <= t)
    k = int(open_[0]) if len(open_) else len(t)
    out[place[:k]] = t[:k]
    if k < len(t):
        out[place[k:]] = np.maximum(0.0, s[k]) * x[k:]
    return out


def bounded(tokens: np.ndarray, marginals: list[np.ndarray], budget: float, rounds: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """Expected tokens by cell, at most what is there, with marginals nearest to the targets at budget x all tokens."""
    total, others = min(1.0, budget) * tokens.sum(), [tuple(k for k in range(tokens.ndim) if k != a) for a in range(tokens.ndim)]
    allowed = tokens.copy()
    for axis, m in enumerate(marginals):
        if (m * tokens.sum(axis=others[axis])).any():
            allowed = allowed * (m > 0).reshape([-1 if k == axis else 1 for k in range(tokens.ndim)])
    wanted = []
    for axis, m in enumerate(marginals):
        here = allowed.sum(axis=others[axis])
        wanted.append(filled(here, m if (m * here).any() else here, total))
    free = allowed.copy()  # the product of the factors, without the bounds
    for _ in range(rounds):
        worst = 0.0
        for axis, m in enumerate(wanted):
            for k, w in enumerate(m):
                at = tuple(slice(None) if a != axis else k for a in range(tokens.ndim))
                most, x = allowed[at].ravel(), free[at].ravel()
                worst = max(worst, abs(np.minimum(most, x).sum() - w))
                got = filled(most, x, w)
                inner = (got > 0) & (got < most * (1 - 1e-12))
                full = (x > 0) & (most > 0)
                if inner.any():
                    scale = float((got[inner] / x[inner])[0])
                else:  # all full, or nothing wanted
                    scale = max(1.0, float((most[full] / x[full]).max())) if full.any() and w > 0 else float(w > 0)
                free[at] = np.where(free[at] * scale > 0, np.clip(free[at] * scale, 1e-100, 1e100), 0.0)
        if worst < tolerance * max(1.0, total):
            break
    return np.minimum(allowed, free)


def cell_table(strata_df: DataFrame, targets: Targets) -> list[tuple[str, str, str, float, float]]:
    """(source, lang, topic, weight, probability) of each cell with tokens; at most one for each triple of targets."""
    marginals = targets.marginals()
    names = [sorted({*m, REST}) for m in marginals]
    tokens = np.zeros([len(n) for n in names])
    rows = strata_df.groupBy(*AXES).agg(F.sum("n_tokens").alias("n")).collect()  # bounded by the targets
    for r in rows:
        tokens[tuple(n.index(r[a]) for n, a in zip(names, AXES, strict=True))] += r["n"]
    if not tokens.sum():
        return [(r[0], r[1], r[2], 1.0, min(1.0, targets.budget)) for r in rows]
    fit = rake(tokens, [np.array([m.get(k, 0.0) for k in n]) for m, n in zip(marginals, names, strict=True)])
    kept = bounded(tokens, [np.array([m.get(k, 0.0) for k in n]) for m, n in zip(marginals, names, strict=True)], targets.budget)
    p = np.divide(kept, tokens, out=np.zeros_like(kept), where=tokens > 0)
    out = []
    for r in rows:
        at = tuple(n.index(r[a]) for n, a in zip(names, AXES, strict=True))
        empty = not tokens[at]  # cells of texts without words: there is nothing to weigh
        out.append((*(r[a] for a in AXES), 1.0 if empty else float(fit[at] / (tokens[at] / tokens.sum())), min(1.0, targets.budget) if empty else float(p[at])))
    return out


def report(docs: DataFrame, targets: Targets | None = None) -> list[tuple[str, str, float, float, float]]:
    """(axis, stratum, target, share of all tokens, expected share of the kept tokens) of each stratum."""
    targets = targets or Targets()
    kept = calibrated(docs, targets).groupBy(*AXES).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).collect()
    n, e = sum(r["n"] for r in kept) or 1, sum(r["e"] for r in kept) or 1.0
    out = []
    for axis, m in zip(AXES, targets.marginals(), strict=True):
        for k in sorted({*m, REST}):
            own = [r for r in kept if r[axis] == k]
            out.append((axis, k, m.get(k, 0.0), sum(r["n"] for r in own) / n, sum(r["e"] for r in own) / e))
    return out


def calibrated(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """docs' doc_id with n_tokens, strata, cell weight, probability, and sampled: whether the document is kept.

    Repeated rows share one draw. Cells whose target is zero are dropped. An empty table gives no rows.
    """
    targets = targets or Targets()
    named = strata(docs.select("doc_id", "text", "lang", "source"), targets, topic).drop("text", "lang", "source")
    named = materialize(named, "strata")  # so that texts are read once
    cells = cell_table(named, targets)
    weight, chance = F.lit(0.0), F.lit(0.0)
    if cells:
        table = F.create_map(*[x for s, g, t, w, p in cells for x in (F.lit(f"{s}\x00{g}\x00{t}"), F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")))])
        cell = table[F.concat_ws("\x00", *AXES)]
        weight, chance = cell["w"], cell["p"]
    out = named.withColumns({"weight": weight, "probability": chance})
    return out.select(F.col("doc_id").cast("long"), "n_tokens", *AXES, "weight", "probability", (F.col("u") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The documents that are kept, with their own columns alone."""
    targets = targets or Targets()
    plain = docs.select("doc_id", "text", "lang", "source")
    cells = cell_table(strata(plain, targets), targets)
    keep = F.lit(False)
    for s, g, t, _, p in cells:
        keep = F.when((F.col("source_stratum") == s) & (F.col("lang_stratum") == g) & (F.col("topic") == t), F.col("u") < p).otherwise(keep)
    carried = {c: f"_in{k}" for k, c in enumerate(docs.columns)}
    named = strata(docs.select("doc_id", "text", "lang", "source", *[F.col(c).alias(x) for c, x in carried.items()]), targets)
    return named.where(keep).select(*[F.col(x).alias(c) for c, x in carried.items()])
