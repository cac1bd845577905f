"""Acceptance gates for candidates: cheap tests first, one result row per candidate.

Every gate reads aggregates of a whole batch of candidates; only those rows, one per candidate, reach the driver.
"""

from __future__ import annotations

from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import finite
from ..plans import dsl
from . import ic
from .ic import Limits


def sample_gate(df: DataFrame, names: list[str], label: str, least: float = 0.05, share: float = 0.15, seeds=(42, 7, 2024), min_days: int = 50) -> dict[str, dict]:
    """Median |ICIR| over seeded samples of dates; a candidate without a figure passes, marked open."""
    got: dict[str, list[float]] = {n: [] for n in names}
    for seed in seeds:
        s = ic.ic_summary(ic.ic_series(ic.sampled_dates(df, share, seed), names, [label]), min_days=min_days)
        for r in s.collect():
            if r["icir"] is not None:
                got[r["name"]].append(abs(r["icir"]))
    return {n: {"ok": not v or median(v) >= least, "open": not v, "icir": median(v) if v else None} for n, v in got.items()}


def coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, median_names, coverage): the median daily count of values, and the share of rows with one."""
    p = df.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), finite(n).alias("x")) for n in names])).alias("p")).select("date", "p.*")
    day = p.groupBy("name", "date").agg(F.count("x").alias("n"), F.count("*").alias("rows"))
    return day.groupBy("name").agg(F.median(F.col("n").cast("double")).alias("median_names"), (F.sum("n") / F.sum("rows")).alias("coverage"))


def main_gate(df: DataFrame, names: list[str], label: str, limits: Limits = Limits(), signs: dict[str, int] | None = None) -> DataFrame:
    """(name, ic_mean, icir, days, t_nw, median_names, coverage, ic_tradable, gap, ok). signs: 1 or -1 for candidates that declared one."""
    series = ic.ic_series(df, names, [label])
    whole = ic.ic_summary(series, min_days=limits.min_days).drop("horizon", "ic_pos_pct")
    t = ic.newey_west(series).select("name", "t_nw")
    domain = ic.ic_summary(ic.ic_series(ic.tradable(df), names, [label]), min_days=1).select("name", F.col("ic_mean").alias("ic_tradable"), F.col("icir").alias("icir_tradable"))
    out = whole.join(t, "name").join(coverage(df, names), "name").join(domain, "name", "left")
    gap = F.try_divide(F.abs(F.col("ic_mean") - F.col("ic_tradable")), F.abs("ic_mean"))
    ok = (
        (F.abs("t_nw") >= limits.min_t) & (F.col("median_names") >= limits.min_names)
        & (F.col("coverage") >= limits.min_coverage) & (F.coalesce(F.col("gap"), F.lit(0.0)) <= limits.max_gap)
    )
    for name, sign in (signs or {}).items():
        ok = ok & ((F.col("name") != name) | (F.col("ic_mean") * sign > 0))
    return out.withColumn("gap", gap).withColumn("ok", ok.cast("int"))


def holdout_gate(t_design: float, t_holdout: float) -> bool:
    """The same sign, and a holdout t of at least a fifth of the design's and of 1.5."""
    return t_design * t_holdout > 0 and abs(t_holdout) >= max(0.2 * abs(t_design), 1.5)


def full_exam(df: DataFrame, name: str, limits: Limits = Limits()) -> dict:
    """All tests in order; the first failure is named in ``failed``."""
    horizons = ["fwd_1d", "fwd_5d", "fwd_10d", "fwd_20d"]
    series = ic.ic_series(df, [name], horizons).persist()
    try:
        means = {r["horizon"]: r for r in ic.ic_summary(series, min_days=limits.min_days).collect()}
        main = means.get("fwd_5d")
        if main is None:
            return {"ok": False, "failed": "days"}
        t = {r["horizon"]: r["t_nw"] for r in ic.newey_west(series).collect()}["fwd_5d"]
        out = {"ic_mean": main["ic_mean"], "icir": main["icir"], "t_nw": t, "horizons": {h: r["ic_mean"] for h, r in means.items()}}
        sign = 1 if main["ic_mean"] > 0 else -1
        five = series.where("horizon = 'fwd_5d'")
        seg = ic.segment_check(five).first()
        mono = ic.monotonicity(df, name, "fwd_5d").first()
        fade = ic.decay(ic.ic_summary(series, min_days=1)).first()["decay"]
        plain = ic.ic_summary(ic.ic_series(df, [name], ["fwd_5d"], method="pearson"), min_days=limits.min_days).first()
        normal = plain["ic_mean"] if plain else None
        out |= {"extreme_driven": normal is not None and normal * main["ic_mean"] < 0 and abs(normal) >= 2 * abs(main["ic_mean"])}
        tests = {
            "t": abs(t) >= limits.min_t,
            "horizon signs": all(r["ic_mean"] * sign > 0 for r in means.values()),
            "decay": fade is None or fade <= limits.max_decay,
            "years": not any(r["conflict"] for r in ic.yearly(five).collect()),
            "segments": seg["right_share"] >= limits.min_segments and seg["recent_right"] == 1.0,
            "monotone": mono["rows"] is not None and mono["rows"] >= limits.min_rows and mono["monotone"] is not None and abs(mono["monotone"]) >= limits.min_monotone,
            "normal sign": normal is None or normal * main["ic_mean"] > 0 or out["extreme_driven"],
        }
        failed = next((k for k, ok in tests.items() if not ok), None)
        return out | {"tests": tests, "ok": failed is None, "failed": failed}
    finally:
        series.unpersist()


def static_gate(text: str, columns: list[str] | None = None, known: set[str] | None = None) -> str | None:
    """Why an expression is not worth a test: what the language doesn't allow, or an idea that was rejected before. known: skeleton hashes."""
    try:
        dsl.compile_expression(text, columns)
    except dsl.Rejected as e:
        return str(e)
    return "rejected before" if dsl.skeleton_hash(text) in (known or set()) else None


def funnel(
    design: DataFrame, holdout: DataFrame, names: list[str], label: str = "fwd_5d", limits: Limits = Limits(),
    known: set[str] | None = None, expressions: dict[str, str] | None = None, signs: dict[str, int] | None = None,
) -> list[dict]:
    """Runs a batch through all gates in order of cost. expressions: the candidates' texts, for the static gate, whose reason is given as
    ``why``; known: skeleton hashes of rejected ideas (see plans.dsl); signs: see main_gate."""
    out = {n: {"name": n, "gate": "accepted"} for n in names}
    for n, text in (expressions or {}).items():
        if n in out and (why := static_gate(text, design.columns, known)):
            out[n] |= {"gate": "static", "why": why}
    left = [n for n in names if out[n]["gate"] == "accepted"]
    if not left:
        return list(out.values())
    sampled = sample_gate(design, left, label)
    for n in left:
        out[n] |= {"sample_icir": sampled[n]["icir"], "open": sampled[n]["open"]}
        if not sampled[n]["ok"]:
            out[n]["gate"] = "sample"
    left = [n for n in left if sampled[n]["ok"]]
    main = {r["name"]: r.asDict() for r in main_gate(design, left, label, limits, signs).collect()} if left else {}
    for n in left:
        out[n] |= main.get(n, {})
        if not main.get(n, {}).get("ok"):
            out[n]["gate"] = "main"
    left = [n for n in left if out[n]["gate"] == "accepted"]
    for n in list(left):
        exam = full_exam(design, n, limits)
        out[n]["exam"] = exam
        if not exam["ok"]:
            out[n]["gate"] = "exam"
            left.remove(n)
    held = {r["name"]: r["t_nw"] for r in ic.newey_west(ic.ic_series(holdout, left, [label])).collect()} if left else {}
    for n in left:
        out[n]["t_holdout"] = held.get(n, 0.0)
        if not holdout_gate(out[n]["t_nw"], out[n]["t_holdout"]):
            out[n]["gate"] = "holdout"
    return list(out.values())
