import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossgrain.functions.core import average_rank, finite, rounded, runs
from crossgrain.operators import factors, gates, ic, study
from crossgrain.sources import panel, tables
from crossgrain.streaming import bars as stream

DAY = dt.date(2020, 1, 1)


def made(codes=6, days=70, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(codes):
        close = 100 * np.cumprod(1 + r.normal(0, 0.02, days))
        for k in range(days):
            rows.append((DAY + dt.timedelta(k), c, float(close[k] * 0.99), float(close[k] * 1.02), float(close[k] * 0.97), float(close[k]), float(r.integers(1, 50)), 1000.0, 1.0))
    return rows


SCHEMA = "date date, code int, open double, high double, low double, close double, volume double, amount double, turnover double"


def test_factors_against_pandas(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = factors.macd(factors.labels(factors.base(df))).toPandas().sort_values(["code", "date"])
    for _, x in got.groupby("code"):
        c = x["close"].reset_index(drop=True)
        ret = c.pct_change()
        dif = c.ewm(span=12, min_periods=12).mean() - c.ewm(span=26, min_periods=26).mean()
        want = {
            "ret_5d": ret.rolling(5).sum(), "vol_10d": ret.rolling(10).std() * 15.8745, "ma_60": c.rolling(60).mean(), "macd_dif": dif,
            "macd_dea": dif.ewm(span=9, min_periods=9, ignore_na=True).mean(), "fwd_5d": ret.rolling(5).sum().shift(-5), "fwd_1d": ret.shift(-1),
        }
        for name, v in want.items():
            np.testing.assert_allclose(x[name].to_numpy(float), v.to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=name)


def test_streaks_and_null_rules(spark):
    flags = [True, True, False, True, None, True, True]
    df = spark.createDataFrame([(k, 1, f) for k, f in enumerate(flags)], "date int, code int, up boolean")
    got = [r["n"] for r in runs(df, "up", "n").orderBy("date").collect()]
    assert got == [1, 2, 0, 1, None, 1, 2]
    x = spark.createDataFrame([(1, float("nan")), (1, float("inf")), (1, 2.0), (1, 2.0), (1, 5.0), (1, None)], "date int, x double").withColumn("x", finite("x"))
    assert sorted(r[0] for r in x.select(average_rank("x")).collect() if r[0] is not None) == [1.5, 1.5, 3.0]


def test_newey_west_against_numpy(spark):
    r = np.random.default_rng(0)
    x = np.convolve(r.normal(0.02, 0.1, 205), [1, 0.6, 0.3])[:200]
    s = spark.createDataFrame([("a", "fwd_5d", DAY + dt.timedelta(k), float(v), 9) for k, v in enumerate(x)], "name string, horizon string, date date, ic double, n long")
    d = x - x.mean()
    var = d @ d / 200 + sum(2 * (1 - k / 11) * (d[k:] @ d[:-k]) / 200 for k in range(1, 11))
    assert ic.newey_west(s).first()["t_nw"] == pytest.approx(x.mean() / np.sqrt(var / 200))


def test_constant_sides_and_short_series(spark):
    rows = [(DAY, c, 1.0, float(c)) for c in range(5)] + [(DAY + dt.timedelta(1), c, float(c), float(c * c)) for c in range(5)]
    df = spark.createDataFrame(rows, "date date, code int, f double, fwd_1d double")
    s = ic.ic_series(df, ["f"], ["fwd_1d"]).collect()
    assert len(s) == 1 and s[0]["ic"] == pytest.approx(1.0)
    assert ic.newey_west(ic.ic_series(df, ["f"], ["fwd_1d"])).first()["t_nw"] == 0.0


def test_orthogonalisation_against_numpy(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 3))
    x[:, 0] += 2 * x[:, 1]
    df = spark.createDataFrame([(DAY, k, *map(float, v)) for k, v in enumerate(x)], "date date, code int, a double, b double, c double")
    got, left = ic.orthogonalised(df, "a", ["b", "c"])
    ranks = pd.DataFrame(x).rank().to_numpy()
    ranks -= ranks.mean(axis=0)
    want = ranks[:, 0] - ranks[:, 1:] @ np.linalg.lstsq(ranks[:, 1:], ranks[:, 0], rcond=None)[0]
    np.testing.assert_allclose([r["residual"] for r in got.orderBy("code").collect()], want, atol=1e-5)
    assert left == pytest.approx((want @ want) / (ranks[:, 0] @ ranks[:, 0]), abs=1e-6)
    assert ic.orthogonalised(df, "a", ["a"])[1] < 1e-3


def test_false_discovery(spark):
    s = spark.createDataFrame([(f"f{k}", "h", v, 400) for k, v in enumerate([0.2, 0.15, 0.01, 0.0])], "name string, horizon string, icir double, days long")
    got = ic.false_discovery(s).orderBy("name").collect()
    from math import erf, sqrt

    p = [2 * (1 - 0.5 * (1 + erf(v * 20 / sqrt(2)))) for v in (0.2, 0.15, 0.01, 0.0)]
    want = [min(p[j] * 4 / (j + 1) for j in range(k, 4)) for k in range(4)]
    np.testing.assert_allclose([r["q"] for r in got], want, atol=1e-6)


def test_gates_in_order(spark):
    assert gates.holdout_gate(5.0, 1.6) and not gates.holdout_gate(5.0, 1.4) and not gates.holdout_gate(5.0, -3.0) and not gates.holdout_gate(10.0, 1.9)


def test_deciles_with_equal_edges(spark):
    df = spark.createDataFrame([(DAY, k, 0.0 if k < 50 else float(k), 1.0) for k in range(100)], "date date, code int, x double, fwd_1d double")
    assert sum(r["rows"] for r in study.deciles(df, "x", "fwd_1d").collect()) == 100


def test_tables(spark, tmp_path):
    main = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "date int, code string, v int")
    main.write.parquet(str(tmp_path / "main"))
    tables.append_delta(spark.createDataFrame([(2, "b", 9, 1.5), (3, "c", 3, 2.5)], "date long, code string, v long, extra double"), str(tmp_path / "delta"), ["date", "code"])
    both = tables.scan(spark, str(tmp_path / "main"), str(tmp_path / "delta"))
    got = sorted((r["date"], r["code"], r["v"], r["extra"]) for r in tables.keep_last(both, ["date", "code"]).collect())
    assert got == [(1, "a", 1, None), (2, "b", 9, 1.5), (3, "c", 3, 2.5)]
    assert sorted(r["v"] for r in tables.keep_first(both, ["date", "code"]).collect()) == [1, 2, 3]
    tables.compact(spark, str(tmp_path / "delta"), str(tmp_path / "one"), ["date", "code"])
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2
    for k in range(2):
        tables.replace_parquet(main.withColumn("v", F.lit(k)), str(tmp_path / "swap"))
    assert spark.read.parquet(str(tmp_path / "swap")).first()["v"] == 1 and spark.read.parquet(str(tmp_path / "swap.bak")).first()["v"] == 0
    with pytest.raises(ValueError):
        tables.conforming(main, ["date", "w"])
    assert tables.conforming(main, ["v", "date"]).columns == ["v", "date"]
    assert [r["date"] for r in tables.not_done(main.select("date"), main.where("date = 1")).collect()] == [2]
    tables.write_csv(main.coalesce(1), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "date int, code string, v int").count() == 2
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "run_id": "r", "stage": "x"}\nbroken\n{"ts": "2", "run_id": "s", "stage": "y"}\n')
    log = lambda **k: tables.read_events(spark, str(tmp_path / "log.jsonl"), "ts string, run_id string, stage string", **k)
    assert log().count() == 2 and log(stage="x").count() == 1 and log(limit=1).first()["ts"] == "2"
    for k in range(5):
        tables.save_json(tmp_path / "doc.json", {"k": k, "schema_version": 2})
    assert tables.load_json(tmp_path / "doc.json", 2) == {"k": 4, "schema_version": 2, "version": 5}
    kept = {x.name: json.loads(x.read_text())["k"] for x in tmp_path.glob("doc.v*.bak")}
    last = json.loads((tmp_path / "doc.json").read_text())
    assert kept == {f"doc.v{last['version'] - n}.bak": last["k"] - n for n in (1, 2, 3)}
    with pytest.raises(ValueError):
        tables.load_json(tmp_path / "doc.json", 3)


def test_stream_of_bars_runs_the_batch_factors(spark, tmp_path):
    schema = "ts timestamp, code int, close double"
    rows = [(dt.datetime(2024, 1, 1 + k), c, 10.0 + k) for k in range(3) for c in (1, 2)]
    spark.createDataFrame([*rows, rows[0]], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.run_stream(stream.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "check"), lambda df, n: seen.append(df.count()))
    q.awaitTermination(120)
    assert sum(seen) == len(rows)


def test_rounding(spark):
    df = rounded(spark.createDataFrame([(-1e-9, 1)], "a double, b int"))
    assert str(df.first()["a"]) == "0.0" and df.columns == ["a", "b"]


def test_the_last_of_several_appends_stays(spark, tmp_path):
    """Four batches with the same keys, and one key twice in a batch: read over both tables, and merged."""
    main, delta, one = (str(tmp_path / n) for n in ("main", "delta", "one"))
    schema = "date long, code string, v long"
    spark.createDataFrame([(1, "a", -1), (9, "z", -9)], schema).write.parquet(main)
    for k in range(4):
        batch = spark.createDataFrame([(1, "a", 10 * k), (2, "b", k), (1, "a", 10 * k + 1)], schema).coalesce(1)
        assert tables.append_delta(batch, delta, ["date", "code"]) == k + 1
    want = {(1, "a"): 31, (2, "b"): 3}
    both = tables.keep_last(tables.scan(spark, main, delta), ["date", "code"])
    assert {(r["date"], r["code"]): r["v"] for r in both.collect()} == want | {(9, "z"): -9}
    tables.compact(spark, delta, one, ["date", "code"])
    merged = spark.read.parquet(one)
    assert merged.columns == ["date", "code", "v"]
    assert {(r["date"], r["code"]): r["v"] for r in merged.collect()} == want


def test_trades_are_packed_without_loss(spark):
    """Rows that three longs cannot hold travel as they are; the others as five columns."""
    at = lambda *x: dt.datetime(2020, 1, 6, *x)
    odd = [
        (1, at(), 5, 1, 7, 3.0, 100.25), (1, at(13, 5, 1, 7), 5, 1, 7, 3.0, 100.25), (1, at(), -5, 1, 7, 3.0, 100.25), (1, at(), 5, 99, 7, 3.0, 100.25),
        (2, at(), 5, 1, None, 3.0, 100.25), (2, at(), 5, 1, 7, 3.5, 100.25), (2, at(), 5, 1, 7, 3.0, 100.123), (None, at(), 1 << 62, 1, 7, 3.0, 100.25),
        (3, at(), 5, 1, 7, 2000.0, 1e300), (3, at(), 5, 1, 7, float("inf"), float("nan")), (3, dt.datetime(1950, 1, 2), 5, 1, 7, 1.0, -0.01), (4, at(), 5, None, 1 << 61, 1023.0, 0.0),
        (4, at(), 5, 1, 7, float("nan"), None),
    ]
    for stamp in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(odd, f"l_suppkey long, l_shipdate {stamp}, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double")
        got = panel.dealt(df, 3)
        assert got.dtypes == [(c, dict(df.dtypes)[c]) for c in got.columns]
        assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(*panel.TRADE_COLUMNS)
    got = panel.dealt(lines, 3)
    assert got.exceptAll(lines.select(*got.columns)).count() == 0 and got.count() == lines.count()
    sent = got._jdf.queryExecution().optimizedPlan().children().apply(0)
    assert [f.name() for f in sent.schema().fields()] == ["l_suppkey", "_row", "_a", "_b", "_c"]
    narrow = spark.createDataFrame(odd, "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").withColumn("l_quantity", F.col("l_quantity").cast("float"))
    assert panel.dealt(narrow, 3).dtypes == narrow.dtypes  # not packed
