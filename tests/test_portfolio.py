import datetime as dt

import pandas as pd
import pytest

from crossgrain.operators import gates, live, portfolio as P
from crossgrain.plans import dsl

DAY = dt.date(2024, 1, 1)


def path(closes, score=1.0, code="a", ma=(0.0, 0.0), buyable=(0,)):
    before, rows = None, []
    for k, c in enumerate(closes):
        if c is not None:
            ret = c / before - 1 if before else 0.0
            rows.append({"date": DAY + dt.timedelta(k), "code": code, "close": c, "ret_1d": ret, "ma_20": ma[0], "ma_60": ma[1], "score": score, "buyable": k in buyable, "market_open": True})
            before = c
    return rows


RULES = P.Rules(gate=False)


@pytest.mark.parametrize("closes,reason,day,ma", [
    ([10.0, 9.9, 9.5], "stop", 2, (0, 0)), ([10.0, 10.2, 10.7], "take", 2, (0, 0)), ([10.0, 10.4, 10.1], "protect", 2, (0, 0)),
    ([10.0, 10.1], "ma60", 1, (0, 20)), ([10.0, 10.1, 10.15, 10.1, 10.15, 10.2], "time", 5, (0, 0)), ([10.0, 10.1, 10.1], "end", 2, (0, 0)),
    ([10.0, 10.1, 8.9, 8.85], "stop", 3, (0, 0)),
])
def test_exits(closes, reason, day, ma):
    (trade,) = P.replay(pd.DataFrame(path(closes, ma=ma)), RULES)
    assert trade[-2] == reason and trade[3] == DAY + dt.timedelta(day) and trade[-1] == day


def test_half_then_rest_under_the_short_mean():
    got = P.replay(pd.DataFrame(path([10.0, 10.1, 10.1], ma=(20.0, 0.0))), RULES)
    assert [(t[-2], t[5]) for t in got] == [("ma20 half", 200), ("ma20", 300)] or [(t[-2], t[5]) for t in got] == [("ma20 half", 250), ("ma20", 250)]


def test_cash_and_fees_add_up():
    buy = 10.0 * (1 + 0.001)
    (t,) = P.replay(pd.DataFrame(path([10.0, 10.7])), RULES)
    shares = int(5000 / 10 / 100) * 100
    sell = 10.7 * (1 - 0.003)
    fee = max(5, shares * sell * 0.00025) + shares * sell * 0.0005 + max(5, shares * buy * 0.00025)
    assert t[5] == shares and t[2] == pytest.approx(buy) and t[4] == pytest.approx(sell)
    assert t[6] == pytest.approx(shares * (sell - buy) - fee)


def test_slots_hold_and_missing_data():
    rows = [r for k in range(6) for r in path([10.0] * 3, score=10 - k, code=f"c{k}", buyable=(0, 1, 2))]
    held = {t[0] for t in P.replay(pd.DataFrame(rows), P.Rules(gate=False, capital=1e6))}
    assert held == {"c0", "c1", "c2", "c3"}
    rows = path([10.0, None, None]) + path([5.0] * 3, code="b", buyable=())
    (t,) = P.replay(pd.DataFrame(rows), RULES)
    assert t[-2] == "end without data"
    (t,) = P.replay(pd.DataFrame(path([10.0, 12.0, 14.0, 14.5])), P.Rules(gate=False, hold=3))
    assert t[-2] == "hold" and t[-1] == 3


def test_configurations_run_side_by_side(spark):
    df = spark.createDataFrame(pd.DataFrame(path([10.0, 10.7, 10.8, 10.9]))).selectExpr("*", "0 AS is_suspended", "0 AS limit_up", "0 AS limit_down", "0.5 AS price_pos_20")
    got = {r["config"]: r for r in P.metrics(P.simulate(df, P.grid(RULES, take=[0.06, 0.5]))).collect()}
    assert set(got) == {0, 1} and got[0]["trades"] >= 1


def test_weights_and_decisions():
    pool = [{"name": n, "icir": v} for n, v in (("a", 0.5), ("b", 0.2), ("c", 0.05))]
    assert live.weights(pool) == {"a": 0.1, "b": 0.05, "c": 0.02}
    assert live.weights(pool + [{"name": "d", "icir": 0.9, "short_lived": True}])["d"] == 0.04
    many = live.weights([{"name": f"f{k}", "icir": 0.3} for k in range(20)])
    assert sum(many.values()) == pytest.approx(0.5, abs=0.01) and len(many) == 20
    assert live.weights([]) == {}
    assert live.portfolio_decision(0.6, -1.0, 9, 1) == "enabled" and live.portfolio_decision(0.6, -1.0, 30, 1) == "rejected: validation"
    assert live.portfolio_decision(0.1, 5.0, 30, 100) == "rejected: training"


def test_sequential_test(spark):
    rows = [("up", 0.02)] * 60 + [("down", -0.02)] * 60 + [("few", 0.0)]
    got = {r["factor"]: r["state"] for r in live.sprt(spark.createDataFrame(rows, "factor string, ret double"), 0.02, 0.02, "factor").collect()}
    assert got == {"up": "confirmed", "down": "rejected", "few": "open"}


def test_ledger():
    book = live.Ledger()
    book.add("a", 10.0, 300, "2024-01-01", "s1|s2")
    for bad in (("a", 10.0, 100), ("b", 10.0, 150), ("b", 100.0, 100)):
        with pytest.raises(ValueError):
            book.add(*bad, "2024-01-02")
    assert book.sell("a", 11.0, "2024-01-05")["pnl_pct"] == pytest.approx(0.1) and not book.positions


def test_pool_health():
    assert live.pool_health([]) == 100.0
    pool = [{"enabled": k < 2, "icir": 0.15, "half_life": 6 if k else None} for k in range(4)]
    assert live.pool_health(pool) == 30 * 0.2 + 30 * 0.5 + 20 * 0.5 + 20
    assert live.pool_health(pool, -51.0) == live.pool_health(pool) - 10
    assert live.pool_health([{"enabled": True, "half_life": None}]) == 3.0 + 20


def test_static_gate():
    text = "col('close').rolling_mean(5).over('code')"
    assert gates.static_gate(text, ["close"]) is None
    assert gates.static_gate("col('fwd_5d')", ["close", "fwd_5d"])
    assert gates.static_gate(text.replace("5", "20"), ["close"], {dsl.skeleton_hash(text)}) == "rejected before"


def test_rows_in_reach_give_the_trades_of_the_whole_panel(spark):
    """Ties, codes that are never in reach, dates without buyable rows, gated dates; fewer rows reach a configuration than the panel has."""
    import numpy as np

    r, rows = np.random.default_rng(5), []
    for k in range(40):
        closes = np.round(10 * np.cumprod(1 + r.normal(0, 0.03, 30)), 2)
        for x in path([None if r.random() < 0.1 else float(c) for c in closes], score=float(r.integers(0, 6)) - (20 if k > 15 else 0), code=f"c{k}", buyable=set(range(30)) - {4, 5, 6}):
            rows.append(x | {"score": x["score"] + float(r.integers(0, 3)), "market_open": (x["date"] - DAY).days % 7 != 3})
    whole = pd.DataFrame(rows)
    configs = P.grid(P.Rules(capital=9000.0), gate=[True, False], hold=[0, 3], strict_slots=[True, False], slots=[2, 4])
    want = sorted((k, *t[:3], *t[-2:]) for k, c in enumerate(configs) for t in P.replay(whole, c))
    df = spark.createDataFrame(rows)
    days = df.select("date", "market_open").distinct()
    for got in (P.simulate(df, configs), P.simulate(df.drop("market_open", "score"), configs, days, df.select("date", "code", "buyable", "score"))):
        trades = got.collect()
        assert sorted((t["config"], t["code"], t["buy_date"], t["buy_price"], t["reason"], t["held_days"]) for t in trades) == want
    bought = {t["code"] for t in trades}
    assert len(bought) < 30 and P.reachable(configs[-1]) == 6
