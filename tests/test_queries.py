"""Queries of each family against their SQL, and reading and writing of tables."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__
from quantloom.jobs.registry import ORACLES, QUERIES
from quantloom.operators import macro, risk, signals, significance
from quantloom.sources import tables

D = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents")


def rows(records, columns):
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[c]) for c in sorted(columns)) for r in records), key=repr)


@pytest.mark.parametrize("name", [
    "strategy_metrics", "strategy_tail_stats", "crisis_replay", "synthetic_shocks", "marginal_risk", "evaluate_risk", "fundamental_ratios", "panel_with_delistings", "option_chain", "adjusted_for_actions", "nearest_quotes", "annual_to_monthly",
    "composite_liquidity", "factor_formula_026", "factor_entropy", "newey_west", "ic_autocorrelation", "multiple_tests_by", "walk_forward_run", "best_combinations", "rebalance_costs_sqrt", "entries_exits", "headline_scores", "screen_composite", "option_measures", "vol_regime", "regime_backtest", "annual_ag",
])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    wanted = con.sql(ORACLES[name])
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got.collect(), wanted.columns) == rows([dict(zip(wanted.columns, r)) for r in wanted.fetchall()], wanted.columns)


def test_catalogue_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 250"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0], timeout=120)


def test_tables_are_read_and_written(spark, tmp_path):
    from pyspark.sql.types import StructType

    raw = spark.createDataFrame([("1", float("nan"), "x"), ("no", 2.5, None)], "ID string, Close double, other string")
    schema = StructType().add("id", "long").add("price", "double").add("gone", "string")
    got = tables.conform(raw, schema, {"close": "price"})
    assert got.columns == ["id", "price", "gone"] and sorted(map(tuple, got.collect()), key=repr) == [(1, None, None), (None, 2.5, None)]
    raw.write.option("header", True).csv(str(tmp_path / "csv"))
    assert tables.read_table(spark, str(tmp_path / "csv"), schema, {"close": "price"}, "csv").count() == 2
    panel = spark.createDataFrame([(1, dt.date(2020, m, 1), float(m)) for m in (1, 2)], "asset int, date date, close double")
    tables.write_panel(panel, str(tmp_path / "panel"))
    tables.write_panel(panel.where("close = 2").selectExpr("asset", "date", "9e0 as close"), str(tmp_path / "panel"))
    assert sorted(r["close"] for r in spark.read.parquet(str(tmp_path / "panel")).collect()) == [1.0, 9.0]
    for _ in range(2):
        tables.append_log(panel.selectExpr("asset", "'red' as level"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    tables.write_ranking(panel.selectExpr("asset", "close / 3 as score"), str(tmp_path / "ranking"))
    assert "0.333333" in "".join(p.read_text() for p in (tmp_path / "ranking").glob("*.csv"))
    bad = spark.createDataFrame([('{"headline": "a", "symbols": ["S", "T"], "created_at": "2024-01-01T00:00:00Z"}',), ("no json",)], "value string")
    assert tables.parse_news(bad).count() == 2


def test_headlines(spark):
    from pyspark.sql import functions as F

    texts = {"not strong": -0.5, "very weak": -0.75, "record profit": 0.75, "": 0.0, None: 0.0, "not very good profit": 0.25, "Strong, strong": 1.0, "never ever strong": 1 / 3}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", signals.score_headline(F.col("t")).alias("s"))
    assert {r["t"]: pytest.approx(r["s"]) for r in df.collect()} == texts


def test_gates_and_empty_tables(spark):
    values = spark.createDataFrame([("s", 1.6, -0.3, 1.0, None, 0.6)], "strategy string, sharpe double, max_drawdown double, calmar double, sortino double, win_rate double")
    checks = {r["name"]: r["passed"] for r in risk.gate_check(values).collect()}
    assert checks == {"sharpe": True, "max_drawdown": False, "calmar": False, "sortino": False, "win_rate": True}
    summary = {r["category"]: (r["gates"], r["passed"]) for r in risk.gate_summary(risk.gate_check(values)).collect()}
    assert summary == {"backtest": (5, 2), None: (5, 2)}
    none = spark.createDataFrame([], "strategy string, date date, r double")
    market = spark.createDataFrame([], "date date, m double")
    for df in (risk.metrics(none, market, 0.0), risk.tail_stats(none), risk.synthetic_shocks(none), risk.monthly_table(none), risk.kelly(none), macro.regime_z(none.selectExpr("strategy as series", "date", "r as x"))):
        assert df.count() == 0
    assert significance.multiple_tests(spark.createDataFrame([("a", None)], "factor string, p double"), "holm").first()["reject"] is False


def test_screens_rank_with_one_sort(spark):
    from pyspark.sql import functions as F

    values = [0.0, 0.0, 1.0, 1.0, -2.0, 5.0, 0.0, 1.0]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(values)] + [("b", 0, 3.0), ("b", 1, 0.0)], "date string, symbol int, x double")
    ranked = df.select("date", "symbol", signals.ranked_others("x", F.col("x") != 0, ["date"]).alias("s"))
    shares = df.select("date", "symbol", signals.share_rank("x", ["date"]).alias("s"))
    for out in (ranked, shares):
        assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    used = sorted(x for x in values if x)
    place = lambda x: 2 * (used.index(x) + (used.count(x) + 1) / 2) / len(used) - 1
    assert {(r["date"], r["symbol"]): r["s"] for r in ranked.collect()} == {("a", k): pytest.approx(place(x)) if x else 0.0 for k, x in enumerate(values)} | {("b", 0): 3.0, ("b", 1): 0.0}
