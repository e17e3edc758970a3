"""Registered factor queries against their SQL, and the rules of frames and ranks."""

import duckdb
import pytest

import __spark_entry__
from quantloom.functions.frames import compound, cs_rank, roll
from quantloom.jobs.registry import FLAGSHIP, ORACLES, QUERIES
from quantloom.sources.panels import densify

D = "/root/testdata/sf0.001"


def rows(records, columns):
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[c]) for c in sorted(columns)) for r in records), key=repr)


@pytest.mark.parametrize("name", ["panel_month", "factor_momentum_12_1", "factor_volume_surge", "factor_beta_adjusted_momentum", "factor_frog_in_pan", "factor_skewness_12m", "factor_beta_market", "factor_kyle_lambda", "factor_garman_klass_vol", "factor_roll_spread", "factor_formula_002", "factor_formula_040", "factor_formula_055", "ic_decay_momentum", "top_k_momentum", "quantile_returns_momentum", "market_drawdown", "market_tail_risk"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{D}/lineitem.parquet'")
    wanted = con.sql(ORACLES[name])
    names = wanted.columns
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.collect(), names) == rows([dict(zip(names, r)) for r in wanted.fetchall()], names)


def test_entry(spark):
    assert FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() == 1


def test_dense_panel_counts_dates_not_rows(spark):
    facts = spark.createDataFrame([(1, f"2020-0{m}-01", float(m)) for m in (1, 2, 5)] + [(2, "2020-03-01", 7.0)], "asset int, date string, close double").selectExpr("asset", "to_date(date) date", "close")
    dense = densify(facts, "month")
    assert dense.count() == 10
    means = {(r["asset"], r["date"].month): r["m"] for r in dense.selectExpr("asset", "date", f"{roll('avg', 'close', 2)} as m").collect()}
    assert means[1, 2] == 1.5 and means[1, 3] is None and means[1, 5] is None
    assert densify(facts.limit(0), "month").count() == 0


def test_rank_of_ties_nulls_and_small_sections(spark):
    data = [("a", k, float(v) if v is not None else None) for k, v in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, None])] + [("b", k, float(k)) for k in range(9)]
    got = spark.createDataFrame(data, "date string, asset int, x double").selectExpr("date", "asset", f"{cs_rank('x')} as s").collect()
    by = {(r["date"], r["asset"]): r["s"] for r in got}
    assert by["a", 0] == by["a", 1] == pytest.approx(2 * 1.5 / 10 - 1) and by["a", 9] == 1.0
    assert by["a", 10] is None and all(by["b", k] is None for k in range(9))


def test_compound_needs_all_values(spark):
    data = [(1, k, 0.1 if k != 3 else None) for k in range(6)]
    got = {r["date"]: r["c"] for r in spark.createDataFrame(data, "asset int, date int, ret double").selectExpr("date", f"{compound('ret', 2, 1)} as c").collect()}
    assert got[2] == pytest.approx(0.21) and got[1] is None and got[4] is None and got[5] is None


def test_ranks_of_many_factors_take_one_sort_and_keep_their_parts(spark):
    from quantloom.functions.frames import average_rank, cs_place
    from quantloom.operators.factors import MONTHLY, compute_all
    from quantloom.operators.significance import ic_by_factor

    data = [("a", k, float(v) if v is not None else None) for k, v in enumerate([1, 1, 2, 3, 4, -0.0, 0.0, 7, float("nan"), 9, None, None, 9, 9])] + [("b", k, float(k)) for k in range(9)] + [("c", k, None) for k in range(12)]
    df = spark.createDataFrame(data, "date string, asset int, x double").repartition(3)
    got = df.select("date", "asset", df["x"], average_rank("x", "date").alias("r")).selectExpr("*", f"{cs_rank('x')} as old", f"{cs_place('x')} as new", "rank() over (partition by date order by x nulls last) + (count(x) over (partition by date, x) - 1) / 2 as place").collect()
    assert len(got) == len(data) and all(r["old"] == r["new"] and r["r"] == r["place"] for r in got)
    panel = spark.range(4000).selectExpr("id % 200 as asset", "date_add(date '2020-01-01', cast(id / 200 as int)) as date", "rand(3) as ret", "rand(4) as close", "rand(5) as fwd")
    tall = compute_all(panel, {n: MONTHLY[n] for n in ("momentum_12_1", "volatility_12m", "max_return_12m")}, keep=("fwd",))
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [factor")
    assert sorts(tall) == 1 and sorts(ic_by_factor(tall)) == 3
    assert tall.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # small parts are not put together
