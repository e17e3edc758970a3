"""Parts of ranks follow the size of the panel, not the session: a task's memory is that of some groups."""

import re

import pytest

from quantloom.functions import frames
from quantloom.functions.frames import wide
from quantloom.jobs.registry import QUERIES
from quantloom.operators.factors import MONTHLY, compute_all
from quantloom.operators.significance import multiple_tests
from quantloom.sources.panels import panel, sized

D = "/root/testdata/sf0.001"
MEMBERS = {n: MONTHLY[n] for n in ("momentum_12_1", "volatility_12m", "high_52_week")}


def parts(df):
    """The number of parts of each exchange that deals groups out."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_ranks_have_parts_by_size(spark, monkeypatch):
    monkeypatch.setattr(frames, "PART_ROWS", 50)
    rows, size = sized(spark, D, "month")
    few, many = compute_all(rows, MEMBERS, least=2), compute_all(rows, MEMBERS, least=2, size=size)
    assert set(parts(few)) == {4} and set(parts(many)) == {-(-3 * size // 50)}
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_tasks_write_parts_without_holding_them(spark):
    assert frames.dealt(spark.range(10), "id", size=10**9).rdd.getNumPartitions() == 200
    assert frames.dealt(spark.range(10), "id", size=3 * frames.PART_ROWS).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("unit,per", [("month", 1), ("week", 4)])
def test_size_of_a_panel(spark, unit, per):
    rows, size = sized(spark, D, unit, per)
    n = rows.count()
    assert n == panel(spark, D, unit, per).count() > 0
    assert n <= size <= 1.1 * n


def test_size_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{D}/lineitem.parquet").limit(0).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows, size = sized(spark, str(tmp_path), "month")
    assert rows.count() == size == 0


def test_wide_takes_one_aggregate(spark):
    tall = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 1, 1, None), ("a", 1, 2, -0.0), ("c", 2, 1, 1.0)], "factor string, date int, asset int, signal double")
    out = wide(tall, ["a", "b"])
    assert out._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") == 2  # its two halves
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0.5, None), (1, 2, -0.0, None), (2, 1, None, None)]


@pytest.mark.parametrize("name", ["signal_catalogue", "vif", "composite_trend", "composite_daily", "multiple_tests_bh", "multiple_tests_holm", "multiple_tests_by", "multiple_tests_bonferroni"])
def test_queries_deal_by_size(spark, monkeypatch, name):
    monkeypatch.setattr(frames, "PART_ROWS", 20)
    plan = QUERIES[name](spark, D)
    assert min(parts(plan)) > 20
    assert "pivotfirst" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["multiple_tests_bonferroni", "multiple_tests_by"])
def test_tests_are_computed_once(spark, name):
    plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


@pytest.mark.parametrize("method", ["bonferroni", "holm", "bh", "by"])
def test_adjusted_tests_against_plain_loops(spark, method):
    known = {"a": 0.04, "b": 0.001, "c": 0.04, "d": 0.9, "e": 0.013, "f": 0.0}
    got = multiple_tests(spark.createDataFrame([*known.items(), ("g", None), ("h", None)], "factor string, p double"), method)
    n, order = len(known), sorted(known, key=lambda f: (known[f], f))
    each = {f: known[f] * {"bonferroni": n, "holm": n - k, "bh": n / (k + 1), "by": n / (k + 1) * sum(1 / i for i in range(1, n + 1))}[method] for k, f in enumerate(order)}
    ahead = {"bonferroni": lambda k: [order[k]], "holm": lambda k: order[: k + 1]}.get(method, lambda k: order[k:])
    worst = max if method == "holm" else min
    want = {f: pytest.approx(min(1, worst(each[g] for g in ahead(k)))) for k, f in enumerate(order)} | {"g": None, "h": None}
    assert {r["factor"]: r["p_adjusted"] for r in got.collect()} == want
    assert {r["factor"] for r in got.where("reject").collect()} == {f for f, x in want.items() if x is not None and x.expected <= 0.05}
    assert got.columns == ["factor", "p", "p_adjusted", "reject"]
