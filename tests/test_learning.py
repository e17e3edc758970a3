"""Ranks without a single task, greedy selection, importance and walking forward, against pandas and planted features."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import learning

RNG = np.random.default_rng(12)
DAYS = [datetime.date(2020, 1, 1) + datetime.timedelta(days=30 * k) for k in range(24)]


def frame(names=40):
    n = len(DAYS) * names
    x = pd.DataFrame({c: RNG.normal(size=n) for c in ("strong", "weak", "noise", "also")})
    x["date"], x["asset"] = np.repeat(DAYS, names), np.tile(np.arange(names), len(DAYS))
    x["fwd"] = 0.8 * x.strong + 0.25 * x.weak + 0.3 * RNG.normal(size=n)
    x["role"] = np.where(np.arange(n) < 0.7 * n, "train", "test")
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = frame()
    return x, spark.createDataFrame(x).repartition(5).cache()


FEATURES = ["strong", "weak", "noise", "also"]


def test_ranks_and_their_correlation(spark):
    x = pd.DataFrame({"g": RNG.integers(0, 3, 3000), "a": RNG.integers(0, 40, 3000).astype(float), "b": RNG.normal(size=3000)})
    x.loc[:200, "a"] = 7.0  # a value that many rows have
    x["id"] = np.arange(3000)
    df = spark.createDataFrame(x).repartition(7)
    assert {r["a"]: r["place"] for r in learning.places(df, "a").collect()} == dict(zip(x["a"], x["a"].rank(), strict=True))
    assert {(r["g"], r["a"]): r["place"] for r in learning.places(df, "a", ("g",)).collect()} == dict(zip(zip(x["g"], x["a"], strict=True), x.groupby("g")["a"].rank(), strict=True))
    ic = {r["g"]: (r["ic"], r["n"]) for r in learning.spearman(df, "a", "b", ("g",)).collect()}
    for g, part in x.groupby("g"):
        assert ic[g] == (pytest.approx(part["a"].rank().corr(part["b"].rank())), len(part))
    assert learning.spearman(df, "a", "b").first()["n"] == 3000


def test_stepwise_selection_is_greedy(spark, table):
    x, _ = table
    x = x.copy()
    x.loc[RNG.random(len(x)) < 0.2, "weak"] = np.nan
    df = spark.createDataFrame(x.astype(object).where(x.notna(), None), "strong double, weak double, noise double, also double, date date, asset long, fwd double, role string")
    got = learning.stepwise(df, FEATURES, most=3).collect()
    chosen: list = []
    for r in got:
        ics = {}
        for c in [c for c in FEATURES if c not in chosen]:
            mean = x[[*chosen, c]].mean(axis=1).round(9)
            ics[c] = {role: mean[x.role == role].rank().corr(x.fwd[(x.role == role) & mean.notna()].rank()) for role in ("train", "test")}
        best = max(ics, key=lambda c: ics[c]["test"])
        chosen.append(best)
        assert (r["added"], r["selected"]) == (best, "+".join(chosen)) and r["test_ic"] == pytest.approx(ics[best]["test"]) and r["train_ic"] == pytest.approx(ics[best]["train"])
    assert chosen[0] == "strong"


def test_coefficients_join_no_rows(spark):
    n = 4000
    x = pd.DataFrame({"role": np.where(RNG.random(n) < 0.3, "test", "train"), "fwd": RNG.normal(size=n).round(2), "a": RNG.integers(0, 30, n).astype(float), "b": RNG.normal(size=n), "same": 1.0})
    x.loc[:300, "fwd"], x.loc[RNG.random(n) < 0.3, "b"] = 0.0, np.nan
    laid = learning.along(spark.createDataFrame(x.astype(object).where(x.notna(), None), "role string, fwd double, a double, b double, same double").repartition(5), "fwd", "role").persist()
    out = learning.coefficients(laid, {c: F.col(c) for c in ("a", "b", "same")}, "fwd", "role")
    got = {(r["role"], r["name"]): r["ic"] for r in out.collect()}
    for role, p in x.groupby("role"):
        for c in ("a", "b"):
            assert got[role, c] == pytest.approx(p[c].rank().corr(p["fwd"][p[c].notna()].rank()), abs=1e-12)
        assert got[role, "same"] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # a row meets small tables only
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1  # what is kept is read, not computed again
    laid.unpersist()


def test_importance_finds_what_was_planted(spark, table):
    _, df = table
    model = learning.fit(df.where("role = 'train'"), FEATURES, trees=12, depth=3)
    gains = {r["feature"]: r for r in learning.tree_importance(model, df, FEATURES).collect()}
    assert gains["strong"]["place"] == 1 and gains["weak"]["place"] == 2 and sum(r["gain"] for r in gains.values()) == pytest.approx(1) and gains["strong"]["splits"] > 0
    test = df.where("role = 'test'")
    rise = {r["feature"]: r["importance"] for r in learning.permutation_importance(model, test, FEATURES, repeats=3).collect()}
    assert rise["strong"] > 10 * rise["weak"] > 0 and abs(rise["noise"]) < 0.05 * rise["strong"]
    # a shuffled column of independent values adds twice its explained variance
    assert rise["strong"] == pytest.approx(2 * 0.64, rel=0.35)


def test_folds_do_not_look_ahead(spark, table):
    x, df = table
    assert learning.splits(df, 3) == [(k, DAYS[6 + 6 * k], DAYS[11 + 6 * k], DAYS[5 + 6 * k]) for k in range(3)]
    small = {"trees": 4, "depth": 2, "share": 1.0}
    out = learning.walk_forward(df, FEATURES, n=2, **small)
    scores = {r["fold"]: r for r in learning.fold_scores(out).collect()}
    assert len(scores) == 2 and all(s["ic"] > 0.7 and s["n"] == 320 for s in scores.values())
    later = x.copy()
    later.loc[later.date > DAYS[15], "fwd"] = 9.0
    other = learning.walk_forward(spark.createDataFrame(later).repartition(5), FEATURES, n=2, **small)
    first = lambda d: {(r["date"], r["asset"]): round(r["prediction"], 6) for r in d.where("fold = 0").collect()}
    mine, theirs = first(out), first(other)
    assert mine == pytest.approx(theirs, abs=1e-5)
    assert learning.walk_forward(df.limit(0), FEATURES).count() == 0


def test_feature_panel_reads_one_panel(spark):
    from quantloom.jobs.registry import QUERIES

    plan = QUERIES["feature_panel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1
