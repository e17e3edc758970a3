"""What the monthly factors are worth to boosted trees and to greedy combination."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from ..operators import learning, significance
from .catalog import ORACLES, QUERIES, register
from .evaluation_queries import NAMES
from .risk_queries import rounded

FEATURES = list(NAMES)
SMALL = {"trees": 8, "depth": 3}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["feature_panel"](spark, d)


def _split(spark: SparkSession, d: str) -> DataFrame:
    return significance.time_split(_rows(spark, d), 0.7)


def _model(split: DataFrame):
    return learning.fit(split.where("role = 'train'"), FEATURES, **SMALL)


def _trees(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return rounded(learning.tree_importance(_model(split), split, FEATURES))


def _permuted(spark: SparkSession, d: str) -> DataFrame:
    split = _split(spark, d)
    return rounded(learning.permutation_importance(_model(split), split.where("role = 'test'"), FEATURES), 9)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.fold_scores(learning.walk_forward(_rows(spark, d), FEATURES, n=3, **SMALL)))


_SETS = [c for k in range(1, len(NAMES) + 1) for c in combinations(range(len(NAMES)), k)]
_MASKED = ", ".join(f"({sum(1 << i for i in c)}, {list(c)!r}::int[])" for c in _SETS)
_VALUES = "[" + ", ".join(NAMES) + "]"
_STEPWISE = f"""with recursive rows as (select *, {_VALUES} as v from ({ORACLES['feature_panel']})), c as (select date, sum(count(*)) over (order by date) - count(*) as before, sum(count(*)) over () as n from rows group by 1),
s as (select role, fwd, mask, round(list_avg(list_filter(list_transform(members, lambda i: v[i + 1]), lambda x: x is not null)), 9) as value from (select rows.*, case when before < 0.7 * n then 'train' else 'test' end as role from rows join c using (date)), (values {_MASKED}) m(mask, members)),
k as (select *, rank() over (partition by role, mask order by value) + (count(*) over (partition by role, mask, value) - 1) / 2 as a, rank() over (partition by role, mask order by fwd) + (count(*) over (partition by role, mask, fwd) - 1) / 2 as b from s where value is not null),
i as (select mask, corr(a, b) filter (role = 'train') as train, corr(a, b) filter (role = 'test') as test from k group by 1),
g as (
  select 0 as step, 0 as mask, '' as selected, '' as added, null::double as train_ic, null::double as test_ic
  union all
  select step, mask, selected, added, train, test from (
    select g.step + 1 as step, i.mask, case when g.selected = '' then n.name else g.selected || '+' || n.name end as selected, n.name as added, i.train, i.test, row_number() over (order by round(i.test, 9) desc, n.bit) as place
    from g, (select unnest({FEATURES!r}) as name, unnest(range({len(NAMES)})) as bit) n join i on i.mask = (g.mask | (1 << n.bit)::int) where (g.mask & (1 << n.bit)::int) = 0) where place = 1)
select step::int as step, added, selected, round(train_ic, 6) as train_ic, round(test_ic, 6) as test_ic from g where step > 0"""
register("stepwise_selection", lambda spark, d: rounded(learning.stepwise(_split(spark, d), FEATURES)), _STEPWISE)
register("tree_importance", _trees, None)
register("permutation_importance", _permuted, None)
register("walk_forward_learning", _scores, None)
