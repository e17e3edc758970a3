"""Statistics of five monthly factors against the next month's return."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import compound, wide
from ..functions.normal import normal_cdf_sql, two_sided
from ..operators import evaluate, factors, significance
from ..sources.panels import FIELDS, panel_sql, sized
from .catalog import MONTH, month, register
from .risk_queries import rounded

COLUMNS = ("asset", "date", *FIELDS, "price", "ret", "mkt")
NAMES = ("momentum_12_1", "volatility_12m", "max_return_12m", "high_52_week", "downside_vol")
MEMBERS = {n: factors.MONTHLY[n] for n in NAMES}


def sized_tall(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The five factors' signals and about how many dates and assets there are."""
    months, size = sized(spark, d, "month")
    return factors.compute_all(months, MEMBERS, size=size).select("factor", "asset", "date", "signal"), size


def tall(spark: SparkSession, d: str) -> DataFrame:
    return sized_tall(spark, d)[0]


TALL = f"select factor, asset, date, signal from ({factors.compute_all_sql(MONTH, COLUMNS, MEMBERS)})"


def forward(spark: SparkSession, d: str) -> DataFrame:
    return month(spark, d).selectExpr("asset", "date", f"round({compound('ret', 1, -1)}, 9) as fwd")


FORWARD = f"select asset, date, round(lead(ret) over (partition by asset order by date), 9) as fwd from ({MONTH})"


def _ahead(spark: SparkSession, d: str) -> DataFrame:
    months, size = sized(spark, d, "month")
    return factors.compute_all(months.selectExpr("*", f"round({compound('ret', 1, -1)}, 9) as fwd"), MEMBERS, keep=("fwd",), size=size)


def ics(spark: SparkSession, d: str) -> DataFrame:
    """Signals and forward returns of one panel: no join."""
    return significance.ic_by_factor(_ahead(spark, d))


_BOTH = f"select factor, date, asset, signal, fwd from ({TALL}) join ({FORWARD}) using (asset, date) where signal is not null and fwd is not null"
ICS = f"select factor, date, round(corr(a, b), 6) as ic, count(*) as n from (select factor, date, rank() over (partition by factor, date order by signal) + (count(*) over (partition by factor, date, signal) - 1) / 2 as a, rank() over (partition by factor, date order by fwd) + (count(*) over (partition by factor, date, fwd) - 1) / 2 as b from ({_BOTH})) group by 1, 2 having count(*) >= 20"
register("forward_sums", lambda spark, d: rounded(significance.forward_sum(month(spark, d), 5)), f"select asset, date, round(case when count(ret) over w >= 5 then sum(ret) over w end, 6) as fwd from ({MONTH}) window w as (partition by asset order by date rows between 1 following and 5 following)")
register("ic_by_factor", ics, ICS)
_TOP = f"""d as (select factor, date, count(*) as k, row_number() over (partition by factor order by date) as place from ({TALL}) where signal is not null group by 1, 2),
h as (select factor, date, asset from ({TALL}) where signal is not null qualify row_number() over (partition by factor, date order by signal desc, asset) <= 20),
t as (select d.factor, d.date, 1 - count(y.asset) / 20 as turnover from d join d e on e.factor = d.factor and e.place = d.place - 1 and e.k >= 20 join h x on x.factor = d.factor and x.date = d.date left join h y on y.factor = d.factor and y.date = e.date and y.asset = x.asset where d.k >= 20 group by 1, 2)"""
register("top_turnover", lambda spark, d: rounded(significance.turnover(tall(spark, d), 20)), f"with {_TOP} select factor, date, round(turnover, 6) as turnover from t")
register("factor_ranking", lambda spark, d: rounded(significance.factor_ranking(tall(spark, d), ics(spark, d))), f"""with {_TOP}, m as (select factor, avg(turnover) as turnover from t group by 1), q as (select factor, avg(ic) as a, stddev_samp(ic) as s, avg((ic > 0)::int) as p from ({ICS}) group by 1)
select factor, round(a, 6) as mean_ic, round(s, 6) as std_ic, round(p, 6) as positive, round(coalesce(a / nullif(s, 0), 0), 6) as ir, round(turnover, 6) as turnover, (row_number() over (order by abs(round(a, 9)) desc, factor))::int as place from q left join m using (factor)""")
_NW = f"""b as (select factor, date, ic, row_number() over (partition by factor order by date) as k from ({ICS})), s as (select factor, count(*) as n, avg(ic) as mean, stddev_samp(ic) as sd, greatest(1, floor(count(*) ** (1 / 3) + 1e-9))::int as m from b group by 1),
e as (select b.factor, k, ic - mean as e, n, m, mean, sd from b join s using (factor)), g as (select x.factor, any_value(x.n) as n, any_value(x.m) as m, any_value(x.mean) as mean, any_value(x.sd) as sd, sqrt(sum((1 - abs(x.k - y.k) / (x.m + 1)) * x.e * y.e)) / any_value(x.n) as se from e x join e y on y.factor = x.factor and abs(x.k - y.k) <= x.m group by 1)"""
register("newey_west", lambda spark, d: rounded(significance.newey_west(ics(spark, d))), f"with {_NW} select factor, n, m as lags, round(mean, 6) as mean, round(mean / (sd / sqrt(n)), 6) as t_naive, round(mean / se, 6) as t_adjusted from g where n >= 10")
register("ic_autocorrelation", lambda spark, d: rounded(significance.autocorrelation(ics(spark, d))), f"""with b as (select factor, date, ic, row_number() over (partition by factor order by date) as k, ic - avg(ic) over (partition by factor) as e, lag(ic) over (partition by factor order by date) as p from ({ICS})),
a as (select factor, count(*) as n, avg(ic) as mean, stddev_samp(ic) as sd, corr(ic, p) as rho, sum(e * e) as v from b group by 1), l as (select x.factor, x.k - y.k as lag, sum(x.e * y.e) as c from b x join b y on y.factor = x.factor and x.k - y.k between 1 and 5 group by 1, 2),
q as (select factor, any_value(n) * (any_value(n) + 2) * sum((c / v) ** 2 / (n - lag)) as q from a join l using (factor) group by 1), f as (select *, greatest(n * (1 - rho) / (1 + rho), 2) as eff from a join q using (factor))
select factor, n, round(rho, 6) as rho, round(eff, 6) as n_effective, round(mean / (sd / sqrt(eff)), 6) as t_effective, round(q, 6) as ljung_box from f where n >= 20""")


def _tests(spark: SparkSession, d: str) -> DataFrame:
    """The two-sided probability of each factor's adjusted t."""
    return significance.newey_west(ics(spark, d)).select("factor", F.round(F.expr(two_sided("t_adjusted")), 9).alias("p"))


_TESTS = f"t as (with {_NW} select factor, round(2 * ({normal_cdf_sql('-abs(mean / se)')}), 9) as p from g where n >= 10), r as (select *, row_number() over (order by p, factor) as k, count(*) over () as n from t)"
_ADJUST = {"bonferroni": "p * n", "holm": "max(p * (n - k + 1)) over (order by k)", "bh": "min(p * n / k) over (order by k desc)", "by": "min(p * n / k * (select sum(1 / i) from range(1, 6) g(i))) over (order by k desc)"}
for _method, _x in _ADJUST.items():
    register(f"multiple_tests_{_method}", lambda spark, d, m=_method: rounded(significance.multiple_tests(_tests(spark, d), m)), f"with {_TESTS} select factor, round(p, 6) as p, round(least({_x}, 1), 6) as p_adjusted, least({_x}, 1) <= 0.05 as reject from r")
register("rank_autocorrelation", lambda spark, d: rounded(significance.rank_autocorrelation(tall(spark, d), 3)), f"""with r as (select factor, date, asset, rank() over (partition by factor, date order by signal) + (count(*) over (partition by factor, date, signal) - 1) / 2 as r, dense_rank() over (partition by factor order by date) as k from ({TALL}) where signal is not null)
select x.factor, x.date, round(corr(x.r, y.r), 6) as autocorrelation from r x join r y on y.factor = x.factor and y.asset = x.asset and y.k = x.k - 3 group by 1, 2""")


def _study(spark: SparkSession, d: str) -> DataFrame:
    ahead = month(spark, d).selectExpr("*", f"round({compound('ret', 1, -1)}, 9) as fwd")
    return factors.compute(ahead, factors.MONTHLY["momentum_12_1"], keep=("fwd",))


_STUDY = f"select asset, date, signal, fwd from ({factors.compute_sql(MONTH, COLUMNS, factors.MONTHLY['momentum_12_1'])}) join ({FORWARD}) using (asset, date)"
_BUCKETS = evaluate.quantile_returns_sql(_STUDY, "fwd", 5)
register("tear_sheet", lambda spark, d: rounded(significance.tear_sheet(evaluate.quantile_returns(_study(spark, d), "fwd", 5))), f"""with b as ({_BUCKETS}), e as (select date, arg_max(mean_ret, bucket) - arg_min(mean_ret, bucket) as x from b group by 1 having count(*) > 1)
select bucket::int as bucket, round(avg(mean_ret), 6) as mean, round(stddev_pop(mean_ret), 6) as spread, count(*) as dates, null::double as sharpe from b group by 1 union all select null, round(avg(x), 6), round(stddev_pop(x), 6), count(*), round(avg(x) / nullif(stddev_pop(x), 0) * sqrt(12), 6) from e""")
_LABELS = "case when month(date) < 5 then 'calm' when month(date) < 9 then 'normal' else 'wild' end"
register("regime_ic", lambda spark, d: rounded(significance.regime_ic(ics(spark, d), month(spark, d).select("date").distinct().selectExpr("date", f"{_LABELS} as regime"))), f"select factor, regime, round(avg(ic), 6) as mean_ic, round(stddev_samp(ic), 6) as std_ic, count(*) as n, round(coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0), 6) as ir from (select factor, ic, {_LABELS} as regime from ({ICS})) group by grouping sets ((factor, regime), (factor)) having count(*) >= 5")
register("fundamental_law", lambda spark, d: rounded(significance.fundamental_law(significance.factor_ranking(tall(spark, d), ics(spark, d)), 100, 12)), f"select factor, 1200::double as breadth, round(avg(ic) * sqrt(1200), 6) as promised, round(avg(ic) / stddev_samp(ic) * sqrt(12) / (avg(ic) * sqrt(1200)), 6) as transfer from ({ICS}) group by 1")


def _folds(expanding: bool):
    return lambda spark, d: significance.walk_forward(month(spark, d), 36, 12, 12, expanding)


def _folds_sql(expanding: bool) -> str:
    return f"""(with d as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from ({MONTH}))), f as (select unnest(range(0, (select any_value(n) from d) - 36 - 12 + 1, 12)) as s)
select (s // 12)::int as fold, case when i < s + 36 then 'train' else 'test' end as role, date from d join f on i >= {0 if expanding else 's'} and i < s + 48)"""


register("walk_forward_folds", _folds(False), f"select * from {_folds_sql(False)}")
register("walk_forward_expanding", _folds(True), f"select * from {_folds_sql(True)}")
register("walk_forward_run", lambda spark, d: rounded(significance.walk_forward_run(_study(spark, d), _folds(True)(spark, d))), f"""with s as (select *, greatest(5, count(*) over (partition by date) // 5) as k, count(*) over (partition by date) as n, row_number() over (partition by date order by signal desc, asset) as up, row_number() over (partition by date order by signal, asset) as down from ({_STUDY}) where signal is not null and fwd is not null),
x as (select date, avg(fwd) filter (up <= k) - avg(fwd) filter (down <= k) as x from s where n >= 2 * k group by 1), g as (select fold, role, coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(12), 0) as sharpe from x join {_folds_sql(True)} using (date) group by 1, 2), w as (select fold, max(sharpe) filter (role = 'train') as train, max(sharpe) filter (role = 'test') as test from g group by 1)
select fold, round(train, 6) as train, round(test, 6) as test, round(test / nullif(train, 0), 6) as retention, round(1 - test / nullif(train, 0), 6) as decay from w""")
register("rolling_ic", lambda spark, d: rounded(significance.rolling_ic(ics(spark, d), 20), 8), f"select factor, date, round(case when count(ic) over w >= 20 then avg(ic) over w end, 8) as mean, round(sum(ic) over (partition by factor order by date), 8) as total from ({ICS}) window w as (partition by factor order by date rows between 19 preceding and current row)")
register("time_split", lambda spark, d: significance.time_split(month(spark, d).where("close is not null").select("asset", "date"), 0.7), f"with p as (select asset, date from ({MONTH}) where close is not null), c as (select date, sum(count(*)) over (order by date) - count(*) as before, sum(count(*)) over () as n from p group by date) select asset, date, case when before < 0.7 * n then 'train' else 'test' end as role from p join c using (date)")
COMBOS = {"+".join(c): c for k in (2, 3) for c in combinations(NAMES, k)}
_COMBO_ROWS = ", ".join(f"('{c}', '{f}')" for c, members in COMBOS.items() for f in members)


def _best(spark: SparkSession, d: str) -> DataFrame:
    signals, size = sized_tall(spark, d)
    return rounded(significance.best_combinations(signals, forward(spark, d), COMBOS, size=size))


register("best_combinations", _best, f"""with c(combo, factor) as (values {_COMBO_ROWS}), m as (select combo, date, asset, round(avg(signal), 6) as signal from ({TALL}) join c using (factor) where signal is not null group by 1, 2, 3), b as (select combo, date, signal, fwd from m join ({FORWARD}) using (asset, date) where fwd is not null),
r as (select combo, date, rank() over (partition by combo, date order by signal) + (count(*) over (partition by combo, date, signal) - 1) / 2 as a, rank() over (partition by combo, date order by fwd) + (count(*) over (partition by combo, date, fwd) - 1) / 2 as b from b), i as (select combo, date, round(corr(a, b), 6) as ic from r group by 1, 2 having count(*) >= 20)
select combo as factor, round(avg(ic), 6) as mean_ic, count(*) as dates from i group by 1""")
_SCORES = ["mean_ic", "ir", "positive"]
register("consensus_rank", lambda spark, d: rounded(significance.consensus(rounded(significance.factor_ranking(tall(spark, d), ics(spark, d))), _SCORES)), f"""with q as (select factor, round(avg(ic), 6) as mean_ic, round(coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0), 6) as ir, round(avg((ic > 0)::int), 6) as positive from ({ICS}) group by 1)
select factor, round(({' + '.join(f'rank() over (order by {c} desc) + (count(*) over (partition by {c}) - 1) / 2' for c in _SCORES)}) / 3, 6) as mean_place from q""")


def _features(spark: SparkSession, d: str) -> DataFrame:
    """date, asset, a column for each factor's signal and fwd, of one panel: no join."""
    return wide(_ahead(spark, d).where("fwd is not null"), list(NAMES), "date", "asset", "fwd").select("date", "asset", *NAMES, "fwd")


_WIDE = reduce(lambda q, n: f"{q}, max(signal) filter (factor = '{n}') as {n}", NAMES, "select date, asset")
register("feature_panel", _features, f"select * from ({_WIDE} from ({TALL}) group by 1, 2) join (select * from ({FORWARD}) where fwd is not null) using (date, asset)")
