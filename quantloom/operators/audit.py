"""The whole audit of factors: variance inflation, probabilities, several tests at once, and how much money a signal can carry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import two_sided
from .significance import autocorrelation, multiple_tests, newey_west

#: Factors of a variance inflation table: a matrix of their products is held by one task.
MOST_FACTORS = 30
#: Levels of a capacity curve.
LEVELS = (1e6, 5e6, 10e6, 25e6, 50e6, 100e6, 250e6, 500e6)
VIF_ROWS = "factor string, vif double, concern string"


def concern(vif: float) -> str:
    return "n/a" if np.isnan(vif) else "severe" if vif > 10 else "warning" if vif > 5 else "ok"


def vif(rows: DataFrame, names: list[str]) -> DataFrame:
    """factor, vif and concern of each of names, columns of rows: 1 / (1 - R²) of each on the others, over the rows that have all.

    One pass adds up the products of all pairs; one row of sums, whatever the number of rows, is inverted.  With fewer
    rows than factors and two the values are null and the concern insufficient; a factor that does not vary, or that others add
    up to, has an infinite value.
    """
    if len(names) > MOST_FACTORS:
        raise ValueError(f"at most {MOST_FACTORS} factors")
    whole = rows.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in names))
    x = [F.col(f"`{c}`").cast("double") for c in names]
    # products about a first mean: sums of large values do not cancel
    mean = whole.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)])
    around = whole.join(F.broadcast(mean), how="cross")  # one row
    d = [c - F.col(f"m{i}") for i, c in enumerate(x)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    sums = around.agg(F.count("*").cast("double").alias("n"), *[F.coalesce(F.sum(d[i] * d[j]), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs])

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    s[i, j] = s[j, i] = row[f"s{i}_{j}"]
                scale = np.sqrt(np.diag(s))
                values = [None] * len(names)
                if row["n"] >= len(names) + 2:
                    flat = scale <= 1e-12
                    r = s / np.outer(np.where(flat, 1, scale), np.where(flat, 1, scale))
                    alone = np.linalg.matrix_rank(r[~flat][:, ~flat], tol=1e-10) == (~flat).sum()
                    inverse = np.full(len(names), np.inf)
                    if alone and (~flat).any():
                        inverse[~flat] = np.diag(np.linalg.inv(r[~flat][:, ~flat]))
                    values = inverse.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.float64()), pa.array(["insufficient" if v is None else concern(v) for v in values])], ["factor", "vif", "concern"])

    return sums.mapInArrow(inverted, VIF_ROWS)


def vif_sql(rows: str, names: list[str]) -> str:
    """DuckDB: the matrix of correlations swept name by name; what is left on the diagonal is the inverse."""
    k = len(names)
    matrix = ", ".join("[" + ", ".join(f"corr({a}, {b})" for b in names) + "]" for a in names)
    swept = "list_transform(range(1, {k} + 1), lambda i: list_transform(range(1, {k} + 1), lambda j: case when i = p and j = p then -1 / a[p][p] when i = p or j = p then a[i][j] / a[p][p] else a[i][j] - a[i][p] * a[p][j] / a[p][p] end))".format(k=k)
    whole = " and ".join(f"{c} is not null" for c in names)
    return f"""with recursive m as (select count(*) as n, [{matrix}] as a from ({rows}) where {whole}),
    s as (select 1 as p, n, a from m union all select p + 1, n, {swept} from s where p <= {k})
    select f as factor, -a[i][i] as vif, case when -a[i][i] > 10 then 'severe' when -a[i][i] > 5 then 'warning' else 'ok' end as concern from s, (select unnest({names!r}) as f, unnest(range(1, {k + 1})) as i) where p = {k + 1}"""


def ljung_box_p(q: str) -> str:
    """SQL text: the probability of a chi-square of five degrees of freedom above q."""
    return f"(case when {q} is null then null else {two_sided(f'sqrt({q})')} + sqrt(2 / pi()) * exp(-({q}) / 2) * (sqrt({q}) + {q} * sqrt({q}) / 3) end)"


def audit(ics: DataFrame, method: str = "bh", alpha: float = 0.05) -> DataFrame:
    """A row for each factor: t with and without adjustment, probabilities, autocorrelation and the verdict of all tests together; p is null with ten dates or fewer."""
    nw = newey_west(ics).withColumn("p", F.when(F.col("n") > 10, F.expr(two_sided("t_adjusted"))))
    ac = autocorrelation(ics).withColumn("ljung_box_p", F.expr(ljung_box_p("ljung_box"))).drop("n", "ljung_box")
    both = nw.join(ac, "factor", "left").withColumn("autocorrelated", F.coalesce(F.when(F.col("ljung_box_p").isNotNull(), F.col("ljung_box_p") < 0.05).otherwise(F.abs("rho") > 0.15), F.lit(False)))
    tests = multiple_tests(nw.select("factor", F.round("p", 12).alias("p")), method, alpha).select("factor", "p_adjusted", "reject")
    return both.join(tests, "factor").select("factor", "n", "mean", "t_naive", "t_adjusted", "p", "rho", "n_effective", "t_effective", "ljung_box_p", "autocorrelated", "p_adjusted", "reject")


def summary(audited: DataFrame, vifs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: how many factors are significant before and after adjustment, expected by chance, autocorrelated and inflated, and the median of naive over adjusted t."""
    inflation = F.abs("t_naive") / F.when(F.col("t_adjusted") != 0, F.abs("t_adjusted"))
    by = audited.agg(
        F.count("*").alias("tested"), F.count_if(F.col("p") < alpha).alias("significant"), F.count_if("reject").alias("rejected"), (F.count("*") * alpha).alias("by_chance"), F.count_if("autocorrelated").alias("autocorrelated"), F.median(inflation).alias("inflation")
    )
    return by.join(vifs.agg(F.count_if(F.col("vif") > 5).alias("high_vif")), how="cross")  # one row each


def capacity(rows: DataFrame, longs: int = 20, shorts: int = 20, exposure: float = 1.3, most: float = 0.1, impact: float = 0.3, dates: int = 24) -> DataFrame:
    """level, participation, impact and cost a year of a signal's money, and the largest amount: of rows (date, asset, signal, adv).

    What is held on each of the last dates trades a median amount a day; the median of these, divided by a position's
    share, is what `most` of a day's trade allows.  Without dates with enough names the result is empty.
    """
    known = rows.where("signal is not null")
    by = Window.partitionBy("date")
    recent = rows.select("date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date")))).where(F.col("k") <= dates)  # a row for each date
    placed = known.withColumn("n", F.count("*").over(by)).withColumn("up", F.row_number().over(by.orderBy(F.desc("signal"), "asset"))).withColumn("down", F.row_number().over(by.orderBy("signal", "asset")))
    held = placed.where((F.col("n") >= longs + shorts) & ((F.col("up") <= longs) | (F.col("down") <= shorts))).join(F.broadcast(recent), "date")
    medians = held.where("adv is not null").groupBy("date").agg(F.median("adv").alias("adv")).agg(F.median("adv").alias("adv")).where("adv is not null")
    share = exposure / (longs + shorts)
    part = F.when(F.col("adv") > 0, F.col("level") * share / F.col("adv")).otherwise(1.0)
    curve = medians.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).withColumn("part", part)
    one_way = impact * F.sqrt(F.least("part", F.lit(1.0))) * 1e4
    return curve.select("level", (most * F.col("adv") / share).alias("most"), F.col("adv").alias("median_adv"), F.col("part").alias("participation"), one_way.alias("impact_bps"), (one_way * 2 * 12 / 1e4).alias("cost_a_year"), (F.col("part") < most).alias("viable"))
