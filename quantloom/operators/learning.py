"""What features are worth: boosted trees, shuffled columns, greedy combinations, learning that walks forward.

Features are wide: (date, asset, one column for each feature, label).  Ranks over all rows are taken without a single
task: values are dealt by range, and a range's offset is a sum over ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Trees and their depth, what a tree counts, and the share of rows that it sees.
TREES, DEPTH, STEP, SHARE = 30, 4, 0.1, 0.8
#: Rows that are shuffled among each other, on average.
BUCKET_ROWS = 10_000


def places(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value and place: the average rank of each value among the rows of by.

    Equal values are counted first, then dealt by range: no task sees a whole group, and a value that many rows have is one row.
    """
    keys = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    dealt = counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id())
    placed = dealt.withColumn("_sofar", F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy(value)))
    ranges = placed.groupBy(*keys, "_p").agg(F.max("_sofar").alias("_all"))
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = ranges.withColumn("_before", F.sum("_all").over(order.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_p", "_before")  # a row for each range
    return placed.join(F.broadcast(offsets), [*keys, "_p"]).select(*keys, value, (F.coalesce("_before", F.lit(0)) + F.col("_sofar") - F.col("_n") + (F.col("_n") + 1) / 2).alias("place"))


def spearman(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, ic and n: the rank correlation of a and b over the rows of each group that have both."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    ranked = both.join(places(both, a, by).withColumnRenamed("place", "_a"), [*by, a]).join(places(both, b, by).withColumnRenamed("place", "_b"), [*by, b])
    return ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n"))


def fit(rows: DataFrame, features: list[str], label: str = "fwd", trees: int = TREES, depth: int = DEPTH, share: float = SHARE, seed: int = 42) -> GBTRegressionModel:
    """Boosted trees on the rows that have all features and a label; each tree sees a share of them."""
    known = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows.where(F.col(label).isNotNull()))
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=STEP, subsamplingRate=share, seed=seed).fit(known.select("features", label))


def predict(model: GBTRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows that have all features, with prediction."""
    return model.transform(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)).drop("features")


def tree_importance(model: GBTRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, gain (its share of what splits gain), splits (how many trees' nodes use it) and place by gain."""
    gains = model.featureImportances.toArray()
    splits = [sum(t.toDebugString.count(f"If (feature {k} ") for t in model.trees) for k in range(len(features))]
    order = sorted(range(len(features)), key=lambda k: (-gains[k], k))
    return rows.sparkSession.createDataFrame([(features[k], float(gains[k]), int(splits[k]), i + 1) for i, k in enumerate(order)], "feature string, gain double, splits long, place int")  # a row for each feature


def permutation_importance(model: GBTRegressionModel, rows: DataFrame, features: list[str], label: str = "fwd", repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, importance and its deviation over repeats: how much the mean squared error rises when a feature's values are shuffled.

    One job for all features and repeats: in each repeat a row takes its values from the next row in a random order of its bucket.
    """
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in [*features, label]))
    buckets = max(1, whole.count() // BUCKET_ROWS)
    mark = F.xxhash64("date", "asset", F.lit(seed))
    plain = whole.select(F.array(*features).alias("x"), F.col(label).alias("_y"), mark.alias("_m"), F.pmod(mark, F.lit(buckets)).alias("_bucket"))
    copies = plain.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_order", F.xxhash64("_m", "_repeat"))
    w = Window.partitionBy("_repeat", "_bucket").orderBy("_order", "_m")
    other = copies.withColumn("_z", F.coalesce(F.lead("x").over(w), F.first("x").over(w)))
    shuffled = other.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features))))).withColumn("_mixed", F.transform("x", lambda v, i: F.when(i + 1 == F.col("_f"), F.element_at("_z", i + 1)).otherwise(v)))
    scored = model.transform(shuffled.withColumn("features", array_to_vector("_mixed")))
    mse = scored.groupBy("_repeat", "_f").agg(F.avg((F.col("prediction") - F.col("_y")) ** 2).alias("mse"))
    rise = mse.groupBy("_repeat").agg(F.max(F.when(F.col("_f") == 0, F.col("mse"))).alias("base"), F.map_from_entries(F.collect_list(F.struct("_f", "mse"))).alias("by"))
    each = rise.select(F.explode("by").alias("_f", "mse"), "base").where("_f > 0")
    names = F.array(*map(F.lit, features))
    return each.groupBy(F.element_at(names, F.col("_f")).alias("feature")).agg(F.avg(F.col("mse") - F.col("base")).alias("importance"), F.stddev_pop(F.col("mse") - F.col("base")).alias("deviation"))


def along(rows: DataFrame, label: str, by: str) -> DataFrame:
    """rows with a label, dealt once by ranges of it in each group of by and sorted there; _p is the range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.where(F.col(label).isNotNull()).repartitionByRange(parts, by, label).withColumn("_p", F.spark_partition_id())
    return ranged.repartition(parts, by, "_p").sortWithinPartitions(by, "_p", label)


def coefficients(laid: DataFrame, values: dict[str, Column], label: str, by: str) -> DataFrame:
    """by, name and ic: the rank correlation of each of values with label over the rows of each group that have it.

    laid is along() and kept, so that its ranges stay the same.  Ranks of label are running counts of all values at once, without
    an exchange; then rows are added up by value, and each range of values gives sums of its own.  No row is joined.
    """
    names = list(values)
    x = laid.select(by, "_p", label, *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    # a row for each range comes back: in a plan that has laid twice, Spark would compute one of the two again in place of reading what is kept
    sofar: dict[object, list[int]] = {}
    before = []
    for r in sorted(x.groupBy(by, "_p").agg(*[F.count(f"_v{i}") for i in range(len(names))]).collect(), key=lambda r: r["_p"]):
        here = sofar.setdefault(r[0], [0] * len(names))
        before.append((r[0], r[1], *here))
        sofar[r[0]] = [a + b for a, b in zip(here, r[2:], strict=True)]
    ranges = laid.sparkSession.createDataFrame(before, StructType([laid.schema[by], StructField("_p", IntegerType()), *[StructField(f"_b{i}", LongType()) for i in range(len(names))]]))
    w = Window.partitionBy(by, "_p").orderBy(label)
    here = x.select("*", *[F.count(f"_v{i}").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias(f"_u{i}") for i in range(len(names))], *[F.count(f"_v{i}").over(w.rangeBetween(0, 0)).alias(f"_s{i}") for i in range(len(names))])
    place = lambda i: F.col(f"_b{i}") + F.col(f"_u{i}") - (F.col(f"_s{i}") - 1) / 2
    each = here.join(F.broadcast(ranges), [by, "_p"]).select(by, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"_v{i}").alias("v"), place(i).alias("b")) for i in range(len(names))])).alias("e"))
    merged = each.select(by, "e.*").where("v is not null").groupBy(by, "k", "v").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    ranged = merged.repartitionByRange(by, "k", "v").withColumn("_p", F.spark_partition_id())
    inner = ranged.withColumn("a", F.sum("n").over(Window.partitionBy(by, "k", "_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n") - 1) / 2)
    sums = inner.groupBy(by, "k", "_p").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("bb").alias("bb"), F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy(by, "k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    moved = sums.withColumn("o", offset).select(by, "k", "n", "bb", (F.col("aa") + 2 * F.col("o") * F.col("a") + F.col("o") * F.col("o") * F.col("n")).alias("aa"), (F.col("ab") + F.col("o") * F.col("b")).alias("ab"))  # a row for each range
    total = moved.groupBy(by, "k").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "aa", "bb", "ab")])
    middle = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4  # both ranks have the same mean
    spread = F.sqrt(F.greatest(F.col("aa") - middle, F.lit(0.0))) * F.sqrt(F.greatest(F.col("bb") - middle, F.lit(0.0)))
    return total.select(by, F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("name"), F.try_divide(F.col("ab") - middle, spread).alias("ic"))


def _mean(members: list[str]) -> Column:
    """The mean of the members that a row has, to nine digits."""
    total = reduce(lambda s, c: s + F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), members, F.lit(0.0))
    return F.round(F.try_divide(total, reduce(lambda s, c: s + F.col(f"`{c}`").isNotNull().cast("int"), members, F.lit(0))), 9)


def stepwise(rows: DataFrame, features: list[str], label: str = "fwd", most: int = 8) -> DataFrame:
    """step, added, selected, train_ic and test_ic: in each step the feature with which the mean of the selected ones (of those that a row has) correlates best with the label on rows of role test.

    One job a step tries all features that are left on the tests' rows; the other roles' rows take part once, in a job for all steps.  What comes back is a row for each.
    """
    laid = along(rows.select("role", label, *features), label, "role").persist()  # every step reads them
    test, train = laid.where("role = 'test'"), laid.where("role = 'train'")
    selected: list[str] = []
    found: list[tuple[str, float]] = []
    while len(selected) < min(most, len(features)):
        left = [c for c in features if c not in selected]
        ics = {r["name"]: r["ic"] for r in coefficients(test, {c: _mean([*selected, c]) for c in left}, label, "role").collect()}
        known = [c for c in left if ics.get(c) is not None]
        if not known:
            break
        best = max(known, key=lambda c: (round(ics[c], 9), -features.index(c)))
        selected.append(best)
        found.append((best, ics[best]))
    trained = {r["name"]: r["ic"] for r in coefficients(train, {str(k): _mean(selected[: k + 1]) for k in range(len(selected))}, label, "role").collect()} if selected else {}
    laid.unpersist()
    out = [(k + 1, best, "+".join(selected[: k + 1]), trained.get(str(k)), ic) for k, (best, ic) in enumerate(found)]
    return rows.sparkSession.createDataFrame(out, "step int, added string, selected string, train_ic double, test_ic double")  # a row for each step


def splits(rows: DataFrame, n: int) -> list[tuple[int, object, object, object]]:
    """(fold, first test date, last test date, last train date) of n expanding splits: the dates' last n parts of equal length are tests."""
    dates = [r["date"] for r in rows.select("date").distinct().orderBy("date").collect()]  # a row for each date
    size = len(dates) // (n + 1)
    first = len(dates) - n * size
    return [(k, dates[first + k * size], dates[first + (k + 1) * size - 1], dates[first + k * size - 1]) for k in range(n)] if size else []


def walk_forward(rows: DataFrame, features: list[str], label: str = "fwd", n: int = 5, **trees) -> DataFrame:
    """date, asset, fold, label and prediction of n expanding splits: each is predicted by trees that saw earlier dates only."""
    known = rows.where(" and ".join(f"`{c}` is not null" for c in [*features, label]))
    out = None
    for fold, first, last, train in splits(known, n):
        model = fit(known.where(F.col("date") <= F.lit(train)), features, label, **trees)
        part = predict(model, known.where(F.col("date").between(F.lit(first), F.lit(last))), features).select("date", "asset", F.lit(fold).alias("fold"), label, "prediction")
        out = part if out is None else out.unionByName(part)
    return known.select("date", "asset", F.lit(0).alias("fold"), label, F.lit(0.0).alias("prediction")).limit(0) if out is None else out


def fold_scores(predictions: DataFrame, label: str = "fwd") -> DataFrame:
    """fold, ic, mse and n of walk_forward() predictions."""
    mse = predictions.groupBy("fold").agg(F.avg((F.col("prediction") - F.col(label)) ** 2).alias("mse"))
    return spearman(predictions.withColumn("prediction", F.round("prediction", 12)), "prediction", label, ("fold",)).join(mse, "fold")
