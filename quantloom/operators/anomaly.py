"""Anomalies of metrics (strategy, metric, date, x): shifts of the mean by cumulative sums, outliers by random trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A shift counts above so much of a deviation, alarms at so many, and is critical at half as much again.
SLACK, THRESHOLD, CRITICAL = 0.5, 4.0, 1.5
#: Values that a mean needs, and the least deviation that is one.
LEAST, FLAT = 10, 1e-10
#: Trees, rows of each, and rows that the forest is grown on: a bounded sample.
TREES, TREE_ROWS, SAMPLE_ROWS = 100, 256, 20_000


def deviations(values: DataFrame, window: int) -> DataFrame:
    """values with z, the standard score against the window - 1 rows before, and limit, the alarm's level from the window's own deviation; null until there are `window` rows and ten values."""
    w = Window.partitionBy("strategy", "metric").orderBy("date")
    past, now = w.rowsBetween(1 - window, -1), w.rowsBetween(1 - window, 0)
    enough = (F.count("*").over(now) >= window) & (F.count("x").over(now) >= LEAST)
    spread, level = F.stddev_pop("x").over(past), F.stddev_pop("x").over(now)
    z = F.when(enough & (spread >= FLAT), (F.col("x") - F.avg("x").over(past)) / spread)
    return values.withColumn("z", z).withColumn("limit", F.when(enough & (level >= FLAT), THRESHOLD * level))


def shift(up: float, down: float, z: float | None, limit: float | None) -> tuple[float, float, float, float, str | None]:
    """The two sums after a value, as they are shown and as they go on, and the alarm; an alarm sets both to 0."""
    if z is not None and not math.isnan(z):
        up, down = max(0.0, up + z - SLACK), max(0.0, down - z - SLACK)
    if limit is None or math.isnan(limit) or max(up, down) <= limit:
        return up, down, up, down, None
    return up, down, 0.0, 0.0, ("critical" if max(up, down) > CRITICAL * limit else "warning") + (" up" if up > down else " down")


def _sums(table: pa.Table) -> pa.Table:
    table = table.sort_by("date")
    up = down = 0.0
    out = []
    for z, limit in zip(table["z"].to_pylist(), table["limit"].to_pylist(), strict=True):
        shown_up, shown_down, up, down, alarm = shift(up, down, z, limit)
        out.append((shown_up, shown_down, alarm))
    cols = list(zip(*out, strict=True)) or [[], [], []]
    more = {"up": pa.array(cols[0], pa.float64()), "down": pa.array(cols[1], pa.float64()), "alarm": pa.array(cols[2], pa.string())}
    for name, column in more.items():
        table = table.append_column(name, column)
    return table


def cusum(values: DataFrame, window: int = 60) -> DataFrame:
    """values (strategy, metric, date, x) with z, limit, the sums of what lies above and below, and the alarm: null, or warning or critical with its direction.

    Sums start again after an alarm: this is what makes a series a fold, one group for each strategy and metric, and
    all else frames.  Rows without a value leave the sums as they are.
    """
    rows = deviations(values.select("strategy", "metric", "date", F.col("x").cast("double").alias("x")), window)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", up double, down double, alarm string"
    return rows.groupBy("strategy", "metric").applyInArrow(_sums, schema)


def cusum_sql(values: str, window: int = 60) -> str:
    frame = f"(partition by strategy, metric order by date rows between {window - 1} preceding and {{}})"
    past, now = frame.format("1 preceding"), frame.format("current row")
    return f"""with recursive r as (
      select strategy, metric, date, x, row_number() over (partition by strategy, metric order by date) as i,
        case when count(*) over {now} >= {window} and count(x) over {now} >= {LEAST} and stddev_pop(x) over {past} >= {FLAT} then (x - avg(x) over {past}) / stddev_pop(x) over {past} end as z,
        case when count(*) over {now} >= {window} and count(x) over {now} >= {LEAST} and stddev_pop(x) over {now} >= {FLAT} then {THRESHOLD} * stddev_pop(x) over {now} end as lim
      from ({values})),
    s as (
      select strategy, metric, 0::bigint as i, 0e0 as up, 0e0 as down, false as alarmed from (select distinct strategy, metric from r)
      union all
      select strategy, metric, i, up, down, coalesce(greatest(up, down) > lim, false) from (
        select s.strategy, s.metric, r.i, r.lim, case when z is null then u else greatest(0, u + z - {SLACK}) end as up, case when z is null then d else greatest(0, d - z - {SLACK}) end as down
        from (select *, case when alarmed then 0 else up end as u, case when alarmed then 0 else down end as d from s) s join r on r.strategy = s.strategy and r.metric = s.metric and r.i = s.i + 1))
    select r.strategy, r.metric, r.date, r.x, r.z, r.lim as limit, s.up, s.down, case when alarmed then case when greatest(up, down) > {CRITICAL} * lim then 'critical' else 'warning' end || case when up > down then ' up' else ' down' end end as alarm
    from r join s using (strategy, metric, i)"""


class Forest:
    """Isolation trees as arrays: node k splits on feature[k] at cut[k] and leads to left[k] or left[k] + 1; leaves have feature -1 and a path length."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = sample.mean(axis=0), np.where(sample.std(axis=0) > 0, sample.std(axis=0), 1.0)
        scaled = (sample - self.mean) / self.spread
        self.rows = min(rows, len(sample))
        self.depth = max(1, math.ceil(math.log2(max(self.rows, 2))))
        self.trees = [self._grow(scaled[rng.choice(len(scaled), self.rows, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, length = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) <= 1 or not len(wide):
                length[node] = depth + usual_length(len(part))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            feature[node], cut[node], left[node] = f, at, len(feature)
            for side in (part[part[:, f] <= at], part[part[:, f] > at]):
                todo.append((len(feature), side, depth + 1))
                for column, value in ((feature, -1), (cut, 0.0), (left, 0), (length, 0.0)):
                    column.append(value)
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, near 1 for rows that few cuts set apart."""
        scaled, total = (x - self.mean) / self.spread, np.zeros(len(x))
        for feature, cut, left, length in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[node] >= 0
                right = scaled[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(usual_length(self.rows), 1e-9))


def usual_length(n: int) -> float:
    """The mean path length of a search for one of n values that is not there."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_forest(rows: DataFrame, features: list[str], *, contamination: float = 0.05, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """rows with isolation, 0 at the level that `contamination` of the sample exceed and negative for outliers; null where a feature is missing, and for all rows if fewer than 20 are whole.

    The forest grows on at most sample_rows rows, those with the smallest hashes of their values, and every row is
    scored: what is broadcast is a few hundred nodes for each of 100 trees.
    """
    whole = rows.select(*[F.col(c).cast("double").alias(c) for c in features]).where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in features))
    place = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, sample_rows / max(whole.count(), 1))
    sample = np.array([tuple(r) for r in whole.where(place < int(share * (1 << 40))).orderBy(place, *features).limit(sample_rows).collect()], float).reshape(-1, len(features))
    if len(sample) < 20:
        return rows.withColumn("isolation", F.lit(None).cast("double"))
    forest = Forest(sample, seed=seed)
    level = float(np.quantile(-forest.score(sample), contamination))
    sent = rows.sparkSession.sparkContext.broadcast((forest, level))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, offset = sent.value
        for batch in batches:
            x = np.stack([batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features], axis=1)
            missing = np.isnan(x).any(axis=1)
            score = -trees.score(np.nan_to_num(x)) - offset
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64(), mask=missing)], [*batch.schema.names, "isolation"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", isolation double"
    return rows.mapInArrow(scored, schema)


def alerts(sums: DataFrame) -> DataFrame:
    """The alarms of cusum() rows, critical ones first."""
    kind: Column = F.split("alarm", " ")
    return sums.where("alarm is not null").select("strategy", "metric", "date", kind[0].alias("severity"), kind[1].alias("direction"), F.greatest("up", "down").alias("amount"), "limit").orderBy("severity", "date", "strategy", "metric")
