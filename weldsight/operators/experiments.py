"""Variants that were tried beside the main path, and small numeric helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weldsight.operators.ordered import ordered_pass


def _recurrence(df: DataFrame, key: str, order: str, column: str, keep: float, add: float, name: str) -> DataFrame:
    """v = keep * v + add * x over each key's rows in order, from the first x on."""

    def step(v, row):
        x = row[0]
        v = x if v is None or x is None else v * keep + x * add
        return v, (v,)

    return ordered_pass(df.withColumn(column, F.col(column).cast("double")), key, order, [column], f"{name} double", step)


def ewma(df: DataFrame, key: str, order: str, column: str, half_life: float) -> DataFrame:
    alpha = 1 - 0.5 ** (1 / half_life)
    return _recurrence(df, key, order, column, 1 - alpha, alpha, "ewma")


def cusum(df: DataFrame, key: str, order: str, column: str, k: float = 0.5) -> DataFrame:
    """Sums of what exceeds ``k``, never below 0: the running total less its least value so far."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("_total", F.sum(F.col(column).cast("double") - k).over(so_far))
    least = F.least(F.lit(0.0), F.min("_total").over(so_far))
    return total.select(key, order, (F.col("_total") - least).alias("cusum"))


def exp_smooth(df: DataFrame, key: str, order: str, column: str, weight: float = 0.8) -> DataFrame:
    """Exponential smoothing from the first value on, divided by the weight as in the published curves."""
    out = _recurrence(df, key, order, column, weight, 1 - weight, "smooth")
    return out.withColumn("debiased", F.col("smooth") / weight)


def history(df: DataFrame, key: str, order: str, column: str, lengths: tuple[int, ...] = (5, 30)) -> DataFrame:
    out = df.select(key, order, column)
    for n in lengths:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"{column}_mean{n}", F.avg(column).over(w)).withColumn(f"{column}_std{n}", F.coalesce(F.stddev_samp(column).over(w), F.lit(0.0)))
    return out


def sequences(df: DataFrame, key: str, order: str, column: str, length: int) -> DataFrame:
    """The last ``length`` values at each row that has as many: inputs of a sequence model."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(length - 1), 0)
    return df.select(key, order, F.collect_list(column).over(w).alias("sequence")).filter(F.size("sequence") == length)


def residual(rows: DataFrame, normal: DataFrame, by: str, column: str) -> DataFrame:
    """Value less the median over normal rows with the same setting."""
    medians = normal.groupBy(by).agg(F.percentile(column, F.lit(0.5)).alias("_m"))
    return rows.join(medians, by, "left").withColumn("residual", F.col(column) - F.col("_m")).drop("_m")


def maintenance(rows: DataFrame, slot_s: int, cap_s: int = 21_600) -> DataFrame:
    """Time since the last slot without welding (capped), and such slots' count and share over the last cap."""
    past = Window.partitionBy("gun").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    frame = Window.partitionBy("gun").orderBy("slot").rangeBetween(-(cap_s // slot_s) + 1, 0)
    last = F.max(F.when(F.col("nw"), F.col("slot"))).over(past)
    since = F.least(F.coalesce((F.col("slot") - last) * slot_s, F.lit(cap_s)), F.lit(cap_s))
    return rows.select("gun", "slot", since.alias("since_s"), F.sum(F.col("nw").cast("int")).over(frame).alias("count_6h"), F.avg(F.col("nw").cast("double")).over(frame).alias("share_6h"))


def minmax(rows: DataFrame, column: str) -> DataFrame:
    ends = rows.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    return rows.join(F.broadcast(ends)).withColumn("minmax", (F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a"))).drop("_a", "_b")


def by_maximum(rows: DataFrame, column: str, floor: float = 0.01) -> DataFrame:
    top = rows.agg(F.max(column).alias("_b"))
    return rows.join(F.broadcast(top)).withColumn("scaled", F.when(F.col(column) != 0, F.col(column) / F.col("_b")).otherwise(floor)).drop("_b")


def _undominated(x: np.ndarray) -> np.ndarray:
    """Places of the rows that no other dominates: only rows of a smaller sum can, so that the front grows in that order."""
    order = np.lexsort((*x.T[::-1], x.sum(1)))
    front, kept = np.empty((0, x.shape[1])), []
    for i in order:
        worse = (front <= x[i]).all(1) & (front < x[i]).any(1)
        if not worse.any():
            kept.append(i)
            front = np.vstack([front, x[i]])
    return np.sort(np.array(kept, np.int64))


def pareto_front(points: DataFrame, key: str, objectives: list[str]) -> DataFrame:
    """Points that no other dominates (all objectives minimal); equal points stay together.

    Each partition keeps its own front, and a quarter as many tasks merge fronts until one is left, which holds no more
    than the fronts of the last four: the size of the answer, not of the points.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            x = np.column_stack([table.column(o).cast(pa.float64()).to_numpy() for o in objectives])
            held = table.take(_undominated(x))
        if held is not None:
            yield from held.to_batches()

    rows = points.select(key, *objectives).dropna(subset=objectives)
    front, tasks = rows.mapInArrow(local, rows.schema), rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // 4)
        front = front.repartition(tasks).mapInArrow(local, rows.schema)
    return front


def front_distance(points: DataFrame, front: DataFrame, objectives: list[str], block: int = 1024) -> DataFrame:
    """Mean distance of the points to the nearest of a front (GD; swap the two for IGD), the front in blocks of rows."""
    numbered = front.select(F.struct(*[F.col(o).cast("double").alias(f"_{o}") for o in objectives]).alias("f"), F.monotonically_increasing_id().alias("i"))
    blocks = numbered.groupBy(F.expr(f"i div {block}").alias("b")).agg(F.collect_list("f").alias("fs")).select("fs")
    far = F.array_min(F.transform("fs", lambda f: sum((F.pow(F.col(o) - f[f"_{o}"], 2) for o in objectives), F.lit(0.0))))
    near = points.select(*objectives).withColumn("_id", F.monotonically_increasing_id()).crossJoin(blocks).groupBy("_id").agg(F.min(far).alias("d"))
    return near.agg(F.avg(F.sqrt("d")).alias("distance"))


def _swept(x: np.ndarray, reference: np.ndarray) -> float:
    """Volume between points and reference: over the last objective in order, what the points so far cover in the others."""
    x = x[(x < reference).all(1)]
    if not len(x):
        return 0.0
    if x.shape[1] == 1:
        return float(reference[0] - x.min())
    x = x[np.argsort(x[:, -1], kind="stable")]
    ends = np.append(x[1:, -1], reference[-1])
    if x.shape[1] > 2:
        return float(sum(_swept(x[: i + 1, :-1], reference[:-1]) * (ends[i] - x[i, -1]) for i in range(len(x)) if ends[i] > x[i, -1]))
    least = np.minimum.accumulate(x[:, 0])
    return float(((reference[0] - least) * (ends - x[:, 1])).sum())


def hypervolume(points: DataFrame, by: str, objectives: list[str], reference: list[float]) -> DataFrame:
    """Per key (a run or method) the volume that its points dominate up to the reference; points beyond it add nothing.

    For two objectives the front is swept in order by windows. For more, a key's points come together in one task: a run
    has as many as its steps.
    """
    inside = points.select(by, *[F.col(o).cast("double").alias(o) for o in objectives])
    for o, r in zip(objectives, reference, strict=True):
        inside = inside.filter(F.col(o) < r)
    if len(objectives) == 2:
        a, b = objectives
        steps = inside.groupBy(by, a).agg(F.min(b).alias(b))
        earlier = Window.partitionBy(by).orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
        best = F.least(F.coalesce(F.min(b).over(earlier), F.lit(float(reference[1]))), F.lit(float(reference[1])))
        area = F.greatest(F.lit(0.0), best - F.col(b)) * (reference[0] - F.col(a))
        found = steps.select(by, area.alias("area")).groupBy(by).agg(F.sum("area").alias("hypervolume"))
    else:
        limit = np.array(reference, float)
        found = inside.groupBy(by).applyInPandas(lambda k, f: pd.DataFrame({by: [k[0]], "hypervolume": [_swept(f[objectives].to_numpy()[_undominated(f[objectives].to_numpy())], limit)]}), f"{by} {dict(points.dtypes)[by]}, hypervolume double")
    return points.select(by).distinct().join(found, by, "left").fillna(0.0, ["hypervolume"])


def running_sum(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    return df.withColumn("running", F.sum(column).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def band(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(column).alias("low"), F.avg(column).alias("mean"), F.max(column).alias("high"), F.var_pop(column).alias("var"))
