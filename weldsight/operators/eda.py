"""Exploration of shaped series: episodes, gaps, summaries, correlations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weldsight.operators.shape import by_gun, past

_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def episodes(rows: DataFrame) -> DataFrame:
    """Unbroken runs of one state code other than 0."""
    change = F.coalesce((F.col("code") != F.lag("code").over(by_gun())).cast("int"), F.lit(1))
    runs = rows.withColumn("_c", change).withColumn("_e", F.sum("_c").over(past()))
    return runs.filter("code <> '0'").groupBy("gun", "class", "code", "_e").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("slots"), F.min("ttf_s").alias("end_ttf")).drop("_e")


def episode_stats(found: DataFrame, slot_s: int) -> DataFrame:
    hours = F.col("slots") * slot_s / 3600.0
    return found.groupBy("class", "code").agg(F.countDistinct("gun").alias("guns"), F.count(F.lit(1)).alias("episodes"), F.sum(hours).alias("hours"), F.percentile(hours, F.lit(0.5)).alias("median_h"), F.max(hours).alias("max_h"), F.min("end_ttf").alias("min_end_ttf"))


def gaps(grid: DataFrame) -> DataFrame:
    """Lengths in slots of the runs of absent slots."""
    island = grid.withColumn("_i", F.sum("present").over(past()))
    return island.filter("present = 0").groupBy("gun", "class", "_i").agg(F.count(F.lit(1)).alias("gap")).drop("_i")


def gap_stats(found: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("gap", F.lit(p))
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"), F.min("gap").alias("min"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("gap").alias("max"))


def file_summary(grid: DataFrame, max_missing: float, slot_s: int) -> DataFrame:
    """Per gun: rows, span, missing share, gaps, codes, and whether the file is dropped."""
    base = grid.groupBy("gun", "class").agg(F.sum("present").alias("rows"), F.count(F.lit(1)).alias("grid_rows"), F.avg((F.col("nw") & (F.col("present") == 1)).cast("double")).alias("nw_share"), F.countDistinct("code").alias("codes"), F.max_by("code", "slot").alias("last_code"), F.max("buys").alias("buys"), F.countDistinct("k").alias("k_nunique"))
    holes = gaps(grid).groupBy("gun").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("longest_gap"))
    missing = 1 - F.col("rows") / F.col("grid_rows")
    return base.join(holes, "gun", "left").withColumn("missing", missing).withColumn("hours", F.col("grid_rows") * slot_s / 3600.0).withColumn("dropped", (missing > max_missing).cast("int"))


def class_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.avg("missing").alias("missing"), F.max("longest_gap").alias("longest_gap"), F.sum("hours").alias("hours"))


def kept_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.filter("dropped = 1").select("gun"), "gun", "left_anti")


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """By class and column: count, zero share, distinct values, moments and quantiles; one pass over unpivoted rows."""
    long = rows.select("class", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("u")).select("class", "u.*")
    q = lambda p: F.percentile("x", F.lit(p))
    return long.groupBy("class", "name").agg(F.count("x").alias("n"), F.avg((F.col("x") == 0).cast("double")).alias("zero_share"), F.countDistinct("x").alias("nunique"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), q(0.01).alias("p01"), q(0.5).alias("p50"), q(0.99).alias("p99"), F.max("x").alias("max"))


def column_constancy(rows: DataFrame, columns: list[str]) -> DataFrame:
    each = rows.groupBy("gun").agg(*[F.countDistinct(c).alias(c) for c in columns])
    long = each.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("u")) for c in columns])).alias("s")).select("s.*")
    return long.groupBy("name").agg(F.sum((F.col("u") == 1).cast("int")).alias("constant_files"), F.percentile("u", F.lit(0.5)).alias("median_nunique"))


def correlations(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns over rows that have both; null where one is constant. One aggregate
    over all pairs, from covariance and deviations: ``corr`` itself fails on constant columns in ANSI mode."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def corr(a: str, b: str) -> Column:
        x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    wide = rows.groupBy(*(by or [])).agg(*[corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*(by or []), F.explode(cells).alias("c")).select(*(by or []), "c.*")


def correlation_matrix(rows: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """``correlations`` of many columns: each partition adds up its sums of products as matrices, around the columns'
    means of the key, and Spark adds those by pair. A column whose deviation is under a millionth of what the rows of a pair
    differ from its mean, or a billionth of that mean, counts as constant."""
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    keyed = rows.select(key.alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    means = keyed.groupBy("key").agg(F.array(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)) for i in range(len(columns))]).alias("m"))
    places = np.triu_indices(len(columns))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            coded = b.column(0).dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for i, name in enumerate(names):
                part = x[codes == i]
                here = (~np.isnan(part)).astype(float)
                part = np.where(here > 0, part, 0.0)
                square = part * part
                held[name] = held.get(name, 0.0) + np.stack([here.T @ here, part.T @ here, here.T @ part, square.T @ here, here.T @ square, part.T @ part])
        for name, sums in held.items():
            cells = [s[places] for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places[0]), pa.string()), *[pa.array(p, pa.int32()) for p in places], *[pa.array(c) for c in cells]], names=["key", "i", "j", *_SUMS])

    around = keyed.join(means, "key").select("key", *[(F.col(f"x{i}") - F.col("m")[i]).alias(f"x{i}") for i in range(len(columns))])
    sums = around.mapInArrow(partial, "key string, i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    total = sums.groupBy("key", "i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("n > 0").join(means, "key")
    x, y = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    names = F.array(*[F.lit(c) for c in columns])
    moved = total.select("key", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), (F.col("xy") / F.col("n") - x * y).alias("c"), *[v.alias(n) for n, v in (("vx", F.col("xx") / F.col("n") - x * x), ("vy", F.col("yy") / F.col("n") - y * y), ("lx", 1e-12 * x * x + 1e-18 * F.col("m")[F.col("i")] ** 2), ("ly", 1e-12 * y * y + 1e-18 * F.col("m")[F.col("j")] ** 2))])
    corr = F.when((F.col("vx") > F.col("lx")) & (F.col("vy") > F.col("ly")), F.try_divide(F.col("c"), F.sqrt("vx") * F.sqrt("vy"))).alias("corr")
    return moved.select(*([F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias(by)] if by else []), "a", "b", corr)


def code_share_by_ttf(rows: DataFrame, bucket) -> DataFrame:
    counts = rows.withColumn("bucket", bucket).groupBy("class", "bucket", "code").agg(F.count(F.lit(1)).alias("slots"))
    return counts.withColumn("share", F.col("slots") / F.sum("slots").over(Window.partitionBy("class", "bucket")))


def code_rate_by_ttf(rows: DataFrame, found: DataFrame, bucket, bucket_end, slot_s: int) -> DataFrame:
    """Episode starts per present hour, by class and bucket."""
    hours = rows.withColumn("bucket", bucket).groupBy("class", "bucket").agg((F.sum("present") * slot_s / 3600.0).alias("hours"))
    starts = found.withColumn("bucket", bucket_end).groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("episodes"))
    return hours.join(starts, ["class", "bucket"], "left").select("class", "bucket", F.coalesce("episodes", F.lit(0)).alias("episodes"), F.when(F.col("hours") > 0, F.coalesce("episodes", F.lit(0)) / F.col("hours")).alias("per_hour"))


def codes_near_failure(rows: DataFrame, seconds: int, codes: list[str]) -> DataFrame:
    """Class by code: guns in whose last ``seconds`` the code occurs."""
    near = rows.filter(F.col("ttf_s") <= seconds)
    return near.groupBy("class").agg(*[F.countDistinct(F.when(F.col("code") == c, F.col("gun"))).alias(c) for c in codes])


def hour_profile(rows: DataFrame, slot_s: int) -> DataFrame:
    hour = (F.floor(F.col("slot") * slot_s / 3600) % 24).cast("int")
    return rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("nw")).cast("double")).alias("welding_share"), F.avg("value").alias("value_mean"))
