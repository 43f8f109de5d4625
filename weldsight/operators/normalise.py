"""Scaling over all machines, then of each machine by its warm-up; thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weldsight.config import Profile
from weldsight.operators.evaluate import quantile, quantiles

SCALED_COLUMNS = ("value", "k")
SCORED_COLUMNS = ("value_mean", "k_mean", "value_std", "k_std")


def normal(rows: DataFrame) -> DataFrame:
    return rows.filter("label = 0 AND error_active = 0")


def scaler_fit(rows: DataFrame, columns: tuple[str, ...] = SCALED_COLUMNS) -> DataFrame:
    """One row: mean and deviation (1 for 0) of each column over normal rows."""
    stats = []
    for c in columns:
        std = F.stddev_samp(c)
        stats += [F.avg(c).alias(f"{c}_mu"), F.when(std > 0, std).otherwise(1.0).alias(f"{c}_sd")]
    return normal(rows).agg(*stats)


def zscore(rows: DataFrame, scaler: DataFrame, columns: tuple[str, ...] = SCALED_COLUMNS) -> DataFrame:
    joined = rows.join(F.broadcast(scaler))  # one row
    return joined.select(*[((F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def warmup_stats(rows: DataFrame, profile: Profile, columns: tuple[str, ...] = SCALED_COLUMNS) -> DataFrame:
    """Per gun: mean, deviation of the population with a floor, and count of its warm-up's normal welding readings.

    warm_end is the first slot after the warm-up. own tells whether the readings suffice to scale the gun by itself;
    a gun without enough of them (or none) keeps the scaling over all machines.
    """
    length = profile.warmup_s // profile.slot_s
    warm = rows.withColumn("_first", F.min("slot").over(Window.partitionBy("gun"))).filter(F.col("slot") < F.col("_first") + length)
    ok = (F.col("error_active") == 0) & ~F.coalesce(F.col("nw").cast("boolean"), F.lit(False))
    stats = []
    for c in columns:
        used = F.when(ok, F.col(c))
        stats += [F.avg(used).alias(f"{c}_gm"), F.greatest(F.stddev_pop(used), F.lit(profile.std_floor)).alias(f"{c}_gs")]
    out = warm.groupBy("gun").agg(*stats, F.sum(ok.cast("long")).alias("warm_n"), (F.min("_first") + length).alias("warm_end"))
    return out.withColumn("own", F.col("warm_n") >= profile.warmup_rows)


def recentre(rows: DataFrame, stats: DataFrame, mode: str = "center", warm: bool = False, columns: tuple[str, ...] = SCALED_COLUMNS) -> DataFrame:
    """Readings after the warm-up less their gun's mean (over its deviation if mode is scale), those of the warm-up as
    they are. With ``warm`` only the warm-up's readings of guns that have statistics of their own, scaled as well."""
    joined = rows.join(stats, "gun")  # every gun has a row
    inside = F.col("slot") < F.col("warm_end")
    if warm:
        joined, use = joined.filter(inside & F.col("own")), F.lit(True)
    else:
        use = ~inside & F.col("own")
    changed = {c: F.when(use, (F.col(c) - F.col(f"{c}_gm")) / (F.col(f"{c}_gs") if mode == "scale" else F.lit(1.0))).otherwise(F.col(c)) for c in columns}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns])


def mark_warmup(windows: DataFrame, stats: DataFrame, profile: Profile) -> DataFrame:
    """warmup is 1 for windows that start in their gun's warm-up."""
    joined = windows.join(stats.select("gun", "warm_end"), "gun")
    return joined.withColumn("warmup", (F.col("win") * profile.window_slots < F.col("warm_end")).cast("int")).drop("warm_end")


def distance_score(windows: DataFrame, columns: tuple[str, ...] = SCORED_COLUMNS) -> DataFrame:
    """A score in (0, 1) that grows with the distance from normal; nine places, so that ties are ties."""
    far = sum((F.abs(F.col(c)) for c in columns), F.lit(0.0)) / len(columns)
    return windows.withColumn("score", F.round(1 - F.exp(-far), 9))


def global_threshold(scored: DataFrame, q: float) -> DataFrame:
    """One row with the quantile of the scores of normal windows, by counted ranges."""
    return scored.sparkSession.createDataFrame([(quantile(normal(scored), "score", q),)], "threshold double")


def gun_threshold(scored: DataFrame, calibration: DataFrame, overall: DataFrame, profile: Profile) -> DataFrame:
    """Per gun the larger of the overall threshold and the quantile of its scored calibration windows, if there are
    enough of those; overall stays beside it for the warm-up.

    ``calibration`` holds all windows of the warm-up, errors too, scaled by the gun's own statistics.
    """
    own = calibration.groupBy("gun").agg(F.percentile("score", F.lit(profile.quantile)).alias("q"), F.count(F.lit(1)).alias("windows"))
    guns = scored.select("gun").distinct().join(own, "gun", "left").join(F.broadcast(overall.toDF("overall")))  # one row
    own_or_all = F.when(F.col("windows") >= profile.warmup_windows, F.greatest("overall", "q")).otherwise(F.col("overall"))
    return guns.select("gun", own_or_all.alias("threshold"), "overall", F.coalesce("windows", F.lit(0)).alias("windows"))


def feature_reference(windows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Medians of the columns over normal windows: what attribution puts in a feature's place."""
    medians = quantiles(normal(windows), list(columns), 0.5)
    return windows.sparkSession.createDataFrame([tuple(medians[c] for c in columns)], ", ".join(f"{c} double" for c in columns))
