"""Tumbling, clock-aligned windows within segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weldsight.config import Profile

FEATURES = ("value", "k", "error_share")
KEYS = ("gun", "class", "segment", "win")


def window_stats(rows: DataFrame, profile: Profile, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Means, then sample deviations (0 for one row), flags by maximum, the share without welding, ttf and n."""
    stats = [F.avg(c).alias(f"{c}_mean") for c in features] + [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in features]
    flags = [F.max(c).alias(c) for c in ("error_active", "terminal_code", "terminal_any", "terminal_idx", "label")]
    keyed = rows.withColumn("win", F.floor(F.col("slot") / profile.window_slots).cast("long"))
    return keyed.groupBy(*KEYS).agg(*stats, *flags, F.avg(F.col("nw").cast("double")).alias("non_welding"), F.min("ttf_s").alias("ttf_s"), F.count(F.lit(1)).alias("n"))


def filled_windows(windows: DataFrame, profile: Profile) -> DataFrame:
    return windows.filter(F.col("n") >= profile.min_samples)
