"""Derived features of a shaped series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weldsight.config import TERMINAL_CODES, Profile

CODES = list(TERMINAL_CODES)


def segment():
    return Window.partitionBy("gun", "segment").orderBy("slot")


def counter_delta(rows: DataFrame) -> DataFrame:
    """Increase of the counter within a segment, never negative."""
    return rows.withColumn("buys_delta", F.coalesce(F.greatest(F.col("buys") - F.lag("buys").over(segment()), F.lit(0)), F.lit(0)))


def rolling(rows: DataFrame, slots: int) -> DataFrame:
    """Sums and shares over the last ``slots`` slots of the segment."""
    frame = segment().rangeBetween(-(slots - 1), 0)
    return rows.withColumn("buys_roll", F.sum("buys_delta").over(frame)).withColumn("duty_roll", F.avg((F.col("value") > 50).cast("double")).over(frame)).withColumn("error_share", F.avg((F.col("code") != "0").cast("double")).over(frame))


def states(rows: DataFrame) -> DataFrame:
    """error_active, terminal_code (of the own class), terminal_any and terminal_idx (1 to 4, else 0)."""
    idx = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code")).cast("int")
    classes = F.create_map(*[F.lit(x) for kv in TERMINAL_CODES.items() for x in kv])
    own = F.coalesce((classes[F.col("code")] == F.col("class")).cast("int"), F.lit(0))
    return rows.withColumn("error_active", (F.col("code") != "0").cast("int")).withColumn("terminal_code", own).withColumn("terminal_any", (idx > 0).cast("int")).withColumn("terminal_idx", idx)


def clock(rows: DataFrame, slot_s: int) -> DataFrame:
    """hour_sin, hour_cos of the hour with its minutes, and the day of the week (Monday is 0)."""
    seconds = F.col("slot") * slot_s
    hour = (F.floor(seconds / 60) % 1440).cast("double") / 60
    angle = hour * (2 * 3.141592653589793 / 24)
    return rows.withColumn("hour_sin", F.sin(angle)).withColumn("hour_cos", F.cos(angle)).withColumn("dow", ((F.floor(seconds / 86400) + 3) % 7).cast("int"))


def featured(rows: DataFrame, profile: Profile) -> DataFrame:
    return clock(states(rolling(counter_delta(rows), profile.rolling_slots)), profile.slot_s)
