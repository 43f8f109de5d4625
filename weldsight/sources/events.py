"""The event table seen as the readings of eight machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.config import SCALED, TERMINAL_CODES, Profile

GUNS = 8


def sensor_view(spark: SparkSession, sf_dir: str, profile: Profile = SCALED) -> DataFrame:
    """gun, class, event_id, us, slot, value, k, code, nw, buys (a running counter), in no order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in TERMINAL_CODES])
    rows = e.select(
        (F.col("user_id") % GUNS).cast("int").alias("gun"),
        F.concat(F.lit("E0"), (F.col("user_id") % 4 + 1).cast("string")).alias("class"),
        "event_id",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"),
        "value", k.alias("k"),
        F.when(F.col("event_type") == "error", codes[F.pmod(k, F.lit(4))]).when(F.col("event_type") == "signup", "E003").otherwise("0").alias("code"),
        (F.col("event_type") == "view").alias("nw"),
        (F.col("event_type") == "purchase").cast("int").alias("buy"),
    )
    rows = rows.withColumn("slot", F.floor(F.col("us") / (profile.slot_s * 1_000_000)).cast("long"))
    # the running count is that of the slots before and a gun's readings within its slot: only slots are summed by gun
    earlier = Window.partitionBy("gun").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("gun", "slot").agg(F.sum("buy").alias("_n")).select("gun", "slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    arrival = Window.partitionBy("gun", "slot").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, ["gun", "slot"]).withColumn("buys", F.col("_before") + F.sum("buy").over(arrival)).drop("buy", "_before")
