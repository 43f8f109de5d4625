"""Files played again as requests to online scoring, the answers as JSON lines, and what they come to."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weldsight.streaming import serving
from weldsight.streaming.serving import Card

#: Seconds of the machines' time that a micro-batch holds.
WAVE_S = 21_600


def as_requests(readings: DataFrame, card: Card, chunk_s: int = 60, start_hours: float = 0.0, reset: bool = True) -> DataFrame:
    """Readings (gun, slot, event_id, code, sensors) as requests of ``chunk_s`` seconds, numbered from 1 at a gun's first
    reading; those of its first ``start_hours`` are left out. With ``reset`` request 0 clears the gun.

    Chunks longer than a request may be are refused. Chunks without readings are no requests.
    """
    slots = chunk_s // card.profile.slot_s
    if not 1 <= slots <= card.longest:
        raise ValueError(f"a request takes up to {card.longest * card.profile.slot_s} seconds, not {chunk_s}")
    first = readings.groupBy("gun").agg(F.min("slot").alias("_first"))
    since = F.col("slot") - F.col("_first")
    timed = readings.join(first, "gun").filter(since * card.profile.slot_s >= start_hours * 3600)
    rows = timed.withColumn("request", F.floor(since / slots) + 1).withColumn("arrival", F.col("event_id")).withColumn("t", F.col("slot")).withColumn("control", F.lit(""))
    out = serving.requests(rows, card)
    if reset:
        none = [F.lit(None).cast("double").alias(c) for c in card.sensors]
        clear = first.select("gun", F.lit(0).alias("request"), F.lit(0).alias("arrival"), F.lit(0).alias("t"), F.lit("0").alias("code"), F.lit("reset").alias("control"), *none)
        out = out.unionByName(serving.requests(clear, card))
    return out


def play(readings: DataFrame, card: Card, folder: str, chunk_s: int = 60, start_hours: float = 0.0, reset: bool = True, wave_s: int = WAVE_S, speed: float | None = None) -> DataFrame:
    """Answers to all requests, a row each; kept below ``folder`` with the stream's state, so that a later call without
    ``reset`` and from a later hour goes on from there.

    Requests go in waves of ``wave_s`` seconds, so that a task holds no more of a gun than that; with ``speed`` a wave
    waits until it is due at so many times the machines' pace.
    """
    spark = readings.sparkSession
    wave = F.floor(F.col("request") * chunk_s / max(wave_s, chunk_s)).cast("int")
    made = as_requests(readings, card, chunk_s, start_hours, reset)
    began = time.time()
    stage = f"{folder}/waves-{time.time_ns()}"
    made.withColumn("wave", wave).repartition("wave", "gun").write.partitionBy("wave").parquet(stage)
    waves = spark.read.parquet(stage)
    answers = None
    for number, row in enumerate(waves.select("wave").distinct().orderBy("wave").collect()):  # a row for each wave
        waves.filter(F.col("wave") == row.wave).drop("wave").write.mode("append").parquet(f"{folder}/requests")
        if speed:
            time.sleep(max(0.0, number * wave_s / speed - (time.time() - began)))
        answers = serving.run(spark.readStream.schema(made.schema).parquet(f"{folder}/requests"), card, folder)
    return spark.createDataFrame([], serving.RESULT) if answers is None else answers


def summary(answers: DataFrame) -> DataFrame:
    """Per gun: requests answered, scored, not ready and refused; windows, hand-offs, triggers and repeats; highest score,
    and end of the first critical window and severity of the last one."""
    rows = answers.filter("status NOT IN ('reset', 'unknown')")
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return rows.groupBy("gun").agg(
        F.count(F.lit(1)).alias("requests"), count(F.col("status") == "ok").alias("scored"), count(F.col("status") == "warming_up").alias("not_ready"), count(F.col("status") == "rejected").alias("refused"),
        F.coalesce(F.sum("windows_scored"), F.lit(0)).alias("windows"), count(F.col("hands_off")).alias("events"), count(F.col("rule_triggered")).alias("triggers"), count(F.col("rule_repeat")).alias("repeats"),
        F.max("anomaly_score").alias("top_score"), F.min(F.when(F.col("critical_in_request"), F.col("window_end"))).alias("first_critical"), F.max_by("severity", F.when(F.col("severity").isNotNull(), F.col("request"))).alias("last_severity"),
    )


def write_answers(answers: DataFrame, target: str) -> None:
    """JSON lines, a folder for each gun in the order of its requests, and the summary (CSV)."""
    answers.repartition("gun").sortWithinPartitions("gun", "request").write.mode("overwrite").partitionBy("gun").json(f"{target}/responses")
    summary(answers).repartition(1).sortWithinPartitions("gun").write.mode("overwrite").option("header", True).csv(f"{target}/summary")
