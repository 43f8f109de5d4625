"""Alarms on scored windows and rule triggers on state codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weldsight.config import Profile
from weldsight.operators.ordered import ordered_pass
from weldsight.operators.shape import by_gun, past


def alarms(scored: DataFrame, thresholds: DataFrame, profile: Profile) -> DataFrame:
    """alarm, and held where the gate (the share without welding) holds an alarm back.

    Windows of the warm-up are judged by the threshold over all machines, later ones by their gun's own.
    """
    joined = scored.join(thresholds.select("gun", F.col("threshold").alias("_own"), "overall"), "gun")
    joined = joined.withColumn("threshold", F.when(F.col("warmup") == 1, F.col("overall")).otherwise(F.col("_own"))).drop("_own", "overall")
    over = F.col("score") > F.col("threshold")
    gated = F.col("non_welding") > profile.gate
    return joined.withColumn("alarm", (over & ~gated).cast("int")).withColumn("held", (over & gated).cast("int"))


def alarm_runs(alarmed: DataFrame, profile: Profile) -> DataFrame:
    """Runs of at least ``sustain`` alarming windows that follow each other."""
    step = (F.col("alarm") != F.coalesce(F.lag("alarm").over(by_gun("win")), F.lit(-1))) | (F.col("win") - F.lag("win").over(by_gun("win")) > 1)
    runs = alarmed.withColumn("_new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(past("win")))
    found = runs.filter("alarm = 1").groupBy("gun", "run").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.count(F.lit(1)).alias("windows"), F.max("ttf_s").alias("start_ttf"), F.min("ttf_s").alias("end_ttf"), F.max("score").alias("top_score"))
    return found.filter(F.col("windows") >= profile.sustain).drop("run")


def final_run(alarmed: DataFrame, runs: DataFrame) -> DataFrame:
    """Per gun the hours before failure at which the run that reaches its last window began, else null."""
    last = alarmed.groupBy("gun").agg(F.max("win").alias("last_win"))
    return last.join(runs, ["gun", "last_win"], "left").select("gun", (F.col("start_ttf") / 3600).alias("final_run_h"))


def false_runs(alarmed: DataFrame, runs: DataFrame, profile: Profile) -> DataFrame:
    """Runs that end long before failure, over the days of that time."""
    spans = alarmed.groupBy("gun").agg(F.max("ttf_s").alias("span"))
    counted = runs.filter(F.col("end_ttf") > profile.false_after_s).groupBy("gun").agg(F.count(F.lit(1)).alias("c"))
    days = (F.col("span") - profile.false_after_s) / 86400.0
    return spans.join(counted, "gun", "left").select("gun", F.coalesce("c", F.lit(0)).alias("false_runs"), F.when(days > 0, F.coalesce("c", F.lit(0)) / days).alias("false_runs_per_day"))


def sustained(alarmed: DataFrame, profile: Profile) -> DataFrame:
    """Per window how long the alarm has lasted and whether that sustains it."""
    since = F.max(F.when(F.col("alarm") == 0, F.col("win"))).over(past("win"))
    lasted = F.when(F.col("alarm") == 1, F.col("win") - F.coalesce(since, F.min("win").over(Window.partitionBy("gun")) - 1)).otherwise(0)
    return alarmed.withColumn("alarm_windows", lasted).withColumn("sustained", (lasted >= profile.sustain).cast("int"))


def onsets(rows: DataFrame, order: str = "win") -> DataFrame:
    """Rows at which terminal_any goes from 0 to 1; the first row is one if it has 1."""
    before = F.lag("terminal_any").over(Window.partitionBy("gun").orderBy(order))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).filter("terminal_any = 1 AND _before = 0").drop("_before")


def cooled(onset: DataFrame, cooldown: int, order: str = "win") -> DataFrame:
    """Onsets that fire: each at least ``cooldown`` after the last that fired, in units of ``order``.

    Each depends on the ones before, so that a gun's onsets are passed in order.
    """

    def step(last, row):
        t, idx, ttf = row
        if last is not None and t - last < cooldown:
            return last, None
        return t, (idx, ttf)

    rows = onset.withColumn(order, F.col(order).cast("long")).withColumn("_t", F.col(order).cast("long")).withColumn("terminal_idx", F.col("terminal_idx").cast("int")).withColumn("ttf_s", F.col("ttf_s").cast("long"))
    return ordered_pass(rows, "gun", order, ["_t", "terminal_idx", "ttf_s"], "terminal_idx int, ttf_s long", step)


def repeats(fired: DataFrame, repeat_s: int, order: str = "win") -> DataFrame:
    """A trigger repeats if the same code's last one was under ``repeat_s`` before."""
    before = F.lag("ttf_s").over(Window.partitionBy("gun", "terminal_idx").orderBy(order))
    return fired.withColumn("repeat", F.coalesce((before - F.col("ttf_s") < repeat_s).cast("int"), F.lit(0)))


def triggers(windows: DataFrame, profile: Profile) -> DataFrame:
    step = profile.window_slots * profile.slot_s
    return repeats(cooled(onsets(windows), -(-profile.cooldown_s // step)), profile.repeat_s)


def severity(alarmed: DataFrame, fired: DataFrame, profile: Profile) -> DataFrame:
    """critical: sustained, or a trigger that is no repeat; warning: an alarm or a repeat; else normal."""
    joined = sustained(alarmed, profile).join(fired.select("gun", "win", F.lit(1).alias("fired"), "repeat"), ["gun", "win"], "left")
    rule = F.coalesce("fired", F.lit(0)) == 1
    level = F.when((F.col("sustained") == 1) | (rule & (F.col("repeat") == 0)), "critical").when((F.col("alarm") == 1) | rule, "warning").otherwise("normal")
    return joined.withColumn("severity", level).withColumn("fired", F.coalesce("fired", F.lit(0))).withColumn("repeat", F.coalesce("repeat", F.lit(0)))


def rising(severities: DataFrame) -> DataFrame:
    """Windows that hand a document on: the first of a critical stretch, and every trigger that is no repeat."""
    before = F.lag("severity").over(by_gun("win"))
    new = (F.col("severity") == "critical") & (F.coalesce(F.col("_before"), F.lit("normal")) != "critical")
    return severities.withColumn("_before", before).filter(new | ((F.col("fired") == 1) & (F.col("repeat") == 0))).drop("_before")
