"""Exploration of the machine's files: its tables as CSV and a short report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.config import REAL, Profile
from weldsight.operators import eda, shape, summaries
from weldsight.plans.machine import COUNTERS, MAX_MISSING
from weldsight.plans.stored import stored
from weldsight.sources.files import SENSORS

NUMBERS = tuple(c for c in SENSORS if c != "c10")
SPEC = summaries.Spec({"outlier_rate": "c16 <= 0", "c10_on_share": "c10 = 1", "c2_zero_share": "c2 = 0", "c5_zero_share": "c5 = 0"}, {name: c for c, name in COUNTERS.items()}, NUMBERS, MAX_MISSING)


def time_left(seconds: Column) -> Column:
    """The buckets of time to failure at the machine's rate."""
    return F.when(seconds <= 600, "last 10 min").when(seconds <= 3600, "10 min-1 h").when(seconds <= 21_600, "1-6 h").when(seconds <= 86_400, "6-24 h").otherwise("> 24 h")


def tables(readings: DataFrame, profile: Profile = REAL, spec: summaries.Spec = SPEC, columns: tuple[str, ...] = NUMBERS) -> dict[str, DataFrame]:
    """All tables by name, of valid readings as ``machine.readings`` gives them."""
    grid = stored(shape.carry_code(shape.grid_align(shape.dedup_last(readings.drop("number", "class_source")))))
    rows = grid.withColumn("ttf_s", (F.max("slot").over(Window.partitionBy("gun")) - F.col("slot")) * profile.slot_s)
    here = rows.filter("present = 1").withColumn("nw", F.coalesce(F.col("c16") <= 0, F.lit(False))).withColumn("label", (F.col("ttf_s") <= profile.label_s).cast("int"))
    files = stored(summaries.file_report(grid, readings.groupBy("gun").agg(F.count(F.lit(1)).alias("n_raw_rows")), profile, spec))
    runs = stored(summaries.code_runs(grid, profile))
    codes = [r.code for r in runs.select("code").distinct().orderBy("code").collect()]  # E and three digits: a thousand at most
    target = eda.correlation_matrix(here, [*columns, "label"])
    return {
        "file_summary": files,
        "class_summary": summaries.class_report(files, spec),
        "gap_stats": summaries.gap_report(grid),
        "column_stats_by_class": eda.column_stats(here, list(columns)),
        "column_constancy": eda.column_constancy(here, list(columns)),
        "error_episodes": runs,
        "error_code_stats_by_class": summaries.episode_report(runs, profile.slot_s),
        "error_code_time_share_by_ttf": eda.code_share_by_ttf(rows, time_left(F.col("ttf_s"))),
        "error_code_episode_rate_by_ttf": eda.code_rate_by_ttf(rows, runs, time_left(F.col("ttf_s")), time_left(F.col("end_ttf")), profile.slot_s),
        "codes_in_last10min_by_class": summaries.codes_at_the_end(files, codes),
        "last_code_by_class": summaries.last_codes(files, codes),
        "hourly_ttf_profile_by_file": summaries.hourly_profile(here, list(columns)),
        "scm_overall": eda.correlation_matrix(here, list(columns)),
        "scm_by_class": eda.correlation_matrix(here, list(columns), "class"),
        "target_correlations": target.filter("b = 'label' AND a <> 'label'"),
    }


def explore(spark: SparkSession, source: str, target: str, profile: Profile = REAL) -> None:
    """Tables (CSV with header) and report (markdown) below ``target``, of what ``machine.preprocess`` wrote to ``source``."""
    made = tables(spark.read.parquet(f"{source}/readings"), profile)
    for name, table in made.items():
        rows = table if name in ("error_episodes", "hourly_ttf_profile_by_file") else table.repartition(1)  # the others have a row for each file, class or column
        rows.write.mode("overwrite").option("header", True).csv(f"{target}/{name}")
    totals = made["file_summary"].agg(F.count(F.lit(1)), F.sum("n_raw_rows"), F.sum("discarded"), F.sum("n_error_episodes")).first()
    head = ["class", "files", "missing_rate", "discarded", *SPEC.shares, "n_error_episodes", "error_state_share"]
    cells = [[str(round(x, 5)) if isinstance(x, float) else str(x) for x in r] for r in made["class_summary"].select(*head).orderBy("class").collect()]
    lines = ["# Exploration", "", f"{totals[0]} files, {totals[1]} readings, {totals[2]} files discarded, {totals[3]} episodes of error states", "", *["| " + " | ".join(r) + " |" for r in (head, ["-"] * len(head), *cells)], "", "Tables: " + ", ".join(made)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/report.md")
