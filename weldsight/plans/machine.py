"""The machine's own files, all sensor columns: from CSV to scaled series, windows and what a run leaves behind.

The key ``gun`` is the file here, as a file is one machine up to one failure; its number stays as ``number``.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.config import REAL, TERMINAL_CODES, Profile
from weldsight.operators import features, normalise, shape, windows
from weldsight.sources.files import SENSORS, read_machine_csv, validated

COUNTERS = {"c11": "welds", "c12": "pos"}
CARRIED = tuple(c for c in SENSORS if c not in COUNTERS)
#: Columns that are scaled, and inputs of the model in their order; everything else is metadata.
SCALED_COLUMNS = tuple("c1 c2 c3 c4 c5 c6 c7 c8 c9 c13 c14 c15 c16 c17 c18 c19 welds_delta welds_10min pos_delta".split())
MODEL_FEATURES = tuple("welds_delta pos_delta welds_10min weld_duty_10min error_share_10min c1 c2 c3 c4 c5 c6 c7 c8 c9 c13 c14 c15 c16 c17 c18 c19 c10 hour_sin hour_cos".split())
STATIC, CLOCK = ("c7", "c8", "c9"), ("hour_sin", "hour_cos")
STORED = ("file", "class", "number", "segment", "slot", *SCALED_COLUMNS, "c10", "weld_duty_10min", "error_share_10min", *CLOCK, "dow", "code", "error_active", "terminal_code", "terminal_any", "terminal_idx", "nw", "ttf_s", "label")
MAX_MISSING = 0.4


def model_features(drop: tuple[str, ...] = ("c19",), drop_static: bool = False, drop_clock: bool = False) -> tuple[str, ...]:
    """The inputs without those dropped; a name that is no input is an error."""
    unknown = set(drop) - set(MODEL_FEATURES)
    if unknown:
        raise ValueError(f"not inputs of the model: {sorted(unknown)}")
    gone = {*drop, *(STATIC if drop_static else ()), *(CLOCK if drop_clock else ())}
    return tuple(f for f in MODEL_FEATURES if f not in gone)


def readings(raw: DataFrame, rule_s: int = REAL.rule_s) -> DataFrame:
    """Valid readings in the shape the operators take. A file without a class in its name has that of its latest
    terminal code in its last ``rule_s`` seconds, or none; class_source tells which."""
    valid = validated(raw.withColumn("event_id", F.monotonically_increasing_id()))[0]
    timed = valid.withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', time)")).withColumn("c10", F.col("c10").cast("int"))
    last = F.max(F.when(F.col("error").isin(list(TERMINAL_CODES)), F.struct("us", "event_id", "error")))
    ends = timed.groupBy("file").agg(F.max("us").alias("_end"), last.alias("_l"))
    near = ends.select("file", F.when(F.col("_end") - F.col("_l.us") <= rule_s * 1_000_000, F.col("_l.error")).alias("_last"))
    classes = F.create_map(*[F.lit(x) for kv in TERMINAL_CODES.items() for x in kv])
    named = timed.join(near, "file", "left").withColumn("class_source", F.when(F.col("class").isNotNull(), "file name").when(F.col("_last").isNotNull(), F.concat(F.lit("terminal code "), "_last")))
    slot = F.floor(F.col("us") / 1_000_000).cast("long").alias("slot")
    return named.select(F.col("file").alias("gun"), F.col("gun").alias("number"), F.coalesce("class", classes[F.col("_last")]).alias("class"), "class_source", "event_id", "us", slot, F.col("error").alias("code"), *SENSORS)


def manifest(rows: DataFrame, max_missing: float = MAX_MISSING) -> DataFrame:
    """A row for each file: readings, grid, share missing, and why it is dropped (null: kept)."""
    once = rows.groupBy("gun", "slot").agg(*[F.first(c).alias(c) for c in ("number", "class", "class_source")])
    files = once.groupBy("gun").agg(*[F.first(c).alias(c) for c in ("number", "class", "class_source")], F.count(F.lit(1)).alias("rows"), (F.max("slot") - F.min("slot") + 1).alias("grid"))
    missing = files.withColumn("missing", 1 - F.col("rows") / F.col("grid"))
    return missing.withColumn("dropped", F.when(F.col("missing") > max_missing, "missing readings")).withColumnRenamed("gun", "file")


def non_welding(rows: DataFrame, low: float = 0.0, high: float | None = None) -> DataFrame:
    """nw where c16 is at or below ``low``, or above ``high`` if that is given; a null c16 counts as welding."""
    out = F.col("c16") <= low
    return rows.withColumn("nw", F.coalesce(out if high is None else out | (F.col("c16") > high), F.lit(False)))


def derived(rows: DataFrame, profile: Profile) -> DataFrame:
    """Increases of the counters, sums and shares over ten minutes within the segment, states and clock."""
    for counter, name in COUNTERS.items():
        step = F.greatest(F.col(counter) - F.lag(counter).over(features.segment()), F.lit(0.0))
        rows = rows.withColumn(f"{name}_delta", F.coalesce(step, F.lit(0.0)))
    frame = Window.partitionBy("gun", "segment").orderBy("slot").rangeBetween(-(profile.rolling_slots - 1), 0)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")).over(frame)
    rows = rows.withColumn("welds_10min", F.sum("welds_delta").over(frame)).withColumn("weld_duty_10min", share(F.col("c2") > 0)).withColumn("error_share_10min", share(F.col("code") != "0"))
    return features.clock(features.states(rows), profile.slot_s).drop(*COUNTERS)


def series(rows: DataFrame, profile: Profile = REAL, low: float = 0.0, high: float | None = None, max_missing: float = MAX_MISSING) -> DataFrame:
    """The unscaled series of the files that are kept."""
    files = manifest(rows, max_missing).filter("dropped IS NULL").select(F.col("file").alias("gun"))
    kept = rows.join(files, "gun", "left_semi").drop("number", "class_source")
    filled = shape.bounded_fill(shape.carry_code(shape.grid_align(shape.dedup_last(kept))), profile.gap_slots, tuple(SENSORS))
    carried = shape.carry_non_welding(non_welding(shape.segments(filled), low, high), CARRIED)
    return derived(shape.label(carried, profile), profile)


def scaled(rows: DataFrame, scaler: DataFrame | None, mode: str = "global") -> DataFrame:
    """mode global takes the scaler given, per-file one of each file over its normal rows, none leaves the rows."""
    if mode == "none":
        return rows
    if mode == "global":
        return normalise.zscore(rows, scaler, SCALED_COLUMNS)
    if mode != "per-file":
        raise ValueError(f"unknown scale mode {mode}")
    stats = []
    for c in SCALED_COLUMNS:
        std = F.stddev_samp(c)
        stats += [F.avg(c).alias(f"{c}_mu"), F.when(std > 0, std).otherwise(1.0).alias(f"{c}_sd")]
    joined = rows.join(normalise.normal(rows).groupBy("gun").agg(*stats), "gun", "left")
    # a file without normal rows keeps its values
    own = {c: F.coalesce((F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd"), F.col(c)) for c in SCALED_COLUMNS}
    return joined.select(*[own[c].alias(c) if c in own else F.col(c) for c in rows.columns])


def model_windows(rows: DataFrame, profile: Profile = REAL, inputs: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    return windows.filled_windows(windows.window_stats(rows, profile, inputs), profile)


def training(wins: DataFrame, exclude_non_welding: bool = False) -> DataFrame:
    """Normal windows, on demand only those that weld throughout."""
    out = normalise.normal(wins)
    return out.filter("non_welding = 0") if exclude_non_welding else out


def preprocess(spark: SparkSession, source: str, target: str, split: str = "train", profile: Profile = REAL, mode: str = "global", max_missing: float = MAX_MISSING, scaler_from: str | None = None) -> None:
    """Writes series (Parquet by split and file, 32-bit floats), manifest (CSV), config and scaler (JSON) below ``target``,
    and beside them the readings: those that are valid, and the others as they came in ``quarantine``.

    Only the train split fits and writes a scaler. The test split reads scaler and config of ``scaler_from``, and takes
    the label window from there.
    """
    if split == "test":
        config = spark.read.json(f"{scaler_from}/preprocess_config.json").first()
        profile, mode = dataclasses.replace(profile, label_s=config.label_s), config.scale
    raw = read_machine_csv(spark, source)
    validated(raw)[1].write.mode("overwrite").parquet(f"{target}/quarantine")
    readings(raw, profile.rule_s).write.mode("overwrite").parquet(f"{target}/readings")  # parsed once
    rows = spark.read.parquet(f"{target}/readings")
    manifest(rows, max_missing).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{target}/manifest.csv")
    whole = series(rows, profile, max_missing=max_missing)
    whole.write.mode("overwrite").parquet(f"{target}/unscaled")  # shaped once, read for the scaler and for the scaling
    whole = spark.read.parquet(f"{target}/unscaled")
    scaler = None
    if mode == "global":
        if split != "test":
            normalise.scaler_fit(whole, SCALED_COLUMNS).coalesce(1).write.mode("overwrite").json(f"{target}/scaler.json")
        fields = ", ".join(f"{c}_mu double, {c}_sd double" for c in SCALED_COLUMNS)
        scaler = spark.read.schema(fields).json(f"{target if split != 'test' else scaler_from}/scaler.json")
    numbers = rows.groupBy("gun").agg(F.first("number").alias("number"))
    out = scaled(whole, scaler, mode).join(numbers, "gun").withColumn("file", F.col("gun"))
    kinds = dict(out.dtypes)
    stored = out.select(*[F.col(c).cast("float").alias(c) if kinds[c] == "double" else F.col(c) for c in STORED])
    stored.withColumn("split", F.lit(split)).write.mode("overwrite").partitionBy("split", "file").parquet(f"{target}/series")
    config = [(split, mode, profile.gap_slots, profile.label_s, max_missing)]
    spark.createDataFrame(config, "split string, scale string, gap_fill_limit int, label_s int, max_missing double").coalesce(1).write.mode("overwrite").json(f"{target}/preprocess_config.json")


def read_series(spark: SparkSession, source: str) -> DataFrame:
    """The scaled series below ``source``, keyed by file."""
    return spark.read.parquet(f"{source}/series").withColumn("gun", F.col("file")).drop("file", "split")
