"""A fitted detector of the machine's files as a bundle: forest, scaler, thresholds and settings, written and read again."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.config import REAL, TERMINAL_CODES, Profile
from weldsight.operators import alarms, evaluate, models, normalise, summaries
from weldsight.plans import machine
from weldsight.plans.stored import stored
from weldsight.streaming.serving import Card

#: Columns of a score file, in their order.
SCORE_COLUMNS = ("file", "window_start", "score", "alarm", "threshold", "ttf_s", "label", "error_active", "non_welding", "warmup")


@dataclass(frozen=True)
class Bundle:
    """Settings and the results of a fit; nodes is the forest's table, of a size that the settings bound."""

    profile: Profile
    inputs: tuple[str, ...]
    mode: str | None
    scaler: dict[str, tuple[float, float]]
    nodes: pd.DataFrame
    threshold: float
    score_mean: float
    score_std: float
    reference: tuple[float, ...]
    welding: tuple[float, float | None] = (0.0, None)
    scale: str = "global"
    resample: str | None = None

    @property
    def columns(self) -> list[str]:
        return [f"{c}_mean" for c in self.inputs] + [f"{c}_std" for c in self.inputs]

    @property
    def centred(self) -> tuple[str, ...]:
        return tuple(c for c in machine.SCALED_COLUMNS if c in self.inputs) if self.mode else ()

    @property
    def forest(self) -> models.Forest:
        return models.Forest(self.nodes)

    def card(self) -> Card:
        """What online scoring needs."""
        return Card(
            profile=self.profile, inputs=self.inputs, held=machine.CARRIED, counters={"c11": ("welds_delta", "welds_10min"), "c12": ("pos_delta", None)}, duty=("weld_duty_10min", "c2", 0.0),
            share="error_share_10min", welding=("c16", *self.welding), scaler=self.scaler, centred=self.centred, forest=self.forest, threshold=self.threshold, reference=np.array(self.reference),
            score_mean=self.score_mean, score_std=self.score_std, mode=self.mode,
        )


def _windows(rows: DataFrame, profile: Profile, inputs: tuple[str, ...], mode: str | None) -> tuple[DataFrame, DataFrame]:
    """(windows, those of the warm-ups in their machine's own scale) of a scaled series."""
    columns = tuple(c for c in machine.SCALED_COLUMNS if c in inputs)
    stats = stored(normalise.warmup_stats(rows, profile, columns))
    if mode is None:
        stats = stats.withColumn("own", F.lit(False))
    made = [normalise.mark_warmup(machine.model_windows(normalise.recentre(rows, stats, mode or "center", warm, columns), profile, inputs), stats, profile) for warm in (False, True)]
    return stored(made[0]), made[1]


def fit(rows: DataFrame, scaler: dict[str, tuple[float, float]], profile: Profile = REAL, inputs: tuple[str, ...] | None = None, mode: str | None = "center", exclude_non_welding: bool = False, trees: int = models.TREES, welding: tuple[float, float | None] = (0.0, None)) -> Bundle:
    """A bundle from the scaled series (``gun`` is the file) of the training files; ``mode`` None leaves machines alone.

    The forest is grown on normal windows, each drawn by its file, segment and number, so that equal windows are as
    likely as they are many. Threshold, mean, deviation and reference values come from the same windows.
    """
    inputs = inputs or machine.model_features()
    columns = [f"{c}_mean" for c in inputs] + [f"{c}_std" for c in inputs]
    wins, _ = _windows(rows, profile, inputs, mode)
    train = machine.training(wins, exclude_non_welding)
    nodes = models.iforest_fit(train, columns, trees, key=["gun", "segment", "win"]).toPandas()
    scored = stored(models.iforest_score(train, columns, models.Forest(nodes)))
    numbers = scored.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).first()
    medians = evaluate.quantiles(scored, columns, 0.5)
    threshold = evaluate.quantile(scored, "score", profile.quantile)
    return Bundle(profile, tuple(inputs), mode, scaler, nodes, threshold, numbers["mean"], numbers["std"] or 1.0, tuple(medians[c] for c in columns), welding)


def judged(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """Scored windows with threshold, alarm and held: global thresholds in the warm-up, a machine's own one after it."""
    wins, warm = _windows(rows, bundle.profile, bundle.inputs, bundle.mode)
    scored, calibration = (models.iforest_score(w, bundle.columns, bundle.forest) for w in (wins, warm))
    overall = rows.sparkSession.createDataFrame([(bundle.threshold,)], "threshold double")
    scored = stored(scored)
    return alarms.alarms(scored, normalise.gun_threshold(scored, calibration, overall, bundle.profile), bundle.profile)


def score_rows(windows: DataFrame, profile: Profile) -> DataFrame:
    """Judged windows in the columns of a score file."""
    start = F.timestamp_seconds(F.col("win") * profile.window_slots * profile.slot_s).cast("timestamp_ntz")
    return windows.select(F.col("gun").alias("file"), start.alias("window_start"), *SCORE_COLUMNS[2:])


def write_scores(windows: DataFrame, profile: Profile, target: str) -> None:
    """Score files (CSV), one for each machine's file."""
    rows = score_rows(windows, profile)
    rows.repartition("file").sortWithinPartitions("file", "window_start").write.mode("overwrite").partitionBy("file").option("header", True).csv(target)


def metrics(windows: DataFrame, profile: Profile) -> DataFrame:
    """One row of what an evaluation reports: AUROC and AUPRC, pooled and by file, alarm rates, held windows, the rule."""
    windows = windows.withColumn("score", F.round("score", 9))
    fired = alarms.triggers(windows, profile)
    rule = evaluate.rule_metrics(windows, fired, profile)
    parts = [
        evaluate.auroc(windows).select("auroc", "positives", "negatives"),
        evaluate.auprc(windows),
        evaluate.auroc_of_guns(windows).select(F.col("gun_mean").alias("auroc_gun_mean")),
        evaluate.alarm_rates(windows),
        rule.agg(F.sum("triggers").alias("rule_triggers"), F.sum("repeats").alias("rule_repeats"), F.sum("hit").alias("files_hit"), F.percentile(F.col("lead_s") / 60, F.lit(0.5)).alias("rule_lead_min_median"), F.count(F.lit(1)).alias("files")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def write_bundle(spark: SparkSession, bundle: Bundle, target: str, report: DataFrame | None = None, files: DataFrame | None = None) -> None:
    """forest (Parquet), bundle.json and, with a report of ``metrics``, metrics.json below ``target``, with ``files``
    (split, file) also the files that it was fitted and judged on."""
    spark.createDataFrame(bundle.nodes, models.TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{target}/forest")
    settings = dataclasses.asdict(bundle) | {"nodes": None, "codes": list(TERMINAL_CODES)}
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/bundle.json")
    if report is not None:
        report.coalesce(1).write.mode("overwrite").json(f"{target}/metrics.json")
    if files is not None:
        files.coalesce(1).write.mode("overwrite").json(f"{target}/files.json")


def read_bundle(spark: SparkSession, source: str) -> Bundle:
    """A bundle as it was written; settings that an older one lacks get their defaults. One whose data were scaled by file or resampled cannot be served and is refused."""
    settings = {"mode": None, "scale": "global", "resample": None, "welding": (0.0, None), "score_mean": 0.0, "score_std": 1.0} | json.loads(spark.read.text(f"{source}/bundle.json").first()[0])
    if settings["scale"] != "global" or settings["resample"]:
        raise ValueError("a bundle with per-file scale or resampling cannot be served")
    nodes = spark.read.schema(models.TREE_SCHEMA).parquet(f"{source}/forest").toPandas()
    profile = dataclasses.replace(REAL, **settings["profile"])
    scaler = {c: tuple(v) for c, v in settings["scaler"].items()}
    return Bundle(profile, tuple(settings["inputs"]), settings["mode"], scaler, nodes, settings["threshold"], settings["score_mean"], settings["score_std"], tuple(settings["reference"]), tuple(settings["welding"]))


def model_card(spark: SparkSession, source: str) -> DataFrame:
    """part, name, value and text of a bundle that ``train`` wrote: its settings, scaler, inputs with their reference values,
    input columns that were left out, figures of its evaluation and files. A bundle without a report or files has none of
    those rows."""
    made = read_bundle(spark, source)
    rows = [("model", "mode", None, made.mode or "none"), ("model", "trees", float(made.nodes["tree"].nunique()), None)]
    rows += [("model", n, float(getattr(made, n)), None) for n in ("threshold", "score_mean", "score_std")]
    rows += [("preprocess", n, float(getattr(made.profile, n)), None) for n in ("slot_s", "gap_slots", "window_slots", "rolling_slots", "gate", "quantile")]
    rows += [("preprocess", n, v, None) for n, v in zip(("welding_low", "welding_high"), made.welding, strict=True)]
    rows += [("scaler", f"{c}_{n}", float(v), None) for c, pair in made.scaler.items() for n, v in zip(("mu", "sd"), pair, strict=True)]
    rows += [("input", c, float(v), None) for c, v in zip(made.columns, made.reference, strict=True)]
    rows += [("dropped", c, None, None) for c in machine.MODEL_FEATURES if c not in made.inputs]
    out = spark.createDataFrame(rows, "part string, name string, value double, text string")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    there = {f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    if "metrics.json" in there:
        out = out.unionByName(summaries.card({"figure": spark.read.json(f"{source}/metrics.json")}).withColumn("text", F.lit(None).cast("string")))
    if "files.json" in there:
        files = spark.read.schema("split string, file string").json(f"{source}/files.json")
        out = out.unionByName(files.select(F.concat(F.col("split"), F.lit("_file")).alias("part"), F.col("file").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("text")))
    return out


def read_scaler(spark: SparkSession, source: str) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each scaled column that ``machine.preprocess`` wrote below ``source``."""
    row = spark.read.json(f"{source}/scaler.json").first().asDict()
    return {c: (row[f"{c}_mu"], row[f"{c}_sd"]) for c in machine.SCALED_COLUMNS if f"{c}_mu" in row}


def train(spark: SparkSession, source: str, target: str, test: str | None = None, **settings) -> Bundle:
    """Fits on what ``machine.preprocess`` wrote to ``source``, and writes bundle, metrics and score files to ``target``,
    those of the test split where its folder is given."""
    rows = machine.read_series(spark, source)
    made = fit(rows, read_scaler(spark, source), **settings)
    judged_on = machine.read_series(spark, test) if test else rows
    windows = stored(judged(judged_on, made))
    files = [one.select(F.lit(split).alias("split"), F.col("gun").alias("file")).distinct() for split, one in (("train", rows), ("test", judged_on))]
    write_bundle(spark, made, target, metrics(windows, made.profile), files[0].unionByName(files[1]))
    write_scores(windows, made.profile, f"{target}/scores")
    return made
