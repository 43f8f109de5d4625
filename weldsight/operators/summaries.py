"""Summaries of files, classes and folds in full. Keys: gun (a file), slot; ``present`` marks readings of a grid."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weldsight.config import Profile
from weldsight.operators import eda, evaluate
from weldsight.operators.shape import by_gun


@dataclass(frozen=True)
class Spec:
    """What a summary of files looks at: shares by name (SQL conditions on readings), counters by name, columns whose
    distinct values are counted, and the share missing from which a file is discarded."""

    shares: dict[str, str] = field(default_factory=dict)
    counters: dict[str, str] = field(default_factory=dict)
    distinct: tuple[str, ...] = ()
    max_missing: float = 0.4
    long_gap_s: int = 3600


def code_runs(grid: DataFrame, profile: Profile) -> DataFrame:
    """Episodes of error states over the whole grid, with seconds from their end to the file's last slot."""
    return eda.episodes(grid.withColumn("ttf_s", (F.max("slot").over(Window.partitionBy("gun")) - F.col("slot")) * profile.slot_s))


def _increases(rows: DataFrame, counters: dict[str, str]) -> DataFrame:
    """Total increase of each counter over a file's readings; a reset counts as no increase."""
    steps = rows.filter("present = 1").select("gun", *[F.greatest(F.col(c) - F.lag(c).over(by_gun()), F.lit(0)).alias(n) for n, c in counters.items()])
    return steps.groupBy("gun").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_total") for n in counters])


def file_report(grid: DataFrame, raw_rows: DataFrame, profile: Profile, spec: Spec) -> DataFrame:
    """One row for each file. ``grid`` has every slot of a file with codes carried; ``raw_rows`` counts its readings as
    they came (gun, n_raw_rows).

    Shares are over readings, states and codes over the grid. Without an episode the columns of the last one are null and
    ``top_code`` is ''. Of codes that hold as long the later in the order of names is the top one.
    """
    here, slot_s = F.col("present") == 1, profile.slot_s
    ends = Window.partitionBy("gun")
    near = F.when((F.col("_end") - F.col("slot")) * slot_s <= profile.rule_s, F.when(F.col("code") != "0", F.col("code")))
    base = grid.withColumn("_end", F.max("slot").over(ends)).groupBy("gun", "class").agg(
        F.count(F.lit(1)).alias("n_grid"), F.min("slot").alias("start_slot"), F.max("slot").alias("end_slot"), F.sum("present").alias("_here"),
        *[F.avg(F.when(here, F.coalesce(F.expr(c), F.lit(False)).cast("double"))).alias(n) for n, c in spec.shares.items()],
        F.avg((F.col("code") != "0").cast("double")).alias("error_state_share"),
        F.concat_ws(",", F.sort_array(F.collect_set(near))).alias("last_codes"),
    )
    holes = eda.gaps(grid).groupBy("gun").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("gap").alias("longest_gap"), F.sum((F.col("gap") * slot_s > spec.long_gap_s).cast("long")).alias("gaps_over_1h"))
    runs = code_runs(grid, profile)
    by_code = runs.groupBy("gun", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("slots").alias("slots"), F.max(F.struct("last_slot", "code", "end_ttf", "slots")).alias("last"))
    codes = by_code.groupBy("gun").agg(F.sum("n").alias("n_error_episodes"), F.count(F.lit(1)).alias("n_error_codes"), F.max_by("code", F.struct("slots", "code")).alias("top_code"), F.max("last").alias("last"))
    codes = codes.select("gun", "n_error_episodes", "n_error_codes", "top_code", F.col("last.code").alias("last_code"), F.col("last.end_ttf").alias("last_code_end_s"), (F.col("last.slots") * slot_s).alias("last_code_duration_s"))
    parts = [raw_rows, holes, codes]
    if spec.counters:
        parts.append(_increases(grid, spec.counters))
    if spec.distinct:
        parts.append(grid.filter(here).groupBy("gun").agg(*[F.countDistinct(c).alias(f"nunique_{c}") for c in spec.distinct]))
    out = base
    for p in parts:
        out = out.join(p, "gun", "left")
    hours = (F.col("end_slot") - F.col("start_slot")) * slot_s / 3600.0
    out = out.withColumn("span_days", hours / 24).withColumn("missing_rate", 1 - F.col("_here") / F.col("n_grid")).withColumn("discarded", (F.col("missing_rate") > spec.max_missing).cast("int"))
    for n in spec.counters:
        out = out.withColumn(f"{n}_per_hour", F.when(hours > 0, F.col(f"{n}_total") / hours))
    return out.drop("_here").fillna(0, ["n_gaps", "longest_gap", "gaps_over_1h", "n_error_episodes", "n_error_codes"]).fillna("", ["top_code"])


def class_report(files: DataFrame, spec: Spec) -> DataFrame:
    """Files of a class together: means of their rates, sums of what is dropped, first start and last end."""
    means = ["span_days", "missing_rate", *spec.shares, *[f"{n}_per_hour" for n in spec.counters], "n_error_episodes", "error_state_share"]
    return files.groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.max("missing_rate").alias("missing_max"), F.sum("discarded").alias("discarded"), F.min("start_slot").alias("start_min"), F.max("end_slot").alias("end_max"), *[F.avg(c).alias(c) for c in means])


def episode_report(runs: DataFrame, slot_s: int) -> DataFrame:
    """By class and code: files, episodes, hours, durations, and hours from an episode's end to failure."""
    seconds, left = F.col("slots") * slot_s, F.col("end_ttf") / 3600.0
    return runs.groupBy("class", "code").agg(F.countDistinct("gun").alias("files"), F.count(F.lit(1)).alias("episodes"), (F.sum(seconds) / 3600.0).alias("total_hours"), F.percentile(seconds, F.lit(0.5)).alias("median_duration_s"), F.max(seconds).alias("max_duration_s"), F.percentile(left, F.lit(0.5)).alias("median_ttf_end_h"), F.min(left).alias("min_ttf_end_h"))


def last_codes(files: DataFrame, codes: list[str]) -> DataFrame:
    """Class by code: files whose last episode has the code; ``none`` for those without any."""
    of = lambda c: F.sum(F.coalesce(F.col("last_code") == c, F.lit(False)).cast("long")).alias(c)
    return files.groupBy("class").agg(F.sum(F.col("last_code").isNull().cast("long")).alias("none"), *[of(c) for c in codes])


def codes_at_the_end(files: DataFrame, codes: list[str]) -> DataFrame:
    """Class by code: files that show the code in the time the rule looks at."""
    held = F.split("last_codes", ",")
    return files.groupBy("class").agg(*[F.sum(F.array_contains(held, c).cast("long")).alias(c) for c in codes])


def hourly_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """By file and whole hours to failure: readings, share of welding, share of error states, means of columns."""
    hour = F.floor(F.col("ttf_s") / 3600).cast("long").alias("ttf_h")
    return rows.groupBy("gun", hour).agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("nw")).cast("double")).alias("welding_share"), F.avg((F.col("code") != "0").cast("double")).alias("error_share"), *[F.avg(c).alias(f"{c}_mean") for c in columns])


def gap_report(grid: DataFrame) -> DataFrame:
    """Numbers of the gaps of each class, and of all as class ``all``, which has its row even without any gap."""
    found = eda.gaps(grid)
    both = found.select(F.explode(F.array(F.coalesce("class", F.lit("")), F.lit("all"))).alias("class"), "gap")
    every = both.unionByName(grid.sparkSession.range(1).select(F.lit("all").alias("class"), F.lit(None).cast("long").alias("gap")))
    q = lambda p: F.percentile("gap", F.lit(p))
    return every.groupBy("class").agg(F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("std"), F.min("gap").alias("min"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("gap").alias("max"))


# evaluation by folds, bands and classes
FOLD_METRICS = ("auroc", "auroc_gun_mean", "auprc", "recall_pre_failure", "alarm_rate_normal")


def fold_metrics(scored: DataFrame, folds: DataFrame, k: int, profile: Profile) -> DataFrame:
    """A row for each fold and, as folds ``mean`` and ``sd`` (of the population), what they are together.

    A fold's alarms are judged by the quantile of the normal windows of all other folds. Metrics without both sides are
    null and take no part in mean and sd.
    """
    placed = scored.join(folds.select("gun", "fold"), "gun")
    quiet = (F.col("label") == 0) & (F.col("error_active") == 0)
    others = placed.filter(quiet).select(*[F.when(F.col("fold") != i, F.col("score")).alias(f"s{i}") for i in range(k)])
    levels = evaluate.quantiles(others, [f"s{i}" for i in range(k)], profile.quantile)
    level = F.array(*[F.lit(levels[f"s{i}"]).cast("double") for i in range(k)])[F.col("fold")]
    over = ((F.col("score") > level) & ~(F.col("non_welding") > profile.gate)).cast("double")
    rates = placed.groupBy("fold").agg(F.avg(F.when(F.col("label") == 1, over)).alias("recall_pre_failure"), F.avg(F.when(quiet, over)).alias("alarm_rate_normal"))
    pooled = evaluate.auroc(placed, ["fold"]).select("fold", "auroc")
    own = evaluate.auroc(placed, ["fold", "gun"]).groupBy("fold").agg(F.avg("auroc").alias("auroc_gun_mean"))
    each = rates.join(pooled, "fold", "left").join(own, "fold", "left").join(evaluate.auprc(placed, ["fold"]), "fold", "left")
    long = each.select("fold", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in FOLD_METRICS])).alias("m")).select("fold", "m.*")
    together = long.groupBy("metric").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    rows = long.select(F.col("fold").cast("string").alias("fold"), "metric", F.col("x").alias("value"))
    return rows.unionByName(together.select(F.explode(F.create_map(F.lit("mean"), "mean", F.lit("sd"), "sd")).alias("fold", "value"), "metric"))


#: Minutes before failure of the bands; negatives are normal windows over twice the label window away.
BANDS = ((0, 10), (10, 15), (10, 30), (30, 60), (10, 60))


def auroc_bands(scored: DataFrame, profile: Profile, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """AUROC of each band against far normal windows. A band takes ttf over its lower end, from 0 on in the first, up to
    its upper end; minutes stand for sixtieths of the label window."""
    unit = profile.label_s // 60
    far = (F.col("label") == 0) & (F.col("ttf_s") > 2 * profile.label_s)
    at = lambda a, b: (F.col("label") == 1) & (F.col("ttf_s") <= b * unit) & (F.col("ttf_s") > (a * unit if a else -1))
    names = F.filter(F.array(*[F.when(far | at(a, b), F.lit(f"{a}-{b}")) for a, b in bands]), lambda x: x.isNotNull())
    return evaluate.auroc(scored.withColumn("band", F.explode(names)), ["band"])


def only_classes(rows: DataFrame, keep: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the classes to keep (all, if none is named) but for those to drop; rows without a class go if any is kept."""
    if keep:
        rows = rows.filter(F.col("class").isin(*keep))
    return rows.filter(~F.coalesce(F.col("class").isin(*drop), F.lit(False))) if drop else rows


def held_share(windows: DataFrame, gate: float) -> DataFrame:
    """Windows in which alarms are held back (mostly not welding), by file, and their share."""
    out = F.col("non_welding") > gate
    return windows.groupBy("gun").agg(F.count(F.lit(1)).alias("windows"), F.sum(out.cast("long")).alias("held_windows"), F.avg(out.cast("double")).alias("held_share"))


def rule_summary(by_file: DataFrame) -> DataFrame:
    """Files, files hit, triggers, repeats, median minutes of lead among those hit, mean of false triggers a day."""
    return by_file.agg(F.count(F.lit(1)).alias("files"), F.sum("hit").alias("files_hit"), F.sum("triggers").alias("triggers"), F.sum("repeats").alias("repeats"), F.percentile(F.col("lead_s") / 60.0, F.lit(0.5)).alias("lead_min_median"), F.avg("false_per_day").alias("false_per_day"))


def feature_scale(windows: DataFrame, columns: list[str]) -> DataFrame:
    """Median and deviation of each feature over normal windows: what a value is held against, and in which unit."""
    quiet = windows.filter("label = 0 AND error_active = 0")
    long = quiet.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns])).alias("u")).select("u.*")
    return long.groupBy("feature").agg(F.percentile("x", F.lit(0.5)).alias("reference"), F.stddev_samp("x").alias("scale"))


def unscaled(windows: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Sum and mean of each scaled column over a window in the column's own unit, from the window's mean."""
    out = windows.join(F.broadcast(scaler))  # one row
    for c in columns:
        own = F.col(f"{c}_mean") * F.col(f"{c}_sd") + F.col(f"{c}_mu")
        out = out.withColumn(f"{c}_own", own).withColumn(f"{c}_sum", own * F.col("n"))
    return out.drop(*scaler.columns)


# variants
def maintenance_history(rows: DataFrame, slot_s: int, offset: str, welds: str, cap_s: int = 21_600) -> DataFrame:
    """Seven features of the last ``cap_s`` seconds: since a block without welding, count and share of such slots; since a
    change of ``offset``, count of changes, ratio to its mean; welds since the block. Times are capped, as longer ones
    would tell the file's age; before the first block or change they are the cap."""
    past = by_gun().rowsBetween(Window.unboundedPreceding, 0)
    frame = by_gun().rangeBetween(-(cap_s // slot_s) + 1, 0)
    changed = F.coalesce(F.col(offset) != F.lag(offset).over(by_gun()), F.lit(False))
    marked = rows.withColumn("_changed", changed).withColumn("_block", F.sum(F.col("nw").cast("int")).over(past))
    since = lambda c: F.least(F.coalesce((F.col("slot") - F.max(F.when(c, F.col("slot"))).over(past)) * slot_s, F.lit(cap_s)), F.lit(cap_s))
    mean = F.avg(offset).over(frame)
    return marked.select(
        "gun", "slot", since(F.col("nw")).alias("since_block_s"), F.sum(F.col("nw").cast("int")).over(frame).alias("block_count"), F.avg(F.col("nw").cast("double")).over(frame).alias("block_share"),
        since(F.col("_changed")).alias("since_change_s"), F.sum(F.col("_changed").cast("int")).over(frame).alias("changes"), F.when(mean != 0, F.col(offset) / mean).alias("offset_ratio"),
        F.sum(welds).over(Window.partitionBy("gun", "_block").orderBy("slot").rangeBetween(-(cap_s // slot_s) + 1, 0)).alias("welds_since_block"),
    )


def history_features(windows: DataFrame, columns: list[str], lengths: tuple[int, ...] = (5, 30, 60, 1440)) -> DataFrame:
    """Mean and deviation (0 for one) of every column over the last windows of a file, for each length."""
    out = []
    for n in lengths:
        frame = by_gun("win").rowsBetween(-(n - 1), 0)
        out += [f(c).alias(f"{c}_{s}{n}") for c in columns for s, f in (("mean", lambda x: F.avg(x).over(frame)), ("std", lambda x: F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0))))]
    return windows.select("gun", "win", *out)


def pivoted(long: DataFrame, run: str, method: str, value: Column, methods: list[str]) -> DataFrame:
    """Runs by methods: one row for a run, a column for each method named (null where a run lacks it)."""
    return long.groupBy(run).agg(*[F.percentile(F.when(F.col(method) == m, value), F.lit(0.5)).alias(m) for m in methods])


def transposed(wide: DataFrame, run: str, methods: list[str], runs: list) -> DataFrame:
    """Methods by runs: one row for a method, a column ``run_<name>`` for each run named."""
    long = wide.unpivot([run], methods, "method", "_x")
    return long.groupBy("method").agg(*[F.max(F.when(F.col(run) == r, F.col("_x"))).alias(f"run_{r}") for r in runs])


def list_add(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Lists of a key added element by element: (key, position, total, n); shorter lists end early."""
    each = rows.select(by, F.posexplode(column).alias("position", "x"))
    return each.groupBy(by, "position").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("x").alias("n"))


def card(parts: dict[str, DataFrame]) -> DataFrame:
    """part, name, value: the numbers of one-row frames, a row for each."""
    rows = [one.select([F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "name", "value").select(F.lit(part).alias("part"), "name", "value") for part, one in parts.items()]
    return reduce(DataFrame.unionByName, rows)
