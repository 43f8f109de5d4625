"""Registered queries: what each returns, and the last step of its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.config import SCALED as P
from weldsight.config import TERMINAL_CODES
from weldsight.operators import alarms, documents, eda, evaluate, experiments, features, handoff, models, normalise, shape, windows
from weldsight.plans import oracles
from weldsight.plans.chain import ATTRIBUTED, Chain
from weldsight.plans.stored import shared_folder
from weldsight.streaming import alarms as streaming
from weldsight.streaming import replay, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, exact: str, rounded: str, build: Callable[[Chain], DataFrame], last: str) -> None:
    """Registers a query over the chain: its exact columns, those rounded to six places, and its SQL's last step."""
    keys, values = exact.split(), rounded.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Chain(spark, sf_dir)).select(*keys, *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in values])

    QUERIES[name] = query
    columns = [*keys, *[f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}" for c in values]]
    ORACLES[name] = oracles.sql(f"SELECT {', '.join(columns)} FROM ({last})")


def add_table(name: str, table: str, exact: str, rounded: str, build: Callable[[DataFrame], DataFrame], last: str) -> None:
    """The same for a query over one table of its own."""
    keys, values = exact.split(), rounded.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark.read.parquet(f"{sf_dir}/{table}.parquet")).select(*keys, *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in values])

    QUERIES[name] = query
    ORACLES[name] = f"SELECT {', '.join([*keys, *[f'round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}' for c in values]])} FROM ({last})"


# shaping and features
add("dedup_last", "gun slot event_id us k code nw buys", "value", lambda c: shape.dedup_last(c.sensor), "SELECT * FROM dedup")
add("grid_align", "gun class slot present event_id k", "value", lambda c: shape.grid_align(shape.dedup_last(c.sensor)).fillna(-1, ["event_id", "k"]), "SELECT * REPLACE (coalesce(event_id, -1) AS event_id, coalesce(k, -1) AS k) FROM grid0")
add("code_carry", "gun slot code present", "", lambda c: c.grid(), "SELECT * FROM grid")
add("bounded_fill", "gun slot k code nw buys present", "value", lambda c: shape.bounded_fill(c.grid(), P.gap_slots), "SELECT * FROM filled")
add("segments", "gun slot segment", "", lambda c: shape.segments(shape.bounded_fill(c.grid(), P.gap_slots)), "SELECT * FROM segmented")
add("last_segment", "gun slot", "", lambda c: shape.last_segment(shape.segments(shape.bounded_fill(c.grid(), P.gap_slots))), "SELECT * FROM segmented QUALIFY segment = max(segment) OVER (PARTITION BY gun)")
add("non_welding_carry", "gun slot k nw", "value", lambda c: shape.carry_non_welding(shape.segments(shape.bounded_fill(c.grid(), P.gap_slots))), "SELECT * FROM carried")
add("ttf_label", "gun slot ttf_s label", "", lambda c: shape.shaped(c.sensor, P), "SELECT * FROM shaped")
add("counter_delta", "gun slot buys_delta", "", lambda c: features.counter_delta(shape.shaped(c.sensor, P)), "SELECT * FROM deltas")
add("rolling_sum", "gun slot buys_roll", "", lambda c: c.rows(), "SELECT * FROM rolled")
add("rolling_share", "gun slot", "duty_roll error_share", lambda c: c.rows(), "SELECT * FROM rolled")
add("state_flags", "gun slot error_active terminal_code terminal_any terminal_idx", "", lambda c: c.rows(), "SELECT * FROM stated")
add("time_sincos", "gun slot dow", "hour_sin hour_cos", lambda c: c.rows(), "SELECT * FROM feats")
add("resample_1h", "gun hour n", "value_mean", lambda c: c.rows().groupBy("gun", F.floor(F.col("slot") / 6).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value_mean")), "SELECT gun, slot // 6 AS hour, count(*) AS n, avg(value) AS value_mean FROM feats GROUP BY ALL")

# windows, normalisation, thresholds
_W = "gun class segment win"
add("scaler_fit", "", "value_mu value_sd k_mu k_sd", lambda c: normalise.scaler_fit(c.rows()), "SELECT * FROM scaler")
add("zscore", "gun slot", "value k", lambda c: normalise.zscore(c.rows(), normalise.scaler_fit(c.rows())), "SELECT * FROM scaled")
add("window_stats", _W, "value_mean k_mean error_share_mean value_std k_std error_share_std", lambda c: c.windows(), "SELECT * FROM wins")
add("window_flags", f"{_W} error_active terminal_code terminal_any terminal_idx label ttf_s n", "non_welding", lambda c: c.windows(), "SELECT * FROM wins")
add("underfilled_filter", "kept dropped", "", lambda c: windows.window_stats(c.rows(), P).agg(F.sum((F.col("n") >= P.min_samples).cast("int")).alias("kept"), F.sum((F.col("n") < P.min_samples).cast("int")).alias("dropped")), "SELECT CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN n < 3 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM win_all")
add("gun_warmup_stats", "gun warm_n", "value_gm value_gs k_gm k_gs", lambda c: c.gun_stats(), "SELECT * FROM warm")
add("gun_center", "gun win warmup", "value_mean k_mean score", lambda c: c.scored(), "SELECT * FROM scored")
add("gun_scale", "gun win", "value_mean value_std", lambda c: c.recentred("scale"), "SELECT gun, win, value_mean, value_std FROM rescaled")
add("global_threshold", "", "threshold", lambda c: normalise.global_threshold(c.scored(), P.quantile), "SELECT * FROM thr")
add("gun_threshold", "gun windows", "threshold overall", lambda c: c.thresholds(c.scored()), "SELECT * FROM gun_thr")
add("feature_reference", "", " ".join(ATTRIBUTED), lambda c: normalise.feature_reference(c.scored(), ATTRIBUTED), "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in ATTRIBUTED) + " FROM scored WHERE label = 0 AND error_active = 0")
def _standardised(c: Chain) -> DataFrame:
    s = c.scored()
    return s.join(F.broadcast(normalise.normal(s).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")))).withColumn("score_z", (F.col("score") - F.col("m")) / F.col("s"))  # one row


add("score_z", "gun win", "score_z", _standardised, "SELECT gun, win, (score - m) / s AS score_z FROM scored, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scored WHERE label = 0 AND error_active = 0)")

# alarms and rules
_RUN = "gun first_win last_win windows start_ttf end_ttf"
add("alarm_gate", "gun win alarm held", "threshold", lambda c: c.alarmed(), "SELECT * FROM alarmed")
add("alarm_runs", _RUN, "top_score", lambda c: alarms.alarm_runs(c.alarmed(), P), "SELECT * FROM runs")
add("final_run", "gun", "final_run_h", lambda c: alarms.final_run(c.alarmed(), alarms.alarm_runs(c.alarmed(), P)), "SELECT gun, start_ttf / 3600 AS final_run_h FROM (SELECT gun, max(win) AS last_win FROM alarmed GROUP BY gun) LEFT JOIN runs USING (gun, last_win)")
_FALSE = "SELECT gun, coalesce(c, 0) AS false_runs, coalesce(c, 0) / ((span - 259200) / 86400.0::DOUBLE) AS false_runs_per_day FROM (SELECT gun, max(ttf_s) AS span FROM alarmed GROUP BY gun) LEFT JOIN (SELECT gun, count(*) AS c FROM runs WHERE end_ttf > 259200 GROUP BY gun) USING (gun)"
add("false_runs_per_day", "gun false_runs", "false_runs_per_day", lambda c: alarms.false_runs(c.alarmed(), alarms.alarm_runs(c.alarmed(), P), P), _FALSE)
add("sustained_alarm", "gun win alarm_windows sustained", "", lambda c: alarms.sustained(c.alarmed(), P), "SELECT gun, win, alarm_windows, CASE WHEN alarm_windows >= 2 THEN 1 ELSE 0 END AS sustained FROM lasting")
add("rule_triggers", "gun win terminal_idx ttf_s", "", lambda c: alarms.triggers(c.windows(), P), "SELECT * FROM fired")
add("rule_repeats", "gun win repeat", "", lambda c: alarms.triggers(c.windows(), P), "SELECT * FROM fired")
_RULES = """SELECT gun, coalesce(triggers, 0) AS triggers, coalesce(repeats, 0) AS repeats, CASE WHEN lead_s IS NULL THEN 0 ELSE 1 END AS hit, lead_s, coalesce(false_n, 0) / ((span - 86400) / 86400.0::DOUBLE) AS false_per_day
  FROM (SELECT gun, max(ttf_s) AS span FROM wins GROUP BY gun) LEFT JOIN (SELECT gun, count(*) AS triggers, CAST(sum(repeat) AS BIGINT) AS repeats, max(CASE WHEN ttf_s <= 86400 THEN ttf_s END) AS lead_s, sum(CASE WHEN ttf_s > 86400 AND repeat = 0 THEN 1 ELSE 0 END) AS false_n FROM fired GROUP BY gun) USING (gun)"""
add("rule_metrics", "gun triggers repeats hit lead_s", "false_per_day", lambda c: evaluate.rule_metrics(c.windows(), alarms.triggers(c.windows(), P), P), _RULES)
add("severity", "gun win severity sustained fired repeat", "", lambda c: c.severities(), "SELECT * FROM severe")
add("severity_rollup", "gun day severity n", "", lambda c: c.severities().groupBy("gun", F.floor(F.col("win") / 24).alias("day"), "severity").agg(F.count(F.lit(1)).alias("n")), "SELECT gun, win // 24 AS day, severity, count(*) AS n FROM severe GROUP BY ALL")
add("gun_report", "gun windows alarms held triggers critical last_severity", "top_score", lambda c: c.severities().groupBy("gun").agg(F.count(F.lit(1)).alias("windows"), F.sum("alarm").alias("alarms"), F.sum("held").alias("held"), F.sum("fired").alias("triggers"), F.sum((F.col("severity") == "critical").cast("int")).alias("critical"), F.max("score").alias("top_score"), F.max_by("severity", "win").alias("last_severity")), "SELECT gun, count(*) AS windows, CAST(sum(alarm) AS BIGINT) AS alarms, CAST(sum(held) AS BIGINT) AS held, CAST(sum(fired) AS BIGINT) AS triggers, CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical, arg_max(severity, win) AS last_severity, max(score) AS top_score FROM severe GROUP BY gun")

# evaluation
add("auroc", "positives negatives", "auroc", lambda c: evaluate.auroc(c.scored()), oracles.auroc("sides"))
add("auroc_by_class", "class positives negatives", "auroc", lambda c: evaluate.auroc(c.scored(), ["class"]), oracles.auroc("sides", "class"))
add("auroc_gun_mean", "", "gun_mean gun_min gun_max", lambda c: evaluate.auroc_of_guns(c.scored()), f"SELECT avg(auroc) AS gun_mean, min(auroc) AS gun_min, max(auroc) AS gun_max FROM ({oracles.auroc('sides', 'gun')})")
add("auroc_pre_rule", "positives negatives", "auroc", lambda c: evaluate.auroc(c.scored().filter(f"label = 0 OR ttf_s > {P.rule_s}")), oracles.auroc("(SELECT * FROM sides WHERE label = 0 OR ttf_s > 21600)"))
add("auroc_welding", "positives negatives", "auroc", lambda c: evaluate.auroc(c.scored().filter(f"non_welding <= {P.gate}")), oracles.auroc("(SELECT * FROM sides WHERE non_welding <= 0.5)"))
add("auroc_band", "positives negatives", "auroc", lambda c: evaluate.auroc(c.scored().filter("(label = 1 AND ttf_s BETWEEN 21600 AND 64800) OR (label = 0 AND ttf_s > 172800)")), oracles.auroc("(SELECT * FROM sides WHERE (label = 1 AND ttf_s BETWEEN 21600 AND 64800) OR (label = 0 AND ttf_s > 172800))"))
add("auprc", "", "auprc", lambda c: evaluate.auprc(c.scored()), "SELECT sum(CASE WHEN pos = 1 THEN tp / seen END) / sum(pos) AS auprc FROM (SELECT pos, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp, count(*) OVER (ORDER BY score DESC) AS seen FROM sides)")
add("alarm_rates", "held", "normal_rate after_warmup_rate error_rate recall gun_min gun_max gun_sd", lambda c: evaluate.alarm_rates(c.alarmed()), """SELECT * FROM (SELECT CAST(sum(held) AS BIGINT) AS held, avg(alarm) FILTER (label = 0 AND error_active = 0) AS normal_rate, avg(alarm) FILTER (label = 0 AND error_active = 0 AND warmup = 0) AS after_warmup_rate,
  avg(alarm) FILTER (error_active = 1) AS error_rate, avg(alarm) FILTER (label = 1) AS recall FROM alarmed), (SELECT min(r) AS gun_min, max(r) AS gun_max, stddev_pop(r) AS gun_sd FROM (SELECT avg(alarm) AS r FROM alarmed WHERE label = 0 AND error_active = 0 GROUP BY gun))""")
add("operating_point", "guns lead_met quiet_met both_met", "", lambda c: evaluate.operating_point(alarms.final_run(c.alarmed(), alarms.alarm_runs(c.alarmed(), P)), alarms.false_runs(c.alarmed(), alarms.alarm_runs(c.alarmed(), P), P), P), f"""SELECT count(*) AS guns, CAST(sum(l) AS BIGINT) AS lead_met, CAST(sum(q) AS BIGINT) AS quiet_met, CAST(sum(l * q) AS BIGINT) AS both_met FROM (SELECT CASE WHEN start_ttf >= 21600 THEN 1 ELSE 0 END AS l, CASE WHEN coalesce(false_runs_per_day <= 1, TRUE) THEN 1 ELSE 0 END AS q
  FROM (SELECT gun, max(win) AS last_win FROM alarmed GROUP BY gun) LEFT JOIN runs USING (gun, last_win) JOIN ({_FALSE}) USING (gun))""")
_FOLD = "(row_number() OVER (PARTITION BY class ORDER BY md5(CAST(gun AS VARCHAR)), gun) - 1) % 4"
add("kfold_summary", "fold windows", "alarm_rate", lambda c: c.alarmed().join(F.broadcast(evaluate.folds(c.sensor.select("gun", "class").distinct(), 4).drop("class")), "gun").groupBy("fold").agg(F.count(F.lit(1)).alias("windows"), F.avg(F.col("alarm").cast("double")).alias("alarm_rate")), f"SELECT CAST(fold AS INT) AS fold, count(*) AS windows, avg(alarm) AS alarm_rate FROM alarmed JOIN (SELECT gun, {_FOLD} AS fold FROM spans) USING (gun) GROUP BY fold")
add("holdout_split", "gun class validation", "", lambda c: evaluate.holdout(c.sensor.select("gun", "class").distinct(), 0.5), "SELECT gun, class, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5(CAST(gun AS VARCHAR)), gun) <= round(count(*) OVER (PARTITION BY class) * 0.5) THEN 1 ELSE 0 END AS validation FROM spans")
add("label_window_override", "gun positives", "", lambda c: evaluate.relabel(c.windows(), 172_800).groupBy("gun").agg(F.sum("label").alias("positives")), "SELECT gun, CAST(sum(CASE WHEN ttf_s <= 172800 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM wins GROUP BY gun")
_CODES = "CASE code WHEN 'E012' THEN 'E01' WHEN 'E016' THEN 'E02' WHEN 'E028' THEN 'E03' WHEN 'E029' THEN 'E04' END"
add("class_inference", "gun inferred class_source", "", lambda c: evaluate.infer_class(c.rows(), F.create_map(*[F.lit(x) for kv in TERMINAL_CODES.items() for x in kv]), P.rule_s), f"SELECT gun, {_CODES} AS inferred, CASE WHEN code IS NULL THEN 'none' ELSE 'terminal_code' END AS class_source FROM (SELECT DISTINCT gun FROM feats) LEFT JOIN (SELECT gun, arg_max(code, slot) AS code FROM stated WHERE ttf_s <= 21600 AND terminal_any = 1 GROUP BY gun) USING (gun)")
_BUCKET = "CASE WHEN ttf_s <= 3600 THEN '0-1h' WHEN ttf_s <= 21600 THEN '1-6h' WHEN ttf_s <= 86400 THEN '6-24h' WHEN ttf_s <= 604800 THEN '1-7d' ELSE '>7d' END"
add("score_by_ttf", "class bucket n", "median_score alarm_rate", lambda c: c.alarmed().withColumn("bucket", evaluate.ttf_bucket(F.col("ttf_s"))).groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.percentile("score", F.lit(0.5)).alias("median_score"), F.avg(F.col("alarm").cast("double")).alias("alarm_rate")), f"SELECT class, {_BUCKET} AS bucket, count(*) AS n, quantile_cont(score, 0.5) AS median_score, avg(alarm) AS alarm_rate FROM alarmed GROUP BY ALL")
add("cohens_d", "", "cohens_d", lambda c: evaluate.cohens_d(c.scored(), "score"), "SELECT (avg(score) FILTER (pos = 1) - avg(score) FILTER (pos = 0)) / sqrt(((count(*) FILTER (pos = 1) - 1) * var_samp(score) FILTER (pos = 1) + (count(*) FILTER (pos = 0) - 1) * var_samp(score) FILTER (pos = 0)) / (count(*) - 2)) AS cohens_d FROM sides")
_RANK = "rank() OVER (PARTITION BY gun ORDER BY {0}) + (count(*) OVER (PARTITION BY gun, {0}) - 1) / 2.0::DOUBLE"
add("spearman_leak", "gun", "spearman", lambda c: evaluate.spearman(c.rows(), "buys", "slot"), f"SELECT gun, corr(a, b) AS spearman FROM (SELECT gun, {_RANK.format('buys')} AS a, {_RANK.format('slot')} AS b FROM feats) GROUP BY gun")
add("disjoint_splits", "shared", "", lambda c: evaluate.holdout(c.sensor.select("gun", "class").distinct(), 0.5).groupBy("gun").agg(F.countDistinct("validation").alias("n")).agg(F.sum((F.col("n") > 1).cast("int")).alias("shared")), "SELECT CAST(0 AS BIGINT) AS shared")

# exploration
add("episodes", "gun class code first_slot last_slot slots end_ttf", "", lambda c: eda.episodes(shape.shaped(c.sensor, P)), "SELECT * FROM epis")
add("episode_stats", "class code guns episodes min_end_ttf", "hours median_h max_h", lambda c: eda.episode_stats(eda.episodes(shape.shaped(c.sensor, P)), P.slot_s), "SELECT class, code, count(DISTINCT gun) AS guns, count(*) AS episodes, min(end_ttf) AS min_end_ttf, sum(slots * 600 / 3600.0::DOUBLE) AS hours, quantile_cont(slots * 600 / 3600.0::DOUBLE, 0.5) AS median_h, max(slots * 600 / 3600.0::DOUBLE) AS max_h FROM epis GROUP BY ALL")
add("code_share_by_ttf", "class bucket code slots", "share", lambda c: eda.code_share_by_ttf(shape.shaped(c.sensor, P), evaluate.ttf_bucket(F.col("ttf_s"))), f"SELECT *, slots / sum(slots) OVER (PARTITION BY class, bucket) AS share FROM (SELECT class, {_BUCKET} AS bucket, code, count(*) AS slots FROM shaped GROUP BY ALL)")
add("code_rate_by_ttf", "class bucket episodes", "per_hour", lambda c: eda.code_rate_by_ttf(shape.shaped(c.sensor, P), eda.episodes(shape.shaped(c.sensor, P)), evaluate.ttf_bucket(F.col("ttf_s")), evaluate.ttf_bucket(F.col("end_ttf")), P.slot_s), f"SELECT class, bucket, coalesce(e, 0) AS episodes, CASE WHEN hours > 0 THEN coalesce(e, 0) / hours END AS per_hour FROM (SELECT class, {_BUCKET} AS bucket, sum(present) * 600 / 3600.0::DOUBLE AS hours FROM shaped GROUP BY ALL) LEFT JOIN (SELECT class, {_BUCKET.replace('ttf_s', 'end_ttf')} AS bucket, count(*) AS e FROM epis GROUP BY ALL) USING (class, bucket)")
_NEAR = ["E003", *TERMINAL_CODES]
add("codes_near_failure", "class " + " ".join(_NEAR), "", lambda c: eda.codes_near_failure(shape.shaped(c.sensor, P), 86_400, _NEAR), "SELECT class, " + ", ".join(f"count(DISTINCT CASE WHEN code = '{x}' THEN gun END) AS {x}" for x in _NEAR) + " FROM shaped WHERE ttf_s <= 86400 GROUP BY class")
add("last_code", "gun last_code", "", lambda c: eda.episodes(shape.shaped(c.sensor, P)).groupBy("gun").agg(F.max_by("code", "last_slot").alias("last_code")), "SELECT gun, arg_max(code, last_slot) AS last_code FROM epis GROUP BY gun")
add("file_summary", "gun class rows grid_rows codes last_code buys k_nunique gaps longest_gap dropped", "nw_share missing hours", lambda c: eda.file_summary(c.grid(), 0.75, P.slot_s), "SELECT * FROM files")
add("class_summary", "class files rows longest_gap", "missing hours", lambda c: eda.class_summary(eda.file_summary(c.grid(), 0.75, P.slot_s)), "SELECT class, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, max(longest_gap) AS longest_gap, avg(missing) AS missing, sum(hours) AS hours FROM files GROUP BY class")
add("missing_rate_filter", "gun rows", "", lambda c: eda.kept_files(c.sensor, eda.file_summary(c.grid(), 0.75, P.slot_s)).groupBy("gun").agg(F.count(F.lit(1)).alias("rows")), "SELECT gun, count(*) AS rows FROM sensor ANTI JOIN (SELECT gun FROM files WHERE dropped = 1) USING (gun) GROUP BY gun")
add("gap_stats", "n min max", "mean std p50 p90 p99", lambda c: eda.gap_stats(eda.gaps(c.grid())), "SELECT count(*) AS n, min(gap) AS min, max(gap) AS max, avg(gap) AS mean, stddev_samp(gap) AS std, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.9) AS p90, quantile_cont(gap, 0.99) AS p99 FROM holes")
_LONG = "SELECT class, gun, 'value' AS name, CAST(value AS DOUBLE) AS x FROM sensor UNION ALL SELECT class, gun, 'k', CAST(k AS DOUBLE) FROM sensor UNION ALL SELECT class, gun, 'buys', CAST(buys AS DOUBLE) FROM sensor"
add("column_stats", "class name n nunique", "zero_share mean std min p01 p50 p99 max", lambda c: eda.column_stats(c.sensor, ["value", "k", "buys"]), f'SELECT class, name, count(x) AS n, count(DISTINCT x) AS nunique, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END) AS zero_share, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99, max(x) AS max FROM ({_LONG}) GROUP BY ALL')
add("column_constancy", "name constant_files", "median_nunique", lambda c: eda.column_constancy(c.sensor, ["value", "k", "buys"]), f'SELECT name, CAST(sum(CASE WHEN u = 1 THEN 1 ELSE 0 END) AS BIGINT) AS constant_files, quantile_cont(u, 0.5) AS median_nunique FROM (SELECT gun, name, count(DISTINCT x) AS u FROM ({_LONG}) GROUP BY ALL) GROUP BY ALL')
_PAIRS = [("value", "value"), ("value", "k"), ("value", "buys_roll"), ("k", "k"), ("k", "buys_roll"), ("buys_roll", "buys_roll")]
add("corr_matrix", "a b", "corr", lambda c: eda.correlations(c.rows(), ["value", "k", "buys_roll"]), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM feats" for a, b in _PAIRS))
add("corr_by_class", "class a b", "corr", lambda c: eda.correlations(c.rows(), ["value", "k", "buys_roll"], ["class"]), " UNION ALL ".join(f"SELECT class, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM feats GROUP BY class" for a, b in _PAIRS))
add("target_corr", "a b", "corr", lambda c: eda.correlations(c.rows(), ["value", "k", "label"]).filter("b = 'label' AND a <> 'label'"), "SELECT 'value' AS a, 'label' AS b, corr(value, label) AS corr FROM feats UNION ALL SELECT 'k', 'label', corr(k, label) FROM feats")
add("hour_profile", "hour n", "welding_share value_mean", lambda c: eda.hour_profile(c.rows(), P.slot_s), "SELECT CAST(slot * 600 // 3600 % 24 AS INT) AS hour, count(*) AS n, avg(CASE WHEN nw THEN 0.0 ELSE 1 END) AS welding_share, avg(value) AS value_mean FROM feats GROUP BY 1")

# attribution and hand-off
_SENSORS = {"value": "c6", "k": "c2"}


def _gain(columns: dict) -> object:
    far = models.sum_of([F.abs(columns[c]) for c in ATTRIBUTED]) / len(ATTRIBUTED)
    return 1 - F.exp(-far)


def _top(c: Chain) -> DataFrame:
    s = c.scored()
    return models.attribution(s, ATTRIBUTED, normalise.feature_reference(s, ATTRIBUTED), _gain, ["gun", "win"])


_FAR = "1 - exp(-({}) / 4)"


def _score_sql(changed: str | None) -> str:
    return _FAR.format(" + ".join(f"abs({'r_' + c if c == changed else c})" for c in ATTRIBUTED))


_REF = "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS r_{c}" for c in ATTRIBUTED) + " FROM scored WHERE label = 0 AND error_active = 0"
_PARTS = " UNION ALL ".join(f"SELECT gun, win, '{c}' AS feature, {c} AS value, r_{c} AS reference, {_score_sql(None)} - ({_score_sql(c)}) AS contribution FROM scored, ({_REF})" for c in ATTRIBUTED)
_TOP = f"SELECT *, greatest(contribution, 0) / CASE WHEN total > 0 THEN total ELSE 1 END AS share FROM (SELECT *, row_number() OVER (PARTITION BY gun, win ORDER BY round(contribution, 12) DESC, feature) AS rank, sum(greatest(contribution, 0)) OVER (PARTITION BY gun, win) AS total FROM ({_PARTS})) WHERE rank <= 8"
add("topk_contrib", "gun win feature", "value reference contribution share", _top, _TOP)
_FOUND = f"SELECT gun, win, rank, CASE WHEN feature LIKE 'value%' THEN 'c6' ELSE 'c2' END AS sensor, CASE WHEN feature LIKE '%std' THEN CASE WHEN value > reference THEN 'unstable' END WHEN value > reference THEN 'high' ELSE 'low' END AS direction, round(value - reference, 2) AS deviation, round(share, 3) AS share, contribution, value, reference FROM ({_TOP})"
_FOUND = f"SELECT * FROM ({_FOUND}) WHERE contribution > 0 AND share >= 0.05 AND abs(value - reference) >= 1 AND direction IS NOT NULL AND rank <= 6"
add("findings", "gun win sensor direction", "", lambda c: handoff.sensor_findings(_top(c), _SENSORS, ["gun", "win"]), _FOUND)
_MATCH = f"""SELECT gun, win, symptom, CASE WHEN aux = 1 THEN 'full' ELSE 'partial' END AS match FROM (SELECT gun, win, symptom, max(CASE WHEN part = 'core' THEN 1 ELSE 0 END) AS core, max(CASE WHEN part = 'aux' THEN 1 ELSE 0 END) AS aux
  FROM ({_FOUND}) f JOIN (VALUES ('P2', 'core', 'c2', 'low'), ('P3', 'core', 'c6', 'high'), ('P3', 'aux', 'c2', 'low'), ('P6', 'aux', 'c6', 'high')) r(symptom, part, sensor, direction) USING (sensor, direction) GROUP BY ALL) WHERE core = 1"""
add("symptom_match", "gun win symptom match", "", lambda c: handoff.symptom_match(handoff.sensor_findings(_top(c), _SENSORS, ["gun", "win"]), ["gun", "win"]), _MATCH)


def _events(c: Chain) -> DataFrame:
    s = alarms.rising(c.severities())
    codes = F.array(*[F.lit(x) for x in TERMINAL_CODES])
    latest = F.when(F.col("terminal_idx") > 0, F.element_at(codes, F.greatest(F.col("terminal_idx"), F.lit(1))))
    return s.select("gun", "win", "fired", "repeat", F.when(F.col("fired") == 1, latest).alias("rule_code"), latest.alias("latest_code"))


def _documents(c: Chain) -> DataFrame:
    found = handoff.sensor_findings(_top(c), _SENSORS, ["gun", "win"])
    return handoff.documents(_events(c), found, handoff.symptom_match(found, ["gun", "win"]))


_EVENTS = "SELECT gun, win, fired, repeat, CASE terminal_idx WHEN 1 THEN 'E01' WHEN 2 THEN 'E02' WHEN 3 THEN 'E03' WHEN 4 THEN 'E04' END AS cls FROM handed"
_DOCS = f"""SELECT gun, win, md5(gun || '|' || win || '|' || CASE WHEN fired = 1 THEN 'rule' ELSE 'model' END) AS event_id, cls AS fault,
  CASE WHEN fired = 1 AND repeat = 0 AND cls IS NOT NULL THEN 'rule_trigger' WHEN cls IS NOT NULL THEN 'latest_error_code' END AS basis,
  coalesce(ids, CASE WHEN fired = 1 THEN 'P9' ELSE '' END) AS symptoms,
  concat_ws(',', CASE cls WHEN 'E01' THEN 'S01' WHEN 'E02' THEN 'S02' WHEN 'E03' THEN 'S03' WHEN 'E04' THEN 'S04' END, CASE WHEN ids IS NULL AND fired = 1 AND cls IS NULL THEN 'S09' ELSE places END) AS situations,
  CASE WHEN fired = 1 AND repeat = 0 AND cls IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
  FROM ({_EVENTS}) e LEFT JOIN (SELECT gun, win, string_agg(symptom, ',' ORDER BY o, p, symptom) AS ids, string_agg(place, ',' ORDER BY o, p, symptom) AS places
    FROM (SELECT m.*, CASE symptom WHEN 'P2' THEN 'S05' ELSE 'S06' END AS place, CASE WHEN cls = CASE symptom WHEN 'P2' THEN 'E01' ELSE 'E03' END THEN 0 ELSE 1 END AS o, CASE match WHEN 'full' THEN 0 ELSE 1 END AS p FROM ({_MATCH}) m JOIN ({_EVENTS}) USING (gun, win)) GROUP BY gun, win) USING (gun, win)"""
add("handoff_doc", "gun win event_id fault basis symptoms situations confidence", "", _documents, _DOCS)
add("outbox_latest", "gun win event_id fault", "", lambda c: handoff.outbox(_documents(c), 20), f"SELECT * FROM ({_DOCS}) ORDER BY win DESC, gun LIMIT 20")

#: One machine's documents among the newest hundred.
add("outbox_of_gun", "gun win event_id fault", "", lambda c: handoff.outbox(_documents(c), 20, gun=3, capacity=100), f"SELECT * FROM (SELECT * FROM ({_DOCS}) ORDER BY win DESC, gun LIMIT 100) WHERE gun = 3 ORDER BY win DESC LIMIT 20")

# experiments
_SERIES = "SELECT *, (score - m) / s AS z, row_number() OVER (PARTITION BY gun ORDER BY win) AS i FROM scored, (SELECT avg(score) AS m, stddev_pop(score) AS s FROM scored WHERE label = 0 AND error_active = 0)"


def _fold_sql(first: str, step: str, name: str) -> str:
    return oracles.sql(f"SELECT gun, win, round(v, 6) AS {name} FROM fold").replace("\nSELECT gun, win, round", f",\nseries AS ({_SERIES}),\nfold AS (SELECT gun, win, i, {first} AS v FROM series WHERE i = 1 UNION ALL SELECT s.gun, s.win, s.i, {step} FROM fold f JOIN series s ON s.gun = f.gun AND s.i = f.i + 1)\nSELECT gun, win, round")


_A = 1 - 0.5 ** (1 / 5)
for _name, _build, _first, _step in (
    ("ewma", lambda c: experiments.ewma(c.scored(), "gun", "win", "score", 5), "CAST(score AS DOUBLE)", f"f.v * {1 - _A!r} + s.score * {_A!r}"),
    ("cusum", lambda c: experiments.cusum(_standardised(c), "gun", "win", "score_z"), "greatest(0.0::DOUBLE, z - 0.5::DOUBLE)", "greatest(0.0::DOUBLE, f.v + s.z - 0.5::DOUBLE)"),
):
    add(_name, "gun win", _name, _build, "SELECT 1")
    ORACLES[_name] = _fold_sql(_first, _step, _name)
add("exp_smooth", "gun win", "smooth debiased", lambda c: experiments.exp_smooth(c.scored(), "gun", "win", "score"), "SELECT 1")
ORACLES["exp_smooth"] = _fold_sql("CAST(score AS DOUBLE)", "f.v * 0.8::DOUBLE + s.score * (1 - 0.8::DOUBLE)", "smooth").replace("round(v, 6) AS smooth", "round(v, 6) AS smooth, round(v / 0.8::DOUBLE, 6) AS debiased")
add("history_features", "gun win", "score_mean5 score_std5 score_mean30 score_std30", lambda c: experiments.history(c.scored(), "gun", "win", "score"), "SELECT gun, win, " + ", ".join(f"avg(score) OVER w{n} AS score_mean{n}, coalesce(stddev_samp(score) OVER w{n}, 0) AS score_std{n}" for n in (5, 30)) + " FROM scored WINDOW w5 AS (PARTITION BY gun ORDER BY win ROWS 4 PRECEDING), w30 AS (PARTITION BY gun ORDER BY win ROWS 29 PRECEDING)")
add("sequences", "gun win", "first last", lambda c: experiments.sequences(c.scored(), "gun", "win", "score", 30).select("gun", "win", F.element_at("sequence", 1).alias("first"), F.element_at("sequence", -1).alias("last")), "SELECT gun, win, lag(score, 29) OVER (PARTITION BY gun ORDER BY win) AS \"first\", score AS \"last\" FROM scored QUALIFY row_number() OVER (PARTITION BY gun ORDER BY win) >= 30")
add("residual", "gun slot", "residual", lambda c: experiments.residual(c.rows(), normalise.normal(c.rows()), "k", "value"), "SELECT gun, slot, value - m AS residual FROM feats LEFT JOIN (SELECT k, quantile_cont(value, 0.5) AS m FROM feats WHERE label = 0 AND error_active = 0 GROUP BY k) USING (k)")
add("maintenance_features", "gun slot since_s count_6h", "share_6h", lambda c: experiments.maintenance(c.rows(), P.slot_s), """SELECT gun, slot, least(coalesce((slot - max(CASE WHEN nw THEN slot END) OVER (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING)) * 600, 21600), 21600) AS since_s,
  CAST(sum(CASE WHEN nw THEN 1 ELSE 0 END) OVER w AS BIGINT) AS count_6h, avg(CASE WHEN nw THEN 1.0 ELSE 0 END) OVER w AS share_6h FROM feats WINDOW w AS (PARTITION BY gun ORDER BY slot RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)""")
add("cumulative_reward", "gun win running", "", lambda c: experiments.running_sum(c.scored().withColumn("nano", F.round(F.col("score") * 1e9).cast("long")), "gun", "win", "nano"), "SELECT gun, win, CAST(sum(CAST(round(score * 1e9) AS BIGINT)) OVER (PARTITION BY gun ORDER BY win ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM scored")
add("band", "win", "low mean high var", lambda c: experiments.band(c.scored(), "win", "score"), "SELECT win, min(score) AS low, avg(score) AS mean, max(score) AS high, var_pop(score) AS var FROM scored GROUP BY win")
add_table("minmax", "part", "p_partkey", "minmax", lambda t: experiments.minmax(t, "p_retailprice"), "SELECT p_partkey, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) AS minmax FROM part")
add_table("by_maximum", "part", "p_partkey", "scaled", lambda t: experiments.by_maximum(t, "p_size"), "SELECT p_partkey, CASE WHEN p_size <> 0 THEN p_size / max(p_size) OVER () ELSE 0.01 END AS scaled FROM part")
add_table("pareto_front", "supplier", "s_suppkey", "", lambda t: experiments.pareto_front(t, "s_suppkey", ["s_nationkey", "s_acctbal"]), "SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey <= a.s_nationkey AND b.s_acctbal <= a.s_acctbal AND (b.s_nationkey < a.s_nationkey OR b.s_acctbal < a.s_acctbal))")

add_table("front_distance", "supplier", "", "distance", lambda t: experiments.front_distance(t, experiments.pareto_front(t, "s_suppkey", ["s_nationkey", "s_acctbal"]), ["s_nationkey", "s_acctbal"]), "SELECT avg(sqrt(d)) AS distance FROM (SELECT min(pow(a.s_nationkey - f.s_nationkey, 2) + pow(a.s_acctbal - f.s_acctbal, 2)) AS d FROM supplier a, (SELECT * FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey <= a.s_nationkey AND b.s_acctbal <= a.s_acctbal AND (b.s_nationkey < a.s_nationkey OR b.s_acctbal < a.s_acctbal))) f GROUP BY a.s_suppkey)")
_BRAND = "(SELECT DISTINCT p_brand, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part WHERE p_size < 51 AND p_retailprice < 1500)"
add_table("hypervolume", "part", "p_brand", "hypervolume", lambda t: experiments.hypervolume(t, "p_brand", ["p_size", "p_retailprice"], [51.0, 1500.0]), f"SELECT p_brand, coalesce(v, 0) AS hypervolume FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT p_brand, sum((51 - a) * (above - b)) AS v FROM (SELECT p_brand, a, b, coalesce(lag(b) OVER (PARTITION BY p_brand ORDER BY a), 1500) AS above FROM {_BRAND} x WHERE NOT EXISTS (SELECT 1 FROM {_BRAND} y WHERE y.p_brand = x.p_brand AND y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))) GROUP BY p_brand) USING (p_brand)")

# models
_NODES = [(0, 0, 0, 0.0, 1, 2), (0, 1, 1, 0.0, 3, 4), (0, 2, -1, 0.0, -1, -1), (0, 3, -1, 0.0, -1, -1), (0, 4, -1, 0.0, -1, -1), (1, 0, 1, 0.5, 1, 2), (1, 1, -1, 0.0, -1, -1), (1, 2, 0, 1.0, 3, 4), (1, 3, -1, 0.0, -1, -1), (1, 4, -1, 0.0, -1, -1)]


def _table_score(c: Chain) -> DataFrame:
    nodes = c.spark.createDataFrame(_NODES, "tree int, node int, feature int, split double, left int, right int")
    return models.forest_table_score(c.scored(), nodes, ["gun", "win"], ["value_mean", "k_mean"], 2)


add("forest_table_score", "gun win", "mean_depth", _table_score, "SELECT gun, win, (CASE WHEN value_mean < 0 THEN 2 ELSE 1 END + CASE WHEN k_mean < 0.5 THEN 1 ELSE 2 END) / 2.0::DOUBLE AS mean_depth FROM scored")


def iforest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Chain(spark, sf_dir)
    return models.iforest_score(c.scored().drop("score"), c.FOREST, c.forest()).select("gun", "win", F.round("score", 6).alias("score"))


def forest_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the forest with thresholds, alarms and severities, as the main path has them."""
    c = Chain(spark, sf_dir)
    levels = alarms.severity(c.forest_alarmed(), alarms.triggers(c.windows(), P), P)
    return levels.select("gun", "win", "warmup", "score", "threshold", "alarm", "held", "severity")


def trigger_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trigger with the chance that it is a true one, by a model of the other machines."""
    c = Chain(spark, sf_dir)
    fired = alarms.triggers(c.windows(), P).select("gun", "win", "repeat")
    rows = c.windows().join(fired, ["gun", "win"]).withColumn("near", (F.col("ttf_s") <= P.label_s).cast("int"))
    return models.trigger_classifier(rows.select("gun", "win", "repeat", "near", *c.FOREST), c.FOREST, "near").select("gun", "win", "repeat", "near", F.round("score", 6).alias("score"))


def pca_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Chain(spark, sf_dir).scored()
    mean, axes = models.pca_fit(normalise.normal(w), ATTRIBUTED, 2)
    return models.pca_score(w.drop("score"), ATTRIBUTED, mean, axes).select("gun", "win", F.round("score", 6).alias("score"))


def gbt_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Chain(spark, sf_dir).windows().select("gun", "win", *ATTRIBUTED, "label")
    scored, _ = models.gbt_bound(rows, ATTRIBUTED, "label")
    return scored.select("gun", "win", "label", F.round("score", 6).alias("score"))


QUERIES |= {"iforest_score": iforest_score, "forest_alarms": forest_alarms, "trigger_scores": trigger_scores, "pca_score": pca_score, "gbt_upper_bound": gbt_upper_bound}


# streaming, run to completion over what the folder holds
def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, be it one file or a folder of part files.

    All files make one micro-batch: part files need not be in the order of time, and smaller batches would make the
    readings of later ones late. Sorts and groupings of a batch spill, so its size is bounded by disk alone.
    """
    path = f"{sf_dir}/events.parquet"
    stored = spark.read.parquet(path)
    files = stored.inputFiles()
    source = spark.readStream.schema(stored.schema)
    if len(files) == 1 and files[0].endswith("/events.parquet"):
        return source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.parquet(path)


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed by the end of the stream."""
    frame, folder = streaming.tumbling(_source(spark, sf_dir), "1 hour", "0 seconds"), _folder(spark, "tumbling")
    query = frame.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(frame.schema).parquet(f"{folder}/rows")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(w.start AS TIMESTAMP_NTZ))")
    return rows.select(start.alias("start_us"), "event_type", "n", (F.round("mean", 6) + 0.0).alias("mean"))


QUERIES["stream_tumbling"] = stream_tumbling
ORACLES["stream_tumbling"] = """SELECT start_us, event_type, count(*) AS n, round(avg(value), 6) + 0.0::DOUBLE AS mean
FROM (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, value FROM events)
WHERE start_us + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) GROUP BY start_us, event_type"""


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online decisions over the event stream; tests hold them against the same machine's rows at once."""
    folder = _folder(spark, "decisions")
    sink = streaming.OnlineDecisions(folder, 21_600, 43_200, P.cooldown_s, P.repeat_s, tuple(TERMINAL_CODES))
    source = decision_input(_source(spark, sf_dir))
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if sink.last is None:
        return spark.createDataFrame([], streaming.OUTPUT)
    sink.finish(spark)
    return sink.decided(spark)


def decision_input(events: DataFrame) -> DataFrame:
    """gun, t in seconds, event_id, an alarm on the value, and the state code of each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*[F.lit(c) for c in TERMINAL_CODES])
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.select((F.col("user_id") % 8).cast("int").alias("gun"), t.alias("t"), "event_id", (F.col("value") > 50).cast("int").alias("alarm"), F.when(F.col("event_type") == "error", codes[F.pmod(k, F.lit(4))]).otherwise("0").alias("code"))


QUERIES["stream_decisions"] = stream_decisions


#: Slots of a request: half a day.
REQUEST_SLOTS = 72


def serving_card(spark: SparkSession, sf_dir: str) -> serving.Card:
    """The chain's scaler, forest and threshold for online scoring of the event table."""
    c = Chain(spark, sf_dir)
    scaler = normalise.scaler_fit(c.rows()).first()
    grown = c.forest()
    scored = models.iforest_score(normalise.normal(c.scored()).drop("score"), c.FOREST, grown)
    medians = evaluate.quantiles(scored, c.FOREST, 0.5)
    numbers = scored.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    return serving.Card(
        profile=P, inputs=windows.FEATURES, held=("value", "k"), counters={}, duty=("duty_roll", "value", 50.0), share="error_share", welding=("nw", -1.0, 0.5),
        scaler={x: (scaler[f"{x}_mu"], scaler[f"{x}_sd"]) for x in normalise.SCALED_COLUMNS}, centred=normalise.SCALED_COLUMNS, forest=grown,
        threshold=evaluate.quantile(scored, "score", P.quantile), reference=np.array([medians[x] for x in c.FOREST]), score_mean=numbers["m"], score_std=numbers["s"] or 1.0,
    )


def serving_input(events: DataFrame, card: serving.Card) -> DataFrame:
    """The event table's readings as requests of half a day for each machine. These span ``REQUEST_SLOTS`` slots, below
    ``Card.longest``, so that none is refused however many readings a slot has."""
    k, us = F.get_json_object("props", "$.k").cast("int"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    codes = F.array(*[F.lit(c) for c in TERMINAL_CODES])
    code = F.when(F.col("event_type") == "error", codes[F.pmod(k, F.lit(4))]).when(F.col("event_type") == "signup", "E003").otherwise("0")
    rows = events.select((F.col("user_id") % 8).alias("gun"), us.alias("arrival"), F.col("event_id").alias("tie"), F.floor(us / (P.slot_s * 1_000_000)).cast("long").alias("t"), "value", k.alias("k"), (F.col("event_type") == "view").cast("int").alias("nw"), code.alias("code"), F.lit("").alias("control"))
    return serving.requests(rows.withColumn("request", F.floor(F.col("t") / REQUEST_SLOTS)), card)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online scores of the event stream, a row for each request; tests hold them against the same steps outside Spark."""
    card = serving_card(spark, sf_dir)
    rows = serving.run(serving_input(_source(spark, sf_dir), card), card, _folder(spark, "scores"))
    return rows.select("gun", "request", "status", "history", "window_start", "window_end", "windows_scored", F.round("anomaly_score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "gun_norm", "alarm_held", "consecutive_alarms", "rule_triggered", "rule_repeat", "severity", "hands_off")


def handoff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents of the online results that hand off."""
    card = serving_card(spark, sf_dir)
    rows = serving.run(serving_input(_source(spark, sf_dir), card), card, _folder(spark, "handoffs"))
    return documents.nested(rows, slot_s=P.slot_s, window_s=P.window_slots * P.slot_s)


def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the online scores of the event stream come to, a row for each machine."""
    card = serving_card(spark, sf_dir)
    rows = serving.run(serving_input(_source(spark, sf_dir), card), card, _folder(spark, "replay"))
    return replay.summary(rows).withColumn("top_score", F.round("top_score", 6))


QUERIES |= {"stream_scores": stream_scores, "handoff_documents": handoff_documents, "replay_summary": replay_summary}
