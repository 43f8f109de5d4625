"""Registered queries of summaries, folds, bands and variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weldsight.config import SCALED as P
from weldsight.config import TERMINAL_CODES
from weldsight.operators import alarms, evaluate, normalise, shape, summaries, windows
from weldsight.plans import oracles
from weldsight.plans.chain import ATTRIBUTED, Chain
from weldsight.plans.queries import add, add_table

#: The event table's columns in the places of the machine's: views for a block without welding, purchases for welds.
SPEC = summaries.Spec({"outlier_rate": "nw", "high_share": "value > 50", "k_zero_share": "k = 0"}, {"buys": "buys"}, ("value", "k", "buys"), 0.75)


def _raw(c: Chain) -> DataFrame:
    return c.sensor.groupBy("gun").agg(F.count(F.lit(1)).alias("n_raw_rows"))


def _files(c: Chain) -> DataFrame:
    return summaries.file_report(c.grid(), _raw(c), P, SPEC)


_RUNS = """SELECT gun, class, code, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS slots, min(ttf_s) AS end_ttf FROM
  (SELECT *, sum(c) OVER (PARTITION BY gun ORDER BY slot) AS e FROM (SELECT *, (max(slot) OVER (PARTITION BY gun) - slot) * 600 AS ttf_s, CASE WHEN code = lag(code) OVER (PARTITION BY gun ORDER BY slot) THEN 0 ELSE 1 END AS c FROM grid))
  WHERE code <> '0' GROUP BY gun, class, code, e"""
_FILES = f"""SELECT b.*, (end_slot - start_slot) * 600 / 86400.0::DOUBLE AS span_days, 1 - here / n_grid::DOUBLE AS missing_rate, CASE WHEN 1 - here / n_grid::DOUBLE > 0.75 THEN 1 ELSE 0 END AS discarded,
  n_raw_rows, coalesce(n_gaps, 0) AS n_gaps, coalesce(longest_gap, 0) AS longest_gap, coalesce(gaps_over_1h, 0) AS gaps_over_1h, coalesce(n_error_episodes, 0) AS n_error_episodes, coalesce(n_error_codes, 0) AS n_error_codes,
  coalesce(top_code, '') AS top_code, last_code, last_code_end_s, last_code_duration_s, buys_total, buys_total / ((end_slot - start_slot) * 600 / 3600.0::DOUBLE) AS buys_per_hour, nunique_value, nunique_k, nunique_buys
  FROM (SELECT gun, class, count(*) AS n_grid, min(slot) AS start_slot, max(slot) AS end_slot, sum(present) AS here, avg(CASE WHEN nw THEN 1.0 ELSE 0 END) FILTER (present = 1) AS outlier_rate, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) FILTER (present = 1) AS high_share,
      avg(CASE WHEN k = 0 THEN 1.0 ELSE 0 END) FILTER (present = 1) AS k_zero_share, avg(CASE WHEN code <> '0' THEN 1.0 ELSE 0 END) AS error_state_share, count(DISTINCT value) AS nunique_value, count(DISTINCT k) AS nunique_k, count(DISTINCT buys) AS nunique_buys,
      max(buys) - min(buys) AS buys_total FROM grid GROUP BY gun, class) b
  JOIN (SELECT gun, count(*) AS n_raw_rows FROM sensor GROUP BY gun) USING (gun)
  LEFT JOIN (SELECT gun, count(*) AS n_gaps, max(gap) AS longest_gap, CAST(sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) AS BIGINT) AS gaps_over_1h FROM holes GROUP BY gun) USING (gun)
  LEFT JOIN (SELECT gun, count(*) AS n_error_episodes, count(DISTINCT code) AS n_error_codes FROM ({_RUNS}) GROUP BY gun) USING (gun)
  LEFT JOIN (SELECT gun, code AS top_code FROM (SELECT gun, code, sum(slots) AS n FROM ({_RUNS}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gun ORDER BY n DESC, code DESC) = 1) USING (gun)
  LEFT JOIN (SELECT gun, code AS last_code, end_ttf AS last_code_end_s, slots * 600 AS last_code_duration_s FROM ({_RUNS}) QUALIFY row_number() OVER (PARTITION BY gun ORDER BY last_slot DESC) = 1) USING (gun)"""
_FILES = f"SELECT f.*, coalesce(last_codes, '') AS last_codes FROM ({_FILES}) f LEFT JOIN (SELECT gun, string_agg(code, ',' ORDER BY code) AS last_codes FROM (SELECT DISTINCT gun, code FROM (SELECT gun, code, (max(slot) OVER (PARTITION BY gun) - slot) * 600 AS t FROM grid) WHERE code <> '0' AND t <= 21600) GROUP BY gun) USING (gun)"
add(
    "file_report", "gun class n_raw_rows n_grid start_slot end_slot n_gaps longest_gap gaps_over_1h n_error_episodes n_error_codes top_code last_code last_code_end_s last_code_duration_s last_codes discarded buys_total nunique_value nunique_k nunique_buys",
    "span_days missing_rate outlier_rate high_share k_zero_share error_state_share buys_per_hour", _files, _FILES,
)
_MEANS = "span_days missing_rate outlier_rate high_share k_zero_share buys_per_hour n_error_episodes error_state_share".split()
add("class_report", "class files discarded start_min end_max", "missing_max " + " ".join(_MEANS), lambda c: summaries.class_report(_files(c), SPEC), "SELECT class, count(*) AS files, CAST(sum(discarded) AS BIGINT) AS discarded, min(start_slot) AS start_min, max(end_slot) AS end_max, max(missing_rate) AS missing_max, " + ", ".join(f"avg({m}) AS {m}" for m in _MEANS) + f" FROM ({_FILES}) GROUP BY class")
add("episode_report", "class code files episodes max_duration_s", "total_hours median_duration_s median_ttf_end_h min_ttf_end_h", lambda c: summaries.episode_report(summaries.code_runs(c.grid(), P), P.slot_s), f"SELECT class, code, count(DISTINCT gun) AS files, count(*) AS episodes, max(slots * 600) AS max_duration_s, sum(slots) * 600 / 3600.0::DOUBLE AS total_hours, quantile_cont(slots * 600, 0.5) AS median_duration_s, quantile_cont(end_ttf / 3600.0::DOUBLE, 0.5) AS median_ttf_end_h, min(end_ttf) / 3600.0::DOUBLE AS min_ttf_end_h FROM ({_RUNS}) GROUP BY class, code")
_CODES = ["E003", *TERMINAL_CODES]
add("last_code_by_class", "class none " + " ".join(_CODES), "", lambda c: summaries.last_codes(_files(c), _CODES), "SELECT class, count(*) FILTER (last_code IS NULL) AS none, " + ", ".join(f"count(*) FILTER (last_code = '{x}') AS {x}" for x in _CODES) + f" FROM ({_FILES}) GROUP BY class")
add("codes_at_the_end", "class " + " ".join(_CODES), "", lambda c: summaries.codes_at_the_end(_files(c), _CODES), "SELECT class, " + ", ".join(f"count(DISTINCT gun) FILTER (code = '{x}') AS {x}" for x in _CODES) + " FROM (SELECT *, (max(slot) OVER (PARTITION BY gun) - slot) * 600 AS t FROM grid) WHERE t <= 21600 GROUP BY class")
add("hourly_ttf_profile", "gun ttf_h n", "welding_share error_share value_mean k_mean", lambda c: summaries.hourly_profile(c.rows(), ["value", "k"]), "SELECT gun, ttf_s // 3600 AS ttf_h, count(*) AS n, avg(CASE WHEN nw THEN 0.0 ELSE 1 END) AS welding_share, avg(CASE WHEN code <> '0' THEN 1.0 ELSE 0 END) AS error_share, avg(value) AS value_mean, avg(k) AS k_mean FROM feats GROUP BY 1, 2")
add("gap_report", "class n min max", "mean std p50 p90 p99", lambda c: summaries.gap_report(c.grid()), " UNION ALL ".join(f"SELECT {name} AS class, count(*) AS n, min(gap) AS min, max(gap) AS max, avg(gap) AS mean, stddev_samp(gap) AS std, quantile_cont(gap, 0.5) AS p50, quantile_cont(gap, 0.9) AS p90, quantile_cont(gap, 0.99) AS p99 FROM holes {group}" for name, group in (("class", "GROUP BY class"), ("'all'", ""))))

# evaluation
FOLDS = 4


def _folds(c: Chain) -> DataFrame:
    return F.broadcast(evaluate.folds(c.sensor.select("gun", "class").distinct(), FOLDS).drop("class"))  # a row for each file


_PLACED = "SELECT s.*, f.fold FROM scored s JOIN (SELECT gun, CAST((row_number() OVER (PARTITION BY class ORDER BY md5(CAST(gun AS VARCHAR)), gun) - 1) % 4 AS INT) AS fold FROM spans) f USING (gun)"
_FOLD_SIDES = f"(SELECT *, CASE WHEN label = 1 THEN 1 ELSE 0 END AS pos FROM ({_PLACED}) WHERE label = 1 OR error_active = 0)"
_LEVELS = f"SELECT g.own AS fold, quantile_cont(score, 0.9) AS level FROM (SELECT unnest([0, 1, 2, 3]) AS own) g JOIN ({_PLACED}) p ON p.fold <> g.own WHERE label = 0 AND error_active = 0 GROUP BY g.own"
_EACH = f"""SELECT fold, auroc, auroc_gun_mean, auprc, recall_pre_failure, alarm_rate_normal FROM (SELECT fold, avg(over_) FILTER (label = 1) AS recall_pre_failure, avg(over_) FILTER (label = 0 AND error_active = 0) AS alarm_rate_normal
  FROM (SELECT p.*, CASE WHEN score > level AND NOT non_welding > 0.5 THEN 1.0 ELSE 0 END AS over_ FROM ({_PLACED}) p JOIN ({_LEVELS}) USING (fold)) GROUP BY fold)
  LEFT JOIN ({oracles.auroc(_FOLD_SIDES, "fold")}) USING (fold) LEFT JOIN (SELECT fold, avg(auroc) AS auroc_gun_mean FROM ({oracles.auroc(_FOLD_SIDES, "fold, gun")}) GROUP BY fold) USING (fold)
  LEFT JOIN (SELECT fold, sum(CASE WHEN pos = 1 THEN tp / seen END) / sum(pos) AS auprc FROM (SELECT fold, pos, CAST(sum(pos) OVER w AS DOUBLE) AS tp, count(*) OVER w AS seen FROM {_FOLD_SIDES} WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) GROUP BY fold) USING (fold)"""
_LONG = " UNION ALL ".join(f"SELECT fold, '{m}' AS metric, {m} AS value FROM ({_EACH})" for m in summaries.FOLD_METRICS)
add("fold_metrics", "fold metric", "value", lambda c: summaries.fold_metrics(c.scored(), _folds(c), FOLDS, P), f"SELECT CAST(fold AS VARCHAR) AS fold, metric, value FROM ({_LONG}) UNION ALL SELECT 'mean', metric, avg(value) FROM ({_LONG}) GROUP BY metric UNION ALL SELECT 'sd', metric, stddev_pop(value) FROM ({_LONG}) GROUP BY metric")
_BANDS = " UNION ALL ".join(f"SELECT *, '{a}-{b}' AS band FROM sides WHERE (label = 0 AND ttf_s > 172800) OR (label = 1 AND ttf_s <= {b * 1440} AND ttf_s {'>' if a else '>='} {a * 1440})" for a, b in summaries.BANDS)
add("auroc_bands", "band positives negatives", "auroc", lambda c: summaries.auroc_bands(c.scored(), P), oracles.auroc(f"({_BANDS})", "band"))
_ONLY = {"all": ((), ()), "only E02": (("E02",), ()), "without E02": ((), ("E02",))}


def _filters(c: Chain) -> DataFrame:
    parts = [evaluate.auroc(summaries.only_classes(c.scored(), *how)).withColumn("classes", F.lit(name)) for name, how in _ONLY.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add("class_filters", "classes positives negatives", "auroc", _filters, " UNION ALL ".join(f"SELECT '{name}' AS classes, * FROM ({oracles.auroc(f'(SELECT * FROM sides WHERE {cond})')})" for name, cond in (("all", "TRUE"), ("only E02", "class = 'E02'"), ("without E02", "class <> 'E02'"))))
add("held_share", "gun windows held_windows", "held_share", lambda c: summaries.held_share(c.windows(), P.gate), "SELECT gun, count(*) AS windows, count(*) FILTER (non_welding > 0.5) AS held_windows, avg(CASE WHEN non_welding > 0.5 THEN 1.0 ELSE 0 END) AS held_share FROM wins GROUP BY gun")
_RULES = """SELECT coalesce(triggers, 0) AS triggers, coalesce(repeats, 0) AS repeats, lead_s, coalesce(false_n, 0) / ((span - 86400) / 86400.0::DOUBLE) AS false_per_day
  FROM (SELECT gun, max(ttf_s) AS span FROM wins GROUP BY gun) LEFT JOIN (SELECT gun, count(*) AS triggers, sum(repeat) AS repeats, max(CASE WHEN ttf_s <= 86400 THEN ttf_s END) AS lead_s, sum(CASE WHEN ttf_s > 86400 AND repeat = 0 THEN 1 ELSE 0 END) AS false_n FROM fired GROUP BY gun) USING (gun)"""
add("rule_summary", "files files_hit triggers repeats", "lead_min_median false_per_day", lambda c: summaries.rule_summary(evaluate.rule_metrics(c.windows(), alarms.triggers(c.windows(), P), P)), f"SELECT count(*) AS files, count(lead_s) AS files_hit, CAST(sum(triggers) AS BIGINT) AS triggers, CAST(sum(repeats) AS BIGINT) AS repeats, quantile_cont(lead_s / 60.0::DOUBLE, 0.5) AS lead_min_median, avg(false_per_day) AS false_per_day FROM ({_RULES})")
add("feature_scale", "feature", "reference scale", lambda c: summaries.feature_scale(c.scored(), c.FOREST), " UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, 0.5) AS reference, stddev_samp({f}) AS scale FROM scored WHERE label = 0 AND error_active = 0" for f in Chain.FOREST))
# the SQL sums the readings before they were scaled
add("unscaled_context", "gun segment win", "value_own value_sum k_own k_sum", lambda c: summaries.unscaled(c.windows(), normalise.scaler_fit(c.rows()), ["value", "k"]), "SELECT gun, segment, slot // 6 AS win, avg(value) AS value_own, sum(value) AS value_sum, avg(k) AS k_own, sum(k) AS k_sum FROM feats GROUP BY ALL HAVING count(*) >= 3")

# variants
_LAST = "least(coalesce((slot - max(CASE WHEN {} THEN slot END) OVER p) * 600, 21600), 21600)"
add("maintenance_history", "gun slot since_block_s block_count since_change_s changes welds_since_block", "block_share offset_ratio", lambda c: summaries.maintenance_history(c.rows(), P.slot_s, "k", "buys_delta"), f"""SELECT gun, slot, {_LAST.format("nw")} AS since_block_s, count(*) FILTER (nw) OVER w AS block_count, avg(CASE WHEN nw THEN 1.0 ELSE 0 END) OVER w AS block_share, {_LAST.format("changed")} AS since_change_s, count(*) FILTER (changed) OVER w AS changes,
  CASE WHEN avg(k) OVER w <> 0 THEN k / avg(k) OVER w END AS offset_ratio, CAST(sum(buys_delta) OVER (PARTITION BY gun, block ORDER BY slot RANGE BETWEEN 35 PRECEDING AND CURRENT ROW) AS BIGINT) AS welds_since_block
  FROM (SELECT *, coalesce(k <> lag(k) OVER (PARTITION BY gun ORDER BY slot), FALSE) AS changed, count(*) FILTER (nw) OVER (PARTITION BY gun ORDER BY slot) AS block FROM feats)
  WINDOW p AS (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY gun ORDER BY slot RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)""")
_LENGTHS = (5, 30, 60, 1440)
_HISTORY = [f"{f}_{s}{n}" for n in _LENGTHS for f in Chain.FOREST for s in ("mean", "std")]
add("history_48", "gun win", " ".join(_HISTORY), lambda c: summaries.history_features(c.windows(), c.FOREST, _LENGTHS), "SELECT gun, win, " + ", ".join(f"avg({f}) OVER w{n} AS {f}_mean{n}, coalesce(stddev_samp({f}) OVER w{n}, 0) AS {f}_std{n}" for n in _LENGTHS for f in Chain.FOREST) + " FROM wins WINDOW " + ", ".join(f"w{n} AS (PARTITION BY gun ORDER BY win ROWS {n - 1} PRECEDING)" for n in _LENGTHS))
_METHODS = ["quiet", "failing", "error"]
_GUNS = list(range(8))


def _matrix(c: Chain) -> DataFrame:
    kind = F.when(F.col("label") == 1, "failing").when(F.col("error_active") == 1, "error").otherwise("quiet")
    return summaries.pivoted(c.scored().withColumn("kind", kind), "gun", "kind", F.col("score"), _METHODS)


_KIND = "SELECT *, CASE WHEN label = 1 THEN 'failing' WHEN error_active = 1 THEN 'error' ELSE 'quiet' END AS kind FROM scored"
add("score_matrix", "gun", " ".join(_METHODS), _matrix, "SELECT gun, " + ", ".join(f"quantile_cont(score, 0.5) FILTER (kind = '{m}') AS {m}" for m in _METHODS) + f" FROM ({_KIND}) GROUP BY gun")
add("score_matrix_transposed", "method", " ".join(f"run_{g}" for g in _GUNS), lambda c: summaries.transposed(_matrix(c), "gun", _METHODS, _GUNS), "SELECT m AS method, " + ", ".join(f"quantile_cont(score, 0.5) FILTER (gun = {g} AND kind = m) AS run_{g}" for g in _GUNS) + f" FROM (SELECT unnest({_METHODS}) AS m), ({_KIND}) GROUP BY m")
add_table("list_add", "embeddings", "label position n", "total", lambda t: summaries.list_add(t, "label", "embedding"), "SELECT label, CAST(p - 1 AS INT) AS position, count(x) AS n, sum(CAST(x AS DOUBLE)) AS total FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL")


def _card(c: Chain) -> DataFrame:
    s = c.scored()
    data = s.agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("gun").alias("files"), F.sum(((F.col("label") == 0) & (F.col("error_active") == 0)).cast("int")).alias("training_windows"))
    return summaries.card({
        "data": data, "scaler": normalise.scaler_fit(c.rows()), "reference": normalise.feature_reference(s, ATTRIBUTED), "model": normalise.global_threshold(s, P.quantile),
        "ranking": evaluate.auroc(s).select("auroc"), "precision": evaluate.auprc(s), "alarms": evaluate.alarm_rates(c.alarmed()).select("normal_rate", "recall", "held"),
    })


_QUIET = "label = 0 AND error_active = 0"
_CARD = {
    "data": ("windows files training_windows", f"SELECT count(*) AS windows, count(DISTINCT gun) AS files, count(*) FILTER ({_QUIET}) AS training_windows FROM scored"),
    "scaler": ("value_mu value_sd k_mu k_sd", "SELECT * FROM scaler"),
    "reference": (" ".join(ATTRIBUTED), "SELECT " + ", ".join(f"quantile_cont({x}, 0.5) AS {x}" for x in ATTRIBUTED) + f" FROM scored WHERE {_QUIET}"),
    "model": ("threshold", "SELECT * FROM thr"),
    "ranking": ("auroc", oracles.auroc("sides")),
    "precision": ("auprc", "SELECT sum(CASE WHEN pos = 1 THEN tp / seen END) / sum(pos) AS auprc FROM (SELECT pos, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp, count(*) OVER (ORDER BY score DESC) AS seen FROM sides)"),
    "alarms": ("normal_rate recall held", f"SELECT avg(alarm) FILTER ({_QUIET}) AS normal_rate, avg(alarm) FILTER (label = 1) AS recall, sum(held) AS held FROM alarmed"),
}
#: What a model is: its data, scaler, reference values, threshold and figures.
add("model_card", "part name", "value", _card, " UNION ALL ".join(f"SELECT '{part}' AS part, '{x}' AS name, CAST({x} AS DOUBLE) AS value FROM ({sql})" for part, (names, sql) in _CARD.items() for x in names.split()))
