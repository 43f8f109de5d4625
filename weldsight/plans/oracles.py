"""SQL of the registered queries: one list of stages, and a last step for each query."""

from __future__ import annotations

_PI2 = "(2 * 3.141592653589793 / 24)"

_WINDOWS = """SELECT gun, class, segment, slot // 6 AS win, avg(value) AS value_mean, avg(k) AS k_mean, avg(error_share) AS error_share_mean, coalesce(stddev_samp(value), 0) AS value_std, coalesce(stddev_samp(k), 0) AS k_std,
  coalesce(stddev_samp(error_share), 0) AS error_share_std, max(error_active) AS error_active, max(terminal_code) AS terminal_code, max(terminal_any) AS terminal_any, max(terminal_idx) AS terminal_idx, max(label) AS label,
  avg(CASE WHEN nw THEN 1.0 ELSE 0 END) AS non_welding, min(ttf_s) AS ttf_s, count(*) AS n FROM {} GROUP BY ALL"""
_SCORE = "round(1 - exp(-(abs(value_mean) + abs(k_mean) + abs(value_std) + abs(k_std)) / 4), 9)"

STAGES = {
    "sensor": """SELECT CAST(user_id % 8 AS INT) AS gun, 'E0' || (user_id % 4 + 1) AS class, event_id, epoch_us(ts) AS us, value,
  CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE event_type WHEN 'error' THEN ['E012', 'E016', 'E028', 'E029'][CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1] WHEN 'signup' THEN 'E003' ELSE '0' END AS code,
  event_type = 'view' AS nw, epoch_us(ts) // 600000000 AS slot,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS buys
  FROM events""",
    "dedup": "SELECT * FROM sensor QUALIFY row_number() OVER (PARTITION BY gun, slot ORDER BY us DESC, event_id DESC) = 1",
    "spans": "SELECT gun, any_value(class) AS class, min(slot) AS a, max(slot) AS b FROM dedup GROUP BY gun",
    "slots": "SELECT gun, class, unnest(range(a, b + 1)) AS slot FROM spans",
    "grid0": "SELECT s.gun, s.class, s.slot, d.event_id, d.us, d.value, d.k, d.code, d.nw, d.buys, CASE WHEN d.gun IS NULL THEN 0 ELSE 1 END AS present FROM slots s LEFT JOIN dedup d USING (gun, slot)",
    "grid": "SELECT * REPLACE (coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING), '0') AS code) FROM grid0",
    "island": "SELECT *, sum(present) OVER (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING) AS island FROM grid",
    "held": """SELECT *, count(*) OVER (PARTITION BY gun, island) - 1 AS gap, last_value(value IGNORE NULLS) OVER w AS v2, last_value(k IGNORE NULLS) OVER w AS k2,
  last_value(nw IGNORE NULLS) OVER w AS nw2, last_value(buys IGNORE NULLS) OVER w AS buys2 FROM island WINDOW w AS (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING)""",
    "filled": "SELECT gun, class, slot, v2 AS value, k2 AS k, code, nw2 AS nw, buys2 AS buys, present FROM held WHERE present = 1 OR gap <= 6",
    "segmented": "SELECT * EXCLUDE (step), CAST(sum(CASE WHEN step > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT *, slot - lag(slot) OVER (PARTITION BY gun ORDER BY slot) AS step FROM filled)",
    "carried": """SELECT * EXCLUDE (bv, bk) REPLACE (coalesce(last_value(bv IGNORE NULLS) OVER p, first_value(bv IGNORE NULLS) OVER f) AS value, coalesce(last_value(bk IGNORE NULLS) OVER p, first_value(bk IGNORE NULLS) OVER f) AS k)
  FROM (SELECT *, CASE WHEN NOT nw THEN value END AS bv, CASE WHEN NOT nw THEN k END AS bk FROM segmented)
  WINDOW p AS (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY gun ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "shaped": "SELECT *, CASE WHEN ttf_s <= 86400 THEN 1 ELSE 0 END AS label FROM (SELECT *, (max(slot) OVER (PARTITION BY gun) - slot) * 600 AS ttf_s FROM carried)",
    "deltas": "SELECT *, coalesce(greatest(buys - lag(buys) OVER (PARTITION BY gun, segment ORDER BY slot), 0), 0) AS buys_delta FROM shaped",
    "rolled": """SELECT *, CAST(sum(buys_delta) OVER w AS BIGINT) AS buys_roll, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) OVER w AS duty_roll, avg(CASE WHEN code <> '0' THEN 1.0 ELSE 0 END) OVER w AS error_share
  FROM deltas WINDOW w AS (PARTITION BY gun, segment ORDER BY slot RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)""",
    "stated": """SELECT *, CASE WHEN code <> '0' THEN 1 ELSE 0 END AS error_active, CASE WHEN terminal_idx > 0 THEN 1 ELSE 0 END AS terminal_any,
  CASE WHEN terminal_idx > 0 AND class = 'E0' || terminal_idx THEN 1 ELSE 0 END AS terminal_code
  FROM (SELECT *, coalesce(list_position(['E012', 'E016', 'E028', 'E029'], code), 0) AS terminal_idx FROM rolled)""",
    "feats": f"SELECT *, sin((slot * 600 // 60 % 1440) / 60.0::DOUBLE * {_PI2}) AS hour_sin, cos((slot * 600 // 60 % 1440) / 60.0::DOUBLE * {_PI2}) AS hour_cos, CAST((slot * 600 // 86400 + 3) % 7 AS INT) AS dow FROM stated",
    "scaler": "SELECT avg(value) AS value_mu, stddev_samp(value) AS value_sd, avg(k) AS k_mu, stddev_samp(k) AS k_sd FROM feats WHERE label = 0 AND error_active = 0",
    "scaled": "SELECT feats.* REPLACE ((value - value_mu) / value_sd AS value, (k - k_mu) / k_sd AS k) FROM feats, scaler",
    "win_all": _WINDOWS.format("scaled"),
    "wins": "SELECT * FROM win_all WHERE n >= 3",
    # the warm-up is 432,000 s = 720 slots from a gun's first; 50 normal welding readings make its own statistics
    "ends": "SELECT gun, min(slot) + 720 AS warm_end FROM scaled GROUP BY gun",
    "warm": """SELECT e.gun, any_value(warm_end) AS warm_end, avg(value) AS value_gm, greatest(stddev_pop(value), 0.25) AS value_gs, avg(k) AS k_gm, greatest(stddev_pop(k), 0.25) AS k_gs, count(s.gun) AS warm_n
  FROM ends e LEFT JOIN scaled s ON s.gun = e.gun AND slot < warm_end AND NOT nw AND error_active = 0 GROUP BY e.gun""",
    "recentred": """SELECT s.* REPLACE (CASE WHEN slot >= warm_end AND warm_n >= 50 THEN value - value_gm ELSE value END AS value, CASE WHEN slot >= warm_end AND warm_n >= 50 THEN k - k_gm ELSE k END AS k)
  FROM scaled s JOIN warm USING (gun)""",
    "centred": f"SELECT w.*, CASE WHEN win * 6 < warm_end THEN 1 ELSE 0 END AS warmup FROM ({_WINDOWS.format('recentred')}) w JOIN ends USING (gun) WHERE n >= 3",
    "rescaled": f"""SELECT * FROM ({_WINDOWS.format("(SELECT s.* REPLACE (CASE WHEN slot >= warm_end AND warm_n >= 50 THEN (value - value_gm) / value_gs ELSE value END AS value) FROM scaled s JOIN warm USING (gun))")}) WHERE n >= 3""",
    "scored": f"SELECT *, {_SCORE} AS score FROM centred",
    "thr": "SELECT quantile_cont(score, 0.9) AS threshold FROM scored WHERE label = 0 AND error_active = 0",
    "calibration": f"""SELECT gun, {_SCORE} AS score FROM ({_WINDOWS.format("(SELECT s.* REPLACE (value - value_gm AS value, k - k_gm AS k) FROM scaled s JOIN warm USING (gun) WHERE slot < warm_end AND warm_n >= 50)")}) WHERE n >= 3""",
    "gun_q": "SELECT gun, quantile_cont(score, 0.9) AS q, count(*) AS windows FROM calibration GROUP BY gun",
    "gun_thr": "SELECT gun, CASE WHEN windows >= 10 THEN greatest(threshold, q) ELSE threshold END AS threshold, threshold AS overall, coalesce(windows, 0) AS windows FROM (SELECT DISTINCT gun FROM scored) LEFT JOIN gun_q USING (gun), thr",
    "judged": "SELECT s.*, CASE WHEN warmup = 1 THEN overall ELSE threshold END AS threshold FROM scored s JOIN gun_thr USING (gun)",
    "alarmed": "SELECT *, CASE WHEN score > threshold AND NOT non_welding > 0.5 THEN 1 ELSE 0 END AS alarm, CASE WHEN score > threshold AND non_welding > 0.5 THEN 1 ELSE 0 END AS held FROM judged",
    "runs": """SELECT gun, min(win) AS first_win, max(win) AS last_win, count(*) AS windows, max(ttf_s) AS start_ttf, min(ttf_s) AS end_ttf, max(score) AS top_score
  FROM (SELECT *, win - row_number() OVER (PARTITION BY gun ORDER BY win) AS run FROM alarmed WHERE alarm = 1) GROUP BY gun, run HAVING count(*) >= 2""",
    "onsets": "SELECT * FROM (SELECT *, coalesce(lag(terminal_any) OVER (PARTITION BY gun ORDER BY win), 0) AS before FROM wins) WHERE terminal_any = 1 AND before = 0",
    "fired_at": """SELECT gun, min(win) AS win FROM onsets GROUP BY gun
  UNION ALL SELECT f.gun, (SELECT min(o.win) FROM onsets o WHERE o.gun = f.gun AND o.win >= f.win + 6) FROM fired_at f
  WHERE EXISTS (SELECT 1 FROM onsets o WHERE o.gun = f.gun AND o.win >= f.win + 6)""",
    "fired": "SELECT *, CASE WHEN lag(ttf_s) OVER (PARTITION BY gun, terminal_idx ORDER BY win) - ttf_s < 259200 THEN 1 ELSE 0 END AS repeat FROM (SELECT gun, win, terminal_idx, ttf_s FROM onsets SEMI JOIN fired_at USING (gun, win))",
    "lasting": """SELECT *, CASE WHEN alarm = 1 THEN win - coalesce(max(CASE WHEN alarm = 0 THEN win END) OVER (PARTITION BY gun ORDER BY win ROWS UNBOUNDED PRECEDING), min(win) OVER (PARTITION BY gun) - 1) ELSE 0 END AS alarm_windows FROM alarmed""",
    "severe": """SELECT l.*, CASE WHEN alarm_windows >= 2 THEN 1 ELSE 0 END AS sustained, CASE WHEN f.win IS NULL THEN 0 ELSE 1 END AS fired, coalesce(f.repeat, 0) AS repeat,
  CASE WHEN alarm_windows >= 2 OR (f.win IS NOT NULL AND f.repeat = 0) THEN 'critical' WHEN alarm = 1 OR f.win IS NOT NULL THEN 'warning' ELSE 'normal' END AS severity
  FROM lasting l LEFT JOIN fired f ON l.gun = f.gun AND l.win = f.win""",
    "handed": "SELECT * EXCLUDE (earlier) FROM (SELECT *, lag(severity, 1, 'normal') OVER (PARTITION BY gun ORDER BY win) AS earlier FROM severe) WHERE (severity = 'critical' AND earlier <> 'critical') OR (fired = 1 AND repeat = 0)",
    "epis": """SELECT gun, class, code, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS slots, min(ttf_s) AS end_ttf FROM
  (SELECT *, sum(c) OVER (PARTITION BY gun ORDER BY slot ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, CASE WHEN code = lag(code) OVER (PARTITION BY gun ORDER BY slot) THEN 0 ELSE 1 END AS c FROM shaped))
  WHERE code <> '0' GROUP BY gun, class, code, e""",
    "holes": "SELECT gun, class, count(*) AS gap FROM island WHERE present = 0 GROUP BY gun, class, island",
    "files": """SELECT g.gun, g.class, CAST(sum(present) AS BIGINT) AS rows, count(*) AS grid_rows, avg(CASE WHEN nw AND present = 1 THEN 1.0 WHEN present = 1 THEN 0 WHEN nw IS NULL AND present = 0 THEN 0 END) AS nw_share, count(DISTINCT code) AS codes,
  arg_max(code, slot) AS last_code, max(buys) AS buys, count(DISTINCT k) AS k_nunique, any_value(h.gaps) AS gaps, any_value(h.longest_gap) AS longest_gap, 1 - sum(present) / count(*) AS missing, count(*) * 600 / 3600.0::DOUBLE AS hours,
  CASE WHEN 1 - sum(present) / count(*) > 0.75 THEN 1 ELSE 0 END AS dropped
  FROM grid g LEFT JOIN (SELECT gun, count(*) AS gaps, max(gap) AS longest_gap FROM holes GROUP BY gun) h USING (gun) GROUP BY g.gun, g.class""",
    "sides": "SELECT *, CASE WHEN label = 1 THEN 1 ELSE 0 END AS pos FROM scored WHERE label = 1 OR error_active = 0",
}


def sql(last: str) -> str:
    body = ",\n".join(f"{name} AS ({query})" for name, query in STAGES.items())
    return f"WITH RECURSIVE {body}\n{last}"


def auroc(rows: str, by: str = "") -> str:
    """Mid-rank form, written otherwise than the counted one that Spark runs."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    same = f"PARTITION BY {by}, score" if by else "PARTITION BY score"
    return f"""SELECT {lead}CASE WHEN sum(pos) > 0 AND sum(1 - pos) > 0 THEN (sum(CASE WHEN pos = 1 THEN r END) - sum(pos) * (sum(pos) + 1) / 2.0::DOUBLE) / (sum(pos)::DOUBLE * sum(1 - pos)) END AS auroc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(1 - pos) AS BIGINT) AS negatives
  FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({same}) - 1) / 2.0::DOUBLE AS r FROM {rows}) {group}"""
