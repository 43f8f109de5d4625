"""Warm-up, thresholds and hand-off on planted series that tell a right rule from a near one."""

import numpy as np
import pandas as pd
import pytest

from weldsight.config import Profile
from weldsight.operators import alarms, experiments, handoff, normalise, windows

P = Profile(window_slots=6, warmup_s=120, warmup_rows=60, warmup_windows=10, quantile=0.9)
COLUMNS = "gun class segment slot value k error_share error_active terminal_code terminal_any terminal_idx label nw ttf_s".split()


def _series() -> pd.DataFrame:
    """Gun 0 starts between two window edges, welds around 5 and has error states and idle readings in its warm-up;
    gun 1 has too few normal welding readings there."""
    rows = []
    for gun, start, level in ((0, 3, 5.0), (1, 0, 2.0)):
        for i in range(240):
            idle = i % 10 == 9 or (gun == 1 and 30 <= i < 120)
            error = 24 <= i < 45
            value = 100.0 if idle else 9.0 if error else level + (i * 7 % 5) / 10
            rows.append((gun, "E01", 0, start + i, value, 1.0 + i % 2, 0.0, int(error), 0, 0, 0, 0, idle, 240 - i))
    return pd.DataFrame(rows, columns=COLUMNS)


def _scores(frame: pd.DataFrame) -> pd.Series:
    w = frame.groupby(frame["slot"] // 6).filter(lambda g: len(g) >= 3).groupby(lambda i: frame.loc[i, "slot"] // 6)
    far = (w["value"].mean().abs() + w["k"].mean().abs() + w["value"].std().fillna(0) + w["k"].std().fillna(0)) / 4
    return (1 - np.exp(-far)).round(9)


@pytest.fixture(scope="module")
def chain(spark):
    frame = _series()
    rows = spark.createDataFrame(frame, "gun int, class string, segment long, slot long, value double, k double, error_share double, error_active int, terminal_code int, terminal_any int, terminal_idx int, label int, nw boolean, ttf_s long")
    stats = normalise.warmup_stats(rows, P)

    def scored(warm):
        own = windows.filled_windows(windows.window_stats(normalise.recentre(rows, stats, warm=warm), P), P)
        return normalise.distance_score(normalise.mark_warmup(own, stats, P))

    return frame, rows, stats, scored(False), scored(True)


def test_statistics_come_from_normal_welding_readings(chain):
    frame, _, stats, _, _ = chain
    got = {r.gun: r for r in stats.collect()}
    for gun in (0, 1):
        own = frame[frame.gun == gun]
        ok = own[(own.slot < own.slot.min() + 120) & ~own.nw & (own.error_active == 0)]
        assert (got[gun].warm_n, got[gun].warm_end, got[gun].own) == (len(ok), own.slot.min() + 120, len(ok) >= 60)
        assert got[gun].value_gm == pytest.approx(ok.value.mean()) and got[gun].value_gs == pytest.approx(max(ok.value.std(ddof=0), 0.25))
    assert got[0].own and not got[1].own


def test_readings_are_scaled_one_by_one_after_the_warm_up(chain):
    frame, _, stats, scored, _ = chain
    g = {r.gun: r for r in stats.collect()}[0]
    own = frame[frame.gun == 0].reset_index(drop=True).copy()
    after = own.slot >= g.warm_end
    own.loc[after, "value"] -= g.value_gm
    own.loc[after, "k"] -= g.k_gm
    got = {r.win: r for r in scored.filter("gun = 0").collect()}
    for win, score in _scores(own).items():
        assert got[win].score == pytest.approx(score, abs=1e-8)
    assert (got[20].warmup, got[21].warmup) == (1, 0)  # slots 120 to 125 hold the end of the warm-up, 123
    alone = frame[frame.gun == 1].reset_index(drop=True)
    got = {r.win: r.score for r in scored.filter("gun = 1").collect()}
    assert all(got[w] == pytest.approx(s, abs=1e-8) for w, s in _scores(alone).items())


def test_own_threshold_comes_from_rescaled_warm_up_windows_and_holds_after_it(spark, chain):
    frame, _, stats, scored, calibration = chain
    g = {r.gun: r for r in stats.collect()}[0]
    own = frame[(frame.gun == 0) & (frame.slot < g.warm_end)].reset_index(drop=True).copy()
    own["value"], own["k"] = own["value"] - g.value_gm, own["k"] - g.k_gm
    want = float(np.quantile(_scores(own), 0.9))
    overall = spark.createDataFrame([(0.5,)], "threshold double")
    got = {r.gun: r for r in normalise.gun_threshold(scored, calibration, overall, P).collect()}
    assert got[0].windows == len(_scores(own)) and got[0].threshold == pytest.approx(want, abs=1e-8) and want > 0.5
    assert (got[1].windows, got[1].threshold) == (0, 0.5)
    plain = spark.createDataFrame([(0, 1, 0.6, 1, 0.0), (0, 2, 0.6, 0, 0.0), (0, 3, 0.8, 0, 0.0), (0, 4, 0.8, 0, 0.9)], "gun int, win long, score double, warmup int, non_welding double")
    own_limit = spark.createDataFrame([(0, 0.7, 0.5)], "gun int, threshold double, overall double")
    judged = sorted((r.win, r.threshold, r.alarm, r.held) for r in alarms.alarms(plain, own_limit, P).collect())
    assert judged == [(1, 0.5, 1, 0), (2, 0.7, 0, 0), (3, 0.7, 1, 0), (4, 0.7, 0, 1)]


def test_documents_at_rising_edges_and_new_triggers(spark):
    levels = ["critical", "critical", "warning", "critical", "critical", "critical"]
    fired = [0, 0, 1, 0, 1, 1]
    repeat = [0, 0, 1, 0, 0, 1]
    rows = spark.createDataFrame([(0, w, *x) for w, x in enumerate(zip(levels, fired, repeat))], "gun int, win long, severity string, fired int, repeat int")
    assert sorted(r.win for r in alarms.rising(rows).collect()) == [0, 3, 4]


def test_cusum_never_falls_below_zero(spark):
    xs = [0.2, 1.5, -3.0, 0.9, 2.0, -0.1, -9.0, 0.5, 0.7]
    v, want = 0.0, []
    for x in xs:
        v = max(0.0, v + x - 0.5)
        want.append(v)
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "gun int, win long, z double")
    got = [r.cusum for r in experiments.cusum(rows, "gun", "win", "z").orderBy("win").collect()]
    assert got == pytest.approx(want)


def test_drift_needs_a_window_without_welds(spark):
    found = spark.createDataFrame([(0, w, 1, "c3", "unstable", 3.0, 0.5) for w in range(4)] + [(0, 0, 2, "c6", "high", 3.0, 0.4)], "gun int, win long, rank int, sensor string, direction string, deviation double, share double")
    welds = spark.createDataFrame([(0, 0, 4), (0, 1, 0), (0, 2, None)], "gun int, win long, welds_in_window int")
    key = ["gun", "win"]
    assert sorted((r.win, r.symptom, r.match) for r in handoff.symptom_match(found, key, welds).collect()) == [(0, "P3", "partial"), (1, "P4", "full")]
    assert [(r.win, r.symptom) for r in handoff.symptom_match(found, key).collect()] == [(0, "P3")]
