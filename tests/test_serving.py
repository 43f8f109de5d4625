"""The fitted bundle on synthetic machines, and online scoring of its streams against the batch result."""

import dataclasses
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_machine import synthetic
from weldsight.config import REAL
from weldsight.operators import evaluate
from weldsight.plans import bundle, machine
from weldsight.streaming import replay, serving

PROFILE = dataclasses.replace(REAL, label_s=600, warmup_s=1800)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundle")
    for i, (cls, code) in enumerate([("E01", "E012"), ("E02", "E016"), ("E03", "E028"), ("E04", "E029")]):
        synthetic(root / "in", f"{cls}_{i}", code, i + 1)
    synthetic(root / "in_test", "test_0", "E029", 99)
    machine.preprocess(spark, str(root / "in"), str(root / "out"), profile=PROFILE)
    machine.preprocess(spark, str(root / "in_test"), str(root / "out_test"), "test", PROFILE, scaler_from=str(root / "out"))
    fitted = bundle.train(spark, str(root / "out"), str(root / "models"), str(root / "out_test"), profile=PROFILE, trees=60)
    return root, fitted


@pytest.fixture(scope="module")
def raw(made):
    frame = pd.read_csv(made[0] / "in_test" / "test_0.csv", dtype={"error": str})
    frame["t"] = pd.to_datetime(frame["time"]).map(pd.Timestamp.timestamp).astype("int64")
    frame["c10"] = (frame["c10"] == "on").astype(float)
    return frame


def test_bundle(spark, made):
    root, fitted = made
    again = bundle.read_bundle(spark, f"{root}/models")
    assert dataclasses.asdict(again) | {"nodes": None} == dataclasses.asdict(fitted) | {"nodes": None} and again.nodes.equals(fitted.nodes)
    assert len(again.inputs) == 23 and len(again.columns) == 46 and len(again.reference) == 46 and "c7" in again.centred and "hour_sin" not in again.centred
    assert again.nodes.tree.nunique() == 60 and again.nodes[again.nodes.node == 0]["size"].max() <= 256
    report = spark.read.json(f"{root}/models/metrics.json").first()
    assert report.auroc > 0.5 and (report.rule_triggers, report.files_hit, report.rule_repeats) == (1, 1, 0) and 4 <= report.rule_lead_min_median <= 5
    scores = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/models/scores")
    assert set(scores.columns) == set(bundle.SCORE_COLUMNS)
    rows = scores.orderBy("window_start").toPandas()
    assert (rows.warmup.iloc[0], rows.warmup.iloc[-1]) == (1, 0) and np.allclose(rows.threshold[rows.warmup == 1], fitted.threshold) and (rows.threshold[rows.warmup == 0] >= fitted.threshold - 1e-9).all()
    card = {(r.part, r.name): r for r in bundle.model_card(spark, f"{root}/models").collect()}
    assert card["model", "trees"].value == 60 and card["model", "threshold"].value == fitted.threshold and card["model", "mode"].text == "center" and card["figure", "auroc"].value == report.auroc
    parts = [part for part, _ in card]
    assert (parts.count("input"), parts.count("dropped"), parts.count("scaler")) == (46, 1, 2 * len(fitted.scaler)) and ("dropped", "c19") in card and ("test_file", "test_0") in card and "train_file" in parts
    for wrong in ({"scale": "per-file"}, {"resample": "5s"}):
        bundle.write_bundle(spark, dataclasses.replace(fitted, **wrong), f"{root}/wrong")
        with pytest.raises(ValueError):
            bundle.read_bundle(spark, f"{root}/wrong")


def test_a_bundle_that_lacks_settings_gets_their_defaults(spark, made, tmp_path):
    root, fitted = made
    bundle.write_bundle(spark, fitted, str(tmp_path))
    settings = json.loads(spark.read.text(f"{tmp_path}/bundle.json").first()[0])
    for name in ("mode", "scale", "resample", "welding", "score_mean", "score_std"):
        settings.pop(name)
    settings["profile"].pop("gate")
    spark.createDataFrame([(json.dumps(settings),)], "value string").write.mode("overwrite").text(f"{tmp_path}/bundle.json")
    again = bundle.read_bundle(spark, str(tmp_path))
    assert (again.mode, again.score_std, again.welding, again.profile.gate, again.threshold) == (None, 1.0, (0.0, None), bundle.REAL.gate, fitted.threshold)
    assert {r.part for r in bundle.model_card(spark, str(tmp_path)).collect()} == {"model", "preprocess", "scaler", "input", "dropped"}


def test_class_comes_from_the_end_and_bad_readings_are_kept_apart(spark, tmp_path):
    n = 3700
    frame = pd.DataFrame({"time": pd.date_range("2024-01-01 06:00:00", periods=n, freq="s").strftime("%Y-%m-%dT%H:%M:%SZ")} | {f"c{i}": 1.0 for i in range(1, 20)} | {"error": ["E012"] * 5 + ["0"] * (n - 5)})
    frame["c10"] = "on"
    frame.to_csv(tmp_path / "quiet.csv", index=False)
    late = frame.copy()
    late.loc[n - 500, "error"], late.loc[7, "c11"], late.loc[8, "error"] = "E016", -1.0, "oops"
    late.to_csv(tmp_path / "late.csv", index=False)
    machine.preprocess(spark, str(tmp_path), str(tmp_path / "out"), profile=PROFILE)
    found = {r["file"]: (r["class"], r["class_source"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/out/manifest.csv").collect()}
    assert found == {"quiet": (None, None), "late": ("E02", "terminal code E016")}
    assert sorted((r.file, r.error) for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()) == [("late", "0"), ("late", "oops")]


def _send(spark, folder, card, parts):
    """Adds a file of the requests (gun, request, readings or control) to the stream's folder."""
    rows = []
    for gun, request, frame in parts:
        if isinstance(frame, str):
            rows.append((gun, request, 0, 0, *[0.0] * len(card.sensors), "0", frame))
            continue
        kept = frame.sample(frac=1, random_state=1) if gun == "G1" else frame  # in any order within a request
        rows += [(gun, request, i, int(r["t"]), *[float(r[c]) for c in card.sensors], r["error"], "") for i, (_, r) in enumerate(kept.iterrows())]
    names = ["gun", "request", "arrival", "t", *card.sensors, "code", "control"]
    spark.createDataFrame(pd.DataFrame(rows, columns=names), _kinds(card)).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _kinds(card):
    return "gun string, request long, arrival long, t long, " + ", ".join(f"{c} double" for c in card.sensors) + ", code string, control string"


def _served(spark, folder, card):
    """Serves what the folder has that was not served yet; all results so far."""
    source = spark.readStream.schema(_kinds(card)).parquet(f"{folder}/in")
    return {(r.gun, r.request): r for r in serving.run(serving.requests(source, card), card, str(folder)).collect()}


@pytest.fixture(scope="module")
def served(spark, made, raw, tmp_path_factory):
    card = made[1].card()
    flap = raw.iloc[:600].copy().reset_index(drop=True)
    flap.loc[[*range(150, 200), *range(250, 300)], "error"] = "E029"
    twice = raw.iloc[:2280].copy().reset_index(drop=True)
    twice.loc[[*range(150, 200), *range(2100, 2150)], "error"] = "E029"
    idle = raw.assign(c16=0.0)
    parts = [("G1", 1, raw.iloc[:30]), ("G1", 2, raw.iloc[30:1200]), ("G1", 3, raw.iloc[1200:2390]), ("G1", 4, raw.iloc[2300:2390]), ("G2", 1, raw.iloc[-1500:-750]), ("G2", 2, raw.iloc[-750:]), ("G3", 1, raw.iloc[1400:1700]), ("big", 1, raw.iloc[:1201])]
    parts += [("R1", i, flap.iloc[60 * i : 60 * i + 60]) for i in range(10)] + [("R2", i, twice.iloc[60 * i : 60 * i + 60]) for i in range(38)]
    parts += [("CD", 0, raw.iloc[:1200]), ("CD", 1, idle.iloc[1200:2390]), ("CD", 2, idle.iloc[2390:3590]), ("CD0", 0, idle.iloc[:120])]
    parts += [("RP", i, raw[(raw.t >= raw.t[0] + 300 * i) & (raw.t < raw.t[0] + 300 * i + 300)]) for i in range(24)]
    parts += [("gone", 0, raw.iloc[:100]), ("gone", 1, "reset"), ("gone", 2, "reset"), ("gone", 3, raw.iloc[100:130])]
    folder = tmp_path_factory.mktemp("served")
    _send(spark, folder, card, parts)
    return _served(spark, folder, card), folder


def _batch(spark, made):
    """The batch series, scaled by the machine's own statistics after its warm-up, and the judged windows."""
    rows = machine.read_series(spark, f"{made[0]}/out_test")
    from weldsight.operators import normalise

    fitted = made[1]
    stats = normalise.warmup_stats(rows, PROFILE, fitted.centred)
    own = normalise.recentre(rows, stats, "center", False, fitted.centred).orderBy("slot").toPandas().set_index("slot")
    return own, bundle.judged(rows, fitted).toPandas(), stats.first()


def test_trailing_windows_and_warm_up_are_those_of_the_batch_run(spark, made, served):
    rows, fitted = served[0], made[1]
    own, windows, stats = _batch(spark, made)

    def score(end):
        part = own.loc[end - 59 : end, list(fitted.inputs)].astype(float)
        return fitted.forest.score(np.concatenate([part.mean(), part.std()])[None, :])[0]

    first, warm, after, again = (rows["G1", i] for i in (1, 2, 3, 4))
    assert (first.status, first.n_samples, first.samples_needed) == ("warming_up", 30, 60)
    assert (warm.status, warm.n_samples, warm.gun_norm, warm.gun_threshold, warm.threshold) == ("ok", 60, "warming_up", None, fitted.threshold)
    assert warm.window_end - warm.window_start == 59 and len(warm.contributions) == 8 and warm.alarm_held is False
    assert warm.anomaly_score == pytest.approx(score(warm.window_end), abs=1e-3)
    assert (after.gun_norm, after.threshold) == ("gun", after.gun_threshold) and after.threshold >= fitted.threshold
    assert after.anomaly_score == pytest.approx(score(after.window_end), abs=1e-3) and stats.own
    assert after.gun_threshold == pytest.approx(windows[windows.warmup == 0].threshold.iloc[0], abs=2e-3)
    assert all(abs(c["value"]) < 1e-6 for c in after.contributions if c["feature"][:3] in ("c7_", "c8_", "c9_"))
    # what was sent before is scored again and changes nothing
    assert (again.window_end, again.windows_scored, again.consecutive_alarms) == (after.window_end, 1, after.consecutive_alarms)
    assert again.anomaly_score == pytest.approx(after.anomaly_score)


def test_requests_of_the_end_of_a_machine(served):
    rows = served[0]
    assert rows["G2", 1].rule_triggered is False
    last = rows["G2", 2]
    assert (last.windows_scored, last.rule_triggered, last.rule_code, last.latest_code, last.severity, last.critical_in_request, last.hands_off) == (13, True, "E029", "E029", "critical", True, True)
    assert last.severity_source in ("rule", "model+rule") and last.window_end - last.rule_trigger_time == 299
    held = rows["G3", 1]
    assert (held.non_welding_share, held.severity, held.consecutive_alarms, held.alarm_held) == (1.0, "normal", 0, True)
    assert rows["big", 1].status == "rejected"


def test_rule_fires_once_and_repeats_only_warn(served):
    rows = served[0]
    flap = [rows["R1", i] for i in range(10)]
    assert sum(bool(r.rule_triggered) for r in flap) == 1 and all(r.critical_in_request for r in flap if r.rule_triggered)
    fired = [r for i in range(38) if (r := rows["R2", i]).rule_triggered]
    assert [r.rule_repeat for r in fired] == [False, True] and fired[0].severity == "critical" and fired[0].hands_off
    if not fired[1].sustained_in_request:
        assert (fired[1].severity, fired[1].hands_off) == ("warning", False)


def test_values_are_carried_beyond_the_buffer(served):
    rows = served[0]
    assert (rows["CD", 2].status, rows["CD", 2].non_welding_share, rows["CD", 2].alarm_held is not None) == ("ok", 1.0, True)
    assert np.isfinite(rows["CD", 2].anomaly_score)
    assert rows["CD0", 0].status == "warming_up" and "no welding row" in rows["CD0", 0].message


def test_a_whole_file_in_requests(served):
    rows = [served[0]["RP", i] for i in range(24)]
    assert sum(bool(r.rule_triggered) for r in rows) == 1 and sum(r.windows_scored for r in rows) >= 100 and rows[-1].gun_norm == "gun"
    before = False
    for r in rows:
        assert r.hands_off == ((r.critical_in_request and not before) or (r.rule_triggered and not r.rule_repeat))
        before = r.critical_in_request


def test_a_file_is_replayed_in_waves(spark, made, served, tmp_path):
    card, readings = made[1].card(), spark.read.parquet(f"{made[0]}/out_test/readings")
    with pytest.raises(ValueError):
        replay.as_requests(readings, card, chunk_s=1201)
    answers = replay.play(readings, card, str(tmp_path / "state"), chunk_s=300, wave_s=3600)
    rows = {r.request: r for r in answers.collect()}
    assert set(rows) == set(range(25)) and rows[0].status == "unknown"  # nothing to reset yet
    for i in range(24):
        want = served[0]["RP", i]
        assert (rows[i + 1].status, rows[i + 1].window_end, rows[i + 1].windows_scored, rows[i + 1].rule_triggered, rows[i + 1].severity, rows[i + 1].hands_off) == (want.status, want.window_end, want.windows_scored, want.rule_triggered, want.severity, want.hands_off)
        assert rows[i + 1].anomaly_score == pytest.approx(want.anomaly_score, abs=1e-9)
    replay.write_answers(answers, str(tmp_path / "out"))
    one = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/summary").first()
    done = [rows[i] for i in range(1, 25)]
    assert (one.gun, one.requests, one.scored + one.not_ready, one.refused, one.triggers, one.repeats) == ("test_0", 24, 24, 0, 1, 0)
    assert (one.windows, one.events, one.last_severity) == (sum(r.windows_scored or 0 for r in done), sum(bool(r.hands_off) for r in done), done[-1].severity)
    assert one.top_score == pytest.approx(max(r.anomaly_score for r in done if r.anomaly_score is not None)) and one.first_critical == min(r.window_end for r in done if r.critical_in_request)
    kept = spark.read.json(f"{tmp_path}/out/responses")
    assert kept.count() == 25 and {"gun", "request", "severity", "contributions"} <= set(kept.columns)
    late = replay.as_requests(readings, card, 300, start_hours=1.5, reset=False).toPandas()
    assert late.request.min() == 19 and (late.control == "").all()


def test_reset_and_status(spark, served):
    rows, folder = served
    assert (rows["gone", 1].status, rows["gone", 2].status, rows["gone", 3].status, rows["gone", 3].n_samples) == ("reset", "unknown", "warming_up", 30)
    found = {r.gun: r for r in serving.status(spark, f"{folder}/checkpoint").collect()}
    assert "big" not in found and set(found) == {"G1", "G2", "G3", "R1", "R2", "CD", "CD0", "RP", "gone"}
    assert (found["G1"].gun_norm, found["RP"].gun_norm, found["gone"].n_samples, found["CD"].n_samples) == ("gun", "gun", 30, 1800)
    assert found["G1"].warmup_rows >= 1700 and found["G1"].gun_threshold == rows["G1", 3].gun_threshold


def test_sustained_alarm_is_a_matter_of_time(spark, made, raw, tmp_path):
    card = dataclasses.replace(made[1].card(), threshold=-1.0)
    _send(spark, tmp_path, card, [("S1", 0, raw.iloc[:1170]), *[("S2", i, raw.iloc[10 * i : 10 * i + 10]) for i in range(40)]])
    rows = _served(spark, tmp_path, card)
    one = rows["S1", 0]
    assert (one.windows_scored, one.consecutive_alarms, one.sustained_alarm, one.severity) == (19, 19, True, "critical") and one.alarm_duration_s >= 1100
    scored = [rows["S2", i] for i in range(40) if rows["S2", i].status == "ok"]
    first = next(r for r in scored if r.sustained_alarm)
    assert 179 <= first.window_end - scored[0].window_start < 190 and first.consecutive_alarms > 3


def test_micro_batches_give_what_one_gives(spark, made, raw, tmp_path):
    card = made[1].card()
    parts = [("A", i, raw.iloc[400 * i : 400 * i + 400]) for i in range(8)]
    _send(spark, tmp_path / "one", card, parts)
    for some in (parts[:3], parts[3:6], parts[6:]):
        _send(spark, tmp_path / "many", card, some)
        rows = _served(spark, tmp_path / "many", card)
    assert rows == _served(spark, tmp_path / "one", card) and len(rows) == 8 and rows["A", 7].gun_norm == "gun"


def test_quantiles_by_counted_ranges(spark, monkeypatch):
    r = np.random.default_rng(1)
    frame = pd.DataFrame({"a": r.normal(size=3001), "b": np.round(r.exponential(size=3001), 1), "c": 1.5, "d": np.where(r.random(3001) < 0.6, 7.0, r.random(3001) * 1e9), "e": np.nan})
    rows = spark.createDataFrame(frame).withColumn("e", F.lit(None).cast("double"))
    for few, bins in ((10_000, 4096), (5, 3)):
        monkeypatch.setattr(evaluate, "FEW", few)
        monkeypatch.setattr(evaluate, "BINS", bins)
        for q in (0.0, 0.3, 0.5, 0.99, 0.9997, 1.0):
            got = evaluate.quantiles(rows, list(frame.columns), q)
            assert got["e"] is None and all(got[c] == pytest.approx(np.quantile(frame[c], q), rel=1e-12) for c in "abcd")


@pytest.mark.parametrize("packed", [3, 100_000])
def test_only_the_number_of_a_refused_request_is_held(monkeypatch, packed):
    monkeypatch.setattr(serving, "PACKED", packed)
    r = np.random.default_rng(5)
    rows = pd.DataFrame({"request": np.append(np.repeat([4, 1, 2, 3], [40, 4, 3, 2]), [np.nan]), "arrival": range(50), "t": range(100, 150), "sensors": [np.array([i, np.nan]) for i in range(50)], "code": [f"E{i % 3}" for i in range(50)], "control": [""] * 48 + ["reset", ""]})
    rows = rows.iloc[r.permutation(50)].reset_index(drop=True)
    inbox = serving.Inbox(4)
    for at in range(0, 50, 5):
        inbox.add(rows.iloc[at : at + 5])
        assert inbox.rows <= max(packed, 2 * 9 + 5 + 2 * 4)
    got = list(inbox.requests())
    assert inbox.rows == 9 and [(a, n, reset, len(x)) for a, n, reset, x in got] == [(1, 4, False, 4), (2, 3, False, 3), (3, 2, True, 0), (4, 40, False, 0)]
    assert [(t, s[0], c) for t, s, c in got[0][3]] == [(140 + i, 40.0 + i, f"E{(40 + i) % 3}") for i in range(4)] and all(np.isnan(s[1]) for _, s, _ in got[0][3])
    assert list(serving.Inbox(4).requests()) == []


@pytest.mark.parametrize("packed", [3, 100_000])
def test_a_request_holds_the_last_reading_of_each_slot(monkeypatch, packed):
    monkeypatch.setattr(serving, "PACKED", packed)
    rows = pd.DataFrame({"request": [1] * 40 + [2] * 5, "arrival": range(45), "t": [100 + i % 4 for i in range(40)] + [110, 111, 112, 113, 114], "sensors": [np.array([float(i)]) for i in range(45)], "code": "0", "control": ""})
    rows = rows.sample(frac=1, random_state=3).reset_index(drop=True)
    inbox = serving.Inbox(4)
    for at in range(0, 45, 5):
        inbox.add(rows.iloc[at : at + 5])
    got = {request: (n, [(t, s[0]) for t, s, _ in readings]) for request, n, _, readings in inbox.requests()}
    assert got == {1: (40, [(100 + i, 36.0 + i) for i in range(4)]), 2: (5, [])} and inbox.refused == {2}
