"""Exact answers on small series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weldsight.config import SCALED, Profile
from weldsight.operators import alarms, eda, evaluate, experiments, handoff, models, shape, windows
from weldsight.sources.files import parse_switch


def _grid(spark, present):
    rows = [(0, "E01", s, 0, s, float(s), s % 3, "0", False, s) for s in present]
    return spark.createDataFrame(rows, "gun int, class string, slot long, event_id long, us long, value double, k int, code string, nw boolean, buys long")


def test_gaps_up_to_the_limit_are_filled_and_longer_ones_removed(spark):
    grid = shape.carry_code(shape.grid_align(shape.dedup_last(_grid(spark, [0, 1, 4, 8, 9]))))
    filled = shape.segments(shape.bounded_fill(grid, 2)).orderBy("slot").collect()
    assert [(r.slot, r.value, r.segment) for r in filled] == [(0, 0.0, 0), (1, 1.0, 0), (2, 1.0, 0), (3, 1.0, 0), (4, 4.0, 0), (8, 8.0, 1), (9, 9.0, 1)]


def test_the_grid_is_laid_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shape, "BLOCK", 4)
    for slots in ([-6, -1, 3, 4, 9], [5], [4, 7], [-8, -5]):
        got = [(r.slot, r.present) for r in shape.grid_align(_grid(spark, slots)).orderBy("slot").collect()]
        assert got == [(s, int(s in slots)) for s in range(slots[0], slots[-1] + 1)]


def test_last_arrival_wins(spark):
    rows = _grid(spark, [5]).unionByName(_grid(spark, [5]).withColumn("event_id", F.lit(9).cast("long")).withColumn("value", F.lit(7.0)))
    assert [r.value for r in shape.dedup_last(rows).collect()] == [7.0]


@pytest.mark.parametrize(("cooldown", "expected"), [(30, [1]), (1, [1, 4, 7]), (4, [1, 7])])
def test_cooldown(spark, cooldown, expected):
    flags = [0, 1, 1, 0, 1, 0, 0, 1]
    rows = spark.createDataFrame([(0, i, f, f, 60 * (8 - i)) for i, f in enumerate(flags)], "gun int, win long, terminal_any int, terminal_idx int, ttf_s long")
    assert sorted(r.win for r in alarms.cooled(alarms.onsets(rows), cooldown).collect()) == expected


@pytest.mark.parametrize(("hours", "expected"), [(24, []), (48, [2]), (61, [2, 5])])
def test_repeats(spark, hours, expected):
    fired = [(0, 0, 4, 100), (0, 2, 4, 60), (0, 4, 1, 40), (0, 5, 4, 0)]
    rows = spark.createDataFrame([(g, w, i, 3600 * t) for g, w, i, t in fired], "gun int, win long, terminal_idx int, ttf_s long")
    assert sorted(r.win for r in alarms.repeats(rows, 3600 * hours).filter("repeat = 1").collect()) == expected


def test_auroc_counts_ties_by_half_and_is_null_without_both_sides(spark):
    rows = spark.createDataFrame([(0.1, 0, 0), (0.5, 1, 0), (0.5, 0, 0), (0.9, 1, 0), (0.7, 0, 1)], "score double, label int, error_active int")
    assert evaluate.auroc(rows).first().auroc == pytest.approx((2 + 1.5) / 4)
    assert evaluate.auroc(rows.filter("label = 0")).first().auroc is None


def test_runs_need_neighbours(spark):
    rows = spark.createDataFrame([(0, w, a, 0.5, 10 * (9 - w)) for w, a in [(0, 1), (1, 1), (2, 0), (3, 1), (5, 1), (6, 1)]], "gun int, win long, alarm int, score double, ttf_s long")
    found = alarms.alarm_runs(rows, Profile(sustain=2)).orderBy("first_win").collect()
    assert [(r.first_win, r.last_win) for r in found] == [(0, 1), (5, 6)]


def test_window_of_one_row_has_no_deviation(spark):
    rows = spark.createDataFrame([(0, "E01", 0, 0, 2.0, 1, 0.0, 0, 0, 0, 0, 0, True, 5)], "gun int, class string, segment long, slot long, value double, k int, error_share double, error_active int, terminal_code int, terminal_any int, terminal_idx int, label int, nw boolean, ttf_s long")
    w = windows.window_stats(rows, SCALED).first()
    assert (w.value_std, w.n, w.non_welding) == (0.0, 1, 1.0)


def test_switch(spark):
    rows = spark.createDataFrame([(" On ",), ("FALSE",), ("1",), ("maybe",), (None,)], "c10 string")
    assert [r[0] for r in rows.select(parse_switch("c10")).collect()] == [True, False, True, None, None]


def test_pareto(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, 1.0, 5.0), (5, 1.0, 6.0)], "id int, a double, b double")
    assert sorted(r.id for r in experiments.pareto_front(rows, "id", ["a", "b"]).collect()) == [1, 2, 4]


def test_forest_finds_the_outlier(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(300)] + [(999, 100.0, -50.0)], "id int, a double, b double")
    scored = models.iforest_score(rows, ["a", "b"], models.iforest_fit(rows, ["a", "b"], trees=30, sample=64))
    assert scored.orderBy(F.desc("score")).first().id == 999


def test_document_without_symptom_but_with_a_rule(spark):
    events = spark.createDataFrame([(0, 1, 1, 0, "E012", "E012"), (0, 2, 1, 0, None, None), (0, 3, 0, 0, None, "E029")], "gun int, win long, fired int, repeat int, rule_code string, latest_code string")
    findings = spark.createDataFrame([(0, 1, 1, "c5", "low", -3.1, 0.6), (0, 1, 2, "c4", "high", 2.2, 0.3)], "gun int, win long, rank int, sensor string, direction string, deviation double, share double")
    docs = {r.win: r for r in handoff.documents(events, findings, handoff.symptom_match(findings, ["gun", "win"])).collect()}
    assert (docs[1].symptoms, docs[1].situations, docs[1].confidence) == ("P1", "S01", "medium")
    assert (docs[2].symptoms, docs[2].situations, docs[2].confidence) == ("P9", "S09", "low")
    assert (docs[3].fault, docs[3].basis) == ("E04", "latest_error_code")


def test_gap_lengths(spark):
    assert [r.gap for r in eda.gaps(shape.grid_align(_grid(spark, [0, 3, 4]))).collect()] == [2]


def test_decisions_do_not_depend_on_the_size_of_batches():
    from weldsight.streaming.alarms import Decider, batch_decisions

    rows = [(0, 60 * i, i, int(i % 7 < 4), "E029" if i % 50 in (10, 11) else "0") for i in range(300)]
    whole = batch_decisions(pd.DataFrame(rows, columns=["gun", "t", "event_id", "alarm", "code"]), 60, 180, 1800, 86_400, ("E029",))
    state, out = None, []
    for at in range(0, 300, 7):
        d = Decider(60, 180, 1800, 86_400, state)
        out += [x for _, t, _, a, c in rows[at : at + 7] if (x := d.feed(t, a, c, c == "E029"))]
        state = d.state()
    assert out == [tuple(r)[1:] for r in whole.itertuples(index=False)]
    assert whole["fired"].sum() == 6 and whole["repeat"].sum() == 5


def test_streams_read_folders_of_part_files(spark, tmp_path):
    from weldsight.config import SCALED, TERMINAL_CODES
    from weldsight.plans.queries import decision_input, stream_decisions, stream_tumbling
    from weldsight.streaming.alarms import batch_decisions

    one = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{one}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = {}
    for query in (stream_tumbling, stream_decisions):
        rows[query] = sorted(map(tuple, query(spark, one).collect()))
        assert rows[query] and sorted(map(tuple, query(spark, str(tmp_path)).collect())) == rows[query]
    frame = decision_input(events).toPandas()
    want = [batch_decisions(own, 21_600, 43_200, SCALED.cooldown_s, SCALED.repeat_s, tuple(TERMINAL_CODES)) for _, own in frame.groupby("gun")]
    assert rows[stream_decisions] == sorted(tuple(r) for f in want for r in f.itertuples(index=False))


def test_shuffled_micro_batches_decide_as_sorted_readings(spark, tmp_path):
    import random

    from weldsight.streaming.alarms import OnlineDecisions, batch_decisions

    names = ["gun", "t", "event_id", "alarm", "code"]
    rows = [(g, 60 * i, 1000 * g + i, int((i + g) % 7 < 4), "E029" if i % 50 in (10, 11) else "0") for g in range(3) for i in range(200)]
    rows += [(g, t, e + 500, 1 - a, "E029") for g, t, e, a, _ in rows[::23]]  # a later reading of the same second
    rows += rows[::17]
    r = random.Random(5)
    rows.sort(key=lambda x: x[1] + r.uniform(0, 1700))
    for n, at in enumerate(range(0, len(rows), 120)):
        spark.createDataFrame(rows[at : at + 120], "gun int, t long, event_id long, alarm int, code string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    sink = OnlineDecisions(f"{tmp_path}/out", 60, 180, 1800, 86_400, ("E029",))
    for n in range(6):
        sink(spark.read.parquet(f"{tmp_path}/in/{n}"), n)
        if n == 3:  # a retry writes the same
            sink(spark.read.parquet(f"{tmp_path}/in/{n}"), n)
    before = sink.decided(spark).count()
    sink.finish(spark)
    got = sorted(map(tuple, sink.decided(spark).collect()))
    frame = pd.DataFrame(rows, columns=names)
    want = [batch_decisions(own, 60, 180, 1800, 86_400, ("E029",)) for _, own in frame.groupby("gun")]
    assert len(rows) == 664 and got == sorted(tuple(x) for f in want for x in f.itertuples(index=False))
    assert before < len(got) == 600
    sink._decide(spark, spark.createDataFrame([(0, 0, 9999, 1, "E029")], "gun int, t long, event_id long, alarm int, code string"), 7, 0)
    assert sink.decided(spark).count() == 600


def test_a_forest_is_small_when_it_is_sent(spark):
    import pickle



    r = np.random.default_rng(4)
    names = [f"x{i}" for i in range(46)]
    rows = spark.createDataFrame(pd.DataFrame(r.normal(size=(1500, 46)), columns=names).assign(id=range(1500)))
    grown = models.collected(models.iforest_fit(rows, names, key=["id"]))
    sent = pickle.dumps(grown)
    x = r.normal(size=(50, 46))
    assert len(grown.roots) == 300 and len(sent) < 1_000_000 and np.array_equal(pickle.loads(sent).score(x), grown.score(x))


def test_pca_leaves_what_a_decomposition_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(200, 4)) + [5, -3, 100, 0]
    x[0] += [0, 4, 0, -4]
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(i=range(200)))
    got = models.pca_score(rows, names, *models.pca_fit(rows, names, 2)).orderBy("i").toPandas()
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    assert np.allclose(got.score, np.linalg.norm(centred - centred @ axes.T @ axes, axis=1), atol=1e-5) and got.score.idxmax() == 0


def test_boosted_trees_find_what_the_label_follows(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"]).assign(i=range(400))
    frame["y"] = ((frame.b > 0.3) ^ (frame.a > 1.5)).astype(int)
    rows = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    scored, gains = models.gbt_bound(rows.filter("i < 300"), ["a", "b", "c"], "y")
    again, _ = models.gbt_bound(rows.filter("i < 300"), ["a", "b", "c"], "y")
    got = scored.orderBy("i").toPandas()
    assert len(got) == 300 and abs(sum(gains.values()) - 1) < 1e-9 and gains["b"] > gains["a"] > gains["c"]
    assert ((got.score > 0.5) == (got.y == 1)).mean() > 0.95 and np.allclose(got.score, again.orderBy("i").toPandas().score)
