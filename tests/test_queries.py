"""A few registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bounded_fill", "window_stats", "rule_triggers", "auroc", "auroc_by_class", "auprc", "global_threshold", "feature_reference", "ewma", "exp_smooth", "gap_stats", "symptom_match", "pareto_front", "front_distance", "hypervolume"])
def test_equal_to_sql(spark, name):
    from weldsight.registry import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("events", "supplier", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    key = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(ours).equals(key(theirs))


def test_forest_is_judged_by_its_own_thresholds(spark):
    import numpy as np

    from weldsight.config import SCALED as P
    from weldsight.plans.chain import Chain
    from weldsight.registry import QUERIES

    rows = QUERIES["forest_alarms"](spark, DATA).toPandas()
    states = Chain(spark, DATA).scored().select("gun", "win", "label", "error_active", "non_welding").toPandas()
    both = rows.merge(states, on=["gun", "win"])
    quiet = both[(both.label == 0) & (both.error_active == 0)]
    overall = np.quantile(quiet.score, P.quantile)
    assert len(both) == len(rows) > 100 and np.allclose(both.threshold[both.warmup == 1], overall) and (both.threshold >= overall - 1e-9).all()
    over = both.score > both.threshold
    assert ((both.alarm == 1) == (over & (both.non_welding <= P.gate))).all() and ((both.held == 1) == (over & (both.non_welding > P.gate))).all()


def test_triggers_are_scored_by_models_of_other_machines(spark):
    from weldsight.registry import QUERIES

    rows = QUERIES["trigger_scores"](spark, DATA).toPandas()
    fired = QUERIES["rule_triggers"](spark, DATA).toPandas()
    assert len(rows) == len(fired) > 10 and rows.score.between(0, 1).all() and rows.near.nunique() == 2


def test_online_scores_of_the_event_stream(spark):
    from weldsight.plans import queries
    from weldsight.streaming import serving

    got = {(r.gun, r.request): r for r in queries.stream_scores(spark, DATA).collect()}
    card = queries.serving_card(spark, DATA)
    frame = queries.serving_input(spark.read.parquet(f"{DATA}/events.parquet"), card).toPandas().sort_values(["gun", "request", "arrival"], kind="stable")
    assert len(got) == frame.groupby(["gun", "request"]).ngroups
    for gun, own in frame.groupby("gun"):
        m, buffer, warm = serving.Memory(), [], []
        for request, part in own.groupby("request"):
            buffer = [*buffer, *zip(part["t"], part["sensors"].map(list), part["code"])][-card.buffer :]
            want, added = serving.serve(card, m, buffer, warm)
            warm += added
            r = got[gun, request]
            assert (r.status, r.window_end, r.windows_scored, r.gun_norm, r.severity, r.hands_off) == tuple(want.get(c) for c in ("status", "window_end", "windows_scored", "gun_norm", "severity", "hands_off"))
            assert want.get("anomaly_score") is None or abs(r.score - want["anomaly_score"]) < 1e-5
    assert {r.gun_norm for r in got.values()} >= {"warming_up", "gun"} or {r.gun_norm for r in got.values()} >= {"warming_up", "global"}


@pytest.fixture(scope="module")
def card(spark):
    from weldsight.plans import queries

    return queries.serving_card(spark, DATA)


def _crowded(spark, target, crowds, late_us):
    """Writes the event table with so many further readings, ``late_us`` after each of machine 1's last events."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    mine = events.filter("user_id % 8 = 1").orderBy(F.desc("ts")).limit(len(crowds)).collect()
    for i, (n, e) in enumerate(zip(crowds, mine, strict=True)):
        ids = spark.range(1_000_000 * (i + 1), 1_000_000 * (i + 1) + n).withColumnRenamed("id", "event_id")
        more = ids.selectExpr("event_id", f"timestampadd(MICROSECOND, {late_us}, TIMESTAMP_NTZ'{e.ts}') AS ts", f"{e.user_id}L AS user_id", "'click' AS event_type", "CAST(event_id % 97 AS DOUBLE) AS value", """'{"k": 1}' AS props""")
        events = events.unionByName(more)
    events.repartition(3, F.rand(1)).write.parquet(f"{target}/events.parquet")


@pytest.mark.parametrize("name", ["replay_summary", "stream_scores"])
def test_requests_of_many_readings_lose_nothing(spark, card, tmp_path, monkeypatch, name):
    from weldsight.plans import queries

    monkeypatch.setattr(queries, "serving_card", lambda spark, sf_dir: card)
    _crowded(spark, tmp_path, [2_000, 1_700, 1_900, 1_500, 1_800], -1)  # before an event of the same slot they change nothing
    got, want = (queries.QUERIES[name](spark, d).toPandas() for d in (str(tmp_path), DATA))
    key = [c for c in ("gun", "request") if c in want]
    got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    assert got.equals(want) and (name == "stream_scores" or got.refused.sum() == 0)


def test_the_last_event_of_one_time_counts(spark, card):
    from weldsight.plans import queries
    from weldsight.streaming import serving

    made = spark.range(3_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:05:00' AS ts", "1L AS user_id", "'click' AS event_type", "CAST(id AS DOUBLE) AS value", """'{"k": 1}' AS props""")
    rows = queries.serving_input(made, card).toPandas().sample(frac=1, random_state=4)
    inbox = serving.Inbox(card.longest)
    for at in range(0, 3_000, 500):
        inbox.add(rows.iloc[at : at + 500])
    ((_, n, _, readings),) = inbox.requests()
    assert n == 3_000 and [s[card.sensors.index("value")] for _, s, _ in readings] == [2_999.0]


def test_a_rewritten_folder_gives_its_new_rows(spark, tmp_path):
    from weldsight.registry import QUERIES

    events = spark.read.parquet(f"{DATA}/events.parquet")
    counts = []
    for some in (events, events.filter("event_id % 3 = 0")):
        some.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        counts.append(QUERIES["window_stats"](spark, str(tmp_path)).count())
    assert counts[1] < counts[0]
