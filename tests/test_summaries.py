"""Summaries, folds, bands and variants against their SQL; readers; what folds leave out."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weldsight.config import SCALED as P
from weldsight.operators import eda, handoff, summaries
from weldsight.sources import files

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["file_report", "class_report", "episode_report", "last_code_by_class", "codes_at_the_end", "hourly_ttf_profile", "gap_report", "fold_metrics", "auroc_bands", "class_filters", "held_share", "rule_summary", "feature_scale", "unscaled_context", "maintenance_history", "history_48", "score_matrix_transposed", "list_add", "outbox_of_gun", "model_card"])
def test_equal_to_sql(spark, name):
    from weldsight.registry import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("events", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    key = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(ours).equals(key(theirs))


def test_gaps_of_series_without_any(spark, tmp_path):
    from weldsight.registry import ORACLES, QUERIES

    db = duckdb.connect()
    db.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_seconds(event_id % 3 * 600) AS ts) FROM read_parquet('{DATA}/events.parquet')) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    ours, theirs = QUERIES["gap_report"](spark, str(tmp_path)).toPandas(), db.execute(ORACLES["gap_report"]).df()
    assert [(r["class"], r.n) for _, r in ours.iterrows()] == [(r["class"], r.n) for _, r in theirs.iterrows()] == [("all", 0)]
    assert ours.drop(columns=["class", "n"]).isna().all(axis=None) and theirs.drop(columns=["class", "n"]).isna().all(axis=None)


def test_folds_without_both_sides_take_no_part(spark):
    rows = [(g, g % 2, w, float(w) / 10 + g, int(w == 9 and g < 2), 0, 0.0) for g in range(4) for w in range(10)]
    scored = spark.createDataFrame(rows, "gun int, fold int, win int, score double, label int, error_active int, non_welding double")
    folds = scored.select("gun", F.when(F.col("gun") < 2, F.col("fold")).otherwise(F.col("fold") + 2).alias("fold")).distinct()
    got = {(r.fold, r.metric): r.value for r in summaries.fold_metrics(scored.drop("fold"), folds, 4, P).collect()}
    assert got["0", "auroc"] == got["1", "auroc"] == got["mean", "auroc"] == 1.0 and got["sd", "auroc"] == 0.0
    assert got["2", "auroc"] is None and got["3", "recall_pre_failure"] is None and got["3", "auprc"] is None
    quiet = np.array([w / 10 + g for g in range(4) for w in range(10) if g != 3 and not (w == 9 and g < 2)])
    assert got["3", "alarm_rate_normal"] == np.mean([w / 10 + 3 > np.quantile(quiet, P.quantile) for w in range(10)])


def test_bands_classes_and_history(spark):
    rows = [(t * 1440, 1, 0, 1.0, c) for t, c in ((0, "E01"), (10, "E02"), (11, "E02"), (60, None))] + [(200_000, 0, 0, 0.5, "E01"), (100_000, 0, 0, 9.0, "E01"), (300_000, 0, 1, 9.0, "E01")]
    scored = spark.createDataFrame(rows, "ttf_s int, label int, error_active int, score double, class string")
    got = {r.band: (r.positives, r.negatives, r.auroc) for r in summaries.auroc_bands(scored, P).collect()}
    assert got == {"0-10": (2, 1, 1.0), "10-15": (1, 1, 1.0), "10-30": (1, 1, 1.0), "30-60": (1, 1, 1.0), "10-60": (2, 1, 1.0)}
    assert (summaries.only_classes(scored, keep=("E02",)).count(), summaries.only_classes(scored, drop=("E02",)).count(), summaries.only_classes(scored).count()) == (2, 5, 7)
    lists = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0]), ("b", [])], "k string, x array<double>")
    assert sorted(summaries.list_add(lists, "k", "x").collect()) == [("a", 0, 4.0, 2), ("a", 1, 2.0, 1)]


def test_a_file_without_states_or_gaps(spark):
    grid = spark.createDataFrame([("g", None, s, 1, "0", 5.0 + s, True if s else None) for s in range(3)], "gun string, class string, slot long, present int, code string, value double, nw boolean")
    row = summaries.file_report(grid, grid.groupBy("gun").agg(F.lit(3).alias("n_raw_rows")), P, summaries.Spec({"idle": "nw"}, {"v": "value"}, ("value",))).first()
    assert (row.n_gaps, row.longest_gap, row.n_error_codes, row.top_code, row.last_code, row.last_codes, row.discarded) == (0, 0, 0, "", None, "", 0)
    assert (row.idle, row.v_total, row.nunique_value, row.missing_rate) == (pytest.approx(2 / 3), 2.0, 3, 0.0)


def test_outbox_looks_at_the_newest_only(spark):
    docs = spark.createDataFrame([(g, w, "sent" if w % 2 else "pending") for g in (1, 2) for w in range(10)], "gun int, win long, delivery string")
    assert [(r.gun, r.win) for r in handoff.outbox(docs, 3).collect()] == [(1, 9), (2, 9), (1, 8)]
    assert [r.win for r in handoff.outbox(docs, 9, gun=2, capacity=8).collect()] == [9, 8, 7, 6]
    assert [(r.gun, r.win) for r in handoff.outbox(docs, 2, delivery="pending").collect()] == [(1, 8), (2, 8)]


def test_requests_are_read_or_refused(spark, tmp_path):
    reading = {"time": "2024-01-01T00:00:00Z", "c1": 1.5, "c10": "on", "error": "0"}
    lines = [{"gun_id": "a", "readings": [reading, reading]}, {"gun_id": "", "readings": [reading]}, {"gun_id": "b", "readings": []}, {"gun_id": "c" * 65, "readings": [reading]}, {"gun_id": "d", "readings": [reading] * 1201}, {"readings": [reading]}, {"gun_id": "e", "readings": [reading] * 1200}]
    (tmp_path / "in.json").write_text("\n".join([*map(json.dumps, lines), "no json"]))
    read = files.read_requests(spark, str(tmp_path)).groupBy("gun_id").agg(F.count(F.lit(1)), F.max("arrival")).collect()
    assert sorted(map(tuple, read)) == [("a", 2, 1), ("e", 1200, 1199)]
    refused = sorted((r.gun_id or "", r.n_readings, r.problem.split()[0]) for r in files.refused_requests(spark, str(tmp_path)).collect())
    assert refused == [("", 0, "gun_id"), ("", 1, "gun_id"), ("", 1, "gun_id"), ("b", 0, "no"), ("c" * 65, 1, "gun_id"), ("d", 1201, "1201")]


def test_matrix_rows_and_folders(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(", ".join(str(10 * r + c) for c in range(3)) for r in range(5)) + "\n\n")
    rows = files.read_matrix(spark, str(tmp_path / "m.txt"), 1, 3)
    assert sorted((r.row, r.column, r.value) for r in rows.collect()) == [(r, c, 10.0 * r + c) for r in (1, 2) for c in range(3)]
    (tmp_path / "d" / "deep er").mkdir(parents=True)
    (tmp_path / "d" / "one.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "d" / "deep er" / "two.csv").write_text("b,extra,a\nz,9,3\nw,9,no\n")
    (tmp_path / "d" / "notes.txt").write_text("a,b\n7,q\n")
    rows = files.read_folder(spark, str(tmp_path / "d"), {"a": "int", "b": "string", "c": "double"})
    assert sorted(map(tuple, rows.collect()), key=str) == [("one.csv", 1, "x", None), ("one.csv", 2, "y", None), ("two.csv", 3, "z", None), ("two.csv", None, "w", None)]
    (tmp_path / "none").mkdir()
    assert files.read_folder(spark, str(tmp_path / "none"), {"a": "int"}).count() == 0


def test_correlations_of_many_columns(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=400)
    frame = pd.DataFrame({"g": r.choice(["p", "q"], 400), "a": x, "b": 1e9 + 3e3 * (x + r.normal(size=400)), "c": 222.3, "d": np.where(r.random(400) < 0.3, np.nan, r.random(400) - x)})
    frame["e"] = np.where(frame.g == "p", 7.1, frame.b)
    rows = spark.createDataFrame(frame).replace(float("nan"), None).repartition(5)
    for by in (None, "g"):
        for name, part in [(None, frame)] if by is None else list(frame.groupby("g")):
            got = {(t["a"], t["b"]): t["corr"] for t in eda.correlation_matrix(rows, list("abcde"), by).collect() if by is None or t[by] == name}
            want = part[list("abcde")].corr()
            assert len(got) == 15
            for (i, j), v in got.items():
                flat = "c" in (i, j) or (name == "p" and "e" in (i, j))
                assert v is None if flat else v == pytest.approx(want.loc[i, j], abs=1e-7)
    few = {(t["a"], t["b"]): t["corr"] for t in eda.correlations(rows, list("acd")).collect()}
    assert few["a", "c"] is None and few["a", "d"] == pytest.approx(frame.a.corr(frame.d))
