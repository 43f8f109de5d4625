"""The wide path on synthetic machines with planted gaps, states and a block without welding."""

import dataclasses
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from weldsight.config import REAL
from weldsight.plans import exploration, machine

PROFILE = dataclasses.replace(REAL, label_s=600)


N = 7200
#: Fixed values of the fixture: each column's kind and numbers. "normal" takes mean and deviation, "chance" a probability,
#: "pressed" a probability of a normal value and 0 else, "counter" the probability of a step, "switch" that of on.
COLUMNS = {
    "c1": ("normal", 2, 0.5), "c2": ("pressed", 0.3, 2400, 50), "c3": ("normal", 140, 2), "c4": ("chance", 0.3), "c5": ("normal", 480, 3), "c6": ("normal", -65, 3), "c7": ("constant", 222.3),
    "c8": ("constant", 4309), "c9": ("constant", 132), "c10": ("switch", 0.9), "c11": ("counter", 0.3), "c12": ("counter", 0.5), "c13": ("constant", 14.99), "c14": ("constant", 2200),
    "c15": ("constant", 150), "c16": ("constant", 1.6), "c17": ("constant", 1), "c18": ("chance", 0.3), "c19": ("normal", 1.02e9, 5e4),
}
#: Fixed values of what is planted, by second: a ramp of c5 up to a height, blocks without welding, states, missing readings.
RAMP, IDLE, STATE, TERMINAL = (6600, 40.0), (1530, 1800), (3000, 3300), 6900
MISSING = [(100, 102), (500, 501), (2400, 2490)]


def _column(i, kind, *numbers):
    """A column of its kind, from a seed of its own."""
    at, chance, bell = F.col("id"), lambda p: (F.rand(i) < p).cast("int"), lambda mean, sd: mean + sd * F.randn(1000 + i)
    if kind == "counter":
        return F.sum(chance(numbers[0])).over(Window.orderBy(at))
    made = {"normal": bell, "chance": chance, "constant": F.lit, "pressed": lambda p, *n: F.when(F.rand(i) < p, bell(*n)).otherwise(0.0), "switch": lambda p: F.when(F.rand(i) < p, "on").otherwise("off")}
    return made[kind](*numbers)


def synthetic(folder, name, code, seed):
    """One machine's two hours up to its failure, with the state code of its class at the end."""
    spark, at = SparkSession.active(), F.col("id")
    rows = spark.range(0, N, 1, 1).select("id", *[_column(100 * seed + i, *kind).alias(c) for i, (c, kind) in enumerate(COLUMNS.items())])
    rows = rows.withColumn("c5", F.col("c5") + F.when(at >= RAMP[0], (at - RAMP[0]) / (N - RAMP[0]) * RAMP[1]).otherwise(0.0))
    rows = rows.withColumn("c16", F.when(at.between(IDLE[0], IDLE[1] - 1), 0.0).otherwise(F.col("c16")))
    rows = rows.withColumn("error", F.when(at >= TERMINAL, code).when(at.between(STATE[0], STATE[1] - 1), "E003").otherwise("0"))
    for a, b in MISSING:
        rows = rows.filter(~at.between(a, b - 1))
    frame = rows.withColumn("time", F.date_format(F.timestamp_seconds(at + 1704088800), "yyyy-MM-dd'T'HH:mm:ss'Z'")).toPandas().sort_values("id")
    os.makedirs(folder, exist_ok=True)
    frame[["time", *COLUMNS, "error"]].to_csv(f"{folder}/{name}.csv", index=False)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("machine")
    synthetic(root / "in", "E01_0", "E012", 1)
    synthetic(root / "in", "E04_1", "E029", 2)
    synthetic(root / "in_test", "test_0", "E029", 99)
    with open(root / "in" / "E02_2.csv", "w") as f:  # three readings in a thousand seconds
        head = ",".join(["time", *[f"c{i}" for i in range(1, 20)], "error"])
        f.write("\n".join([head, *[f"2024-01-01T06:{m}:00Z,{','.join(['1'] * 19)},0" for m in ("00", "05", "16")]]))
    machine.preprocess(spark, str(root / "in"), str(root / "out"), profile=PROFILE)
    machine.preprocess(spark, str(root / "in_test"), str(root / "out_test"), "test", scaler_from=str(root / "out"))
    return root


def test_series_of_a_machine(spark, made):
    rows = spark.read.parquet(f"{made}/out/series")
    df = rows.filter("file = 'E01_0'").toPandas()
    assert len(df) == 7200 - 90 and df.segment.nunique() == 2
    assert (df.nw.sum(), df.label.sum(), df.terminal_code.sum()) == (270, 601, 300)
    assert not {"c11", "c12"} & set(rows.columns) and {"welds_delta", "pos_delta", "welds_10min", "error_share_10min"} <= set(rows.columns)
    normal = rows.filter("label = 0 AND error_active = 0").toPandas()
    assert abs(normal.c5.mean()) < 0.2 and np.allclose(normal.c7, 0, atol=1e-6) and set(normal.c10) == {0, 1}
    assert dict(rows.dtypes)["c5"] == "float" and set(normal.file) == {"E01_0", "E04_1"}
    assert (df.welds_delta[df.slot == df.groupby("segment").slot.transform("min")].nunique()) == 1


def test_windows_of_a_machine(spark, made):
    rows = spark.read.parquet(f"{made}/out/series").withColumnRenamed("file", "gun")
    wins = machine.model_windows(rows, PROFILE).filter("gun = 'E01_0'").toPandas()
    assert wins.n.between(30, 60).all() and sorted(wins.non_welding[wins.non_welding > 0]) == [0.5, 1.0, 1.0, 1.0, 1.0]
    inputs = [c for c in wins.columns if c.endswith(("_mean", "_std"))]
    assert inputs == [f"{f}_mean" for f in machine.MODEL_FEATURES] + [f"{f}_std" for f in machine.MODEL_FEATURES]
    kept = machine.training(machine.model_windows(rows, PROFILE), True).toPandas()
    assert (kept.non_welding == 0).all() and (kept.label == 0).all() and (kept.error_active == 0).all()


def test_what_a_run_leaves(spark, made):
    files = {r["file"]: r for r in spark.read.option("header", True).csv(f"{made}/out/manifest.csv").collect()}
    assert files["E02_2"]["dropped"] == "missing readings" and files["E01_0"]["dropped"] is None and files["E01_0"]["rows"] == "7107"
    test = spark.read.option("header", True).csv(f"{made}/out_test/manifest.csv").first()
    assert (test["file"], test["class"], test["class_source"]) == ("test_0", "E04", "terminal code E029")
    assert os.path.exists(f"{made}/out/scaler.json") and not os.path.exists(f"{made}/out_test/scaler.json")
    assert spark.read.json(f"{made}/out_test/preprocess_config.json").first().label_s == 600
    assert spark.read.parquet(f"{made}/out_test/series").agg({"label": "sum"}).first()[0] == 601


def test_inputs_and_scale_modes(spark, made):
    assert len(machine.model_features()) == 23 and len(machine.model_features(drop_static=True, drop_clock=True)) == 18
    with pytest.raises(ValueError):
        machine.model_features(drop=("terminal_code",))
    rows = spark.read.parquet(f"{made}/out/unscaled")
    own = machine.scaled(rows, None, "per-file").filter("label = 0 AND error_active = 0").groupBy("gun").avg("c5").collect()
    assert len(own) == 2 and all(abs(r[1]) < 1e-9 for r in own)
    assert machine.scaled(rows, None, "none") is rows
    high = machine.non_welding(spark.createDataFrame([(0.0,), (1.6,), (9.0,), (None,)], "c16 double"), high=5.0)
    assert [r.nw for r in high.collect()] == [True, False, True, False]


def test_tables_of_the_files(spark, made):
    exploration.explore(spark, f"{made}/out", f"{made}/eda", PROFILE)
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{made}/eda/{name}")
    files = {r.gun: r for r in read("file_summary").collect()}
    one, few = files["E01_0"], files["E02_2"]
    assert len(one) >= 40 and (one.n_raw_rows, one.n_grid, one.n_gaps, one.longest_gap, one.gaps_over_1h, one.discarded) == (7107, 7200, 3, 90, 0, 0)
    assert (one.n_error_episodes, one.n_error_codes, one.last_code, one.last_code_end_s, one.last_code_duration_s, one.last_codes) == (2, 2, "E012", 0, 300, "E012")
    assert one.top_code == "E012" and one.missing_rate == pytest.approx(93 / 7200) and one.outlier_rate == pytest.approx(270 / 7107) and one.error_state_share == pytest.approx(600 / 7200)
    raw = pd.read_csv(f"{made}/in/E01_0.csv")
    assert one.welds_total == raw.c11.iloc[-1] - raw.c11.iloc[0] and one.welds_per_hour == pytest.approx(one.welds_total / (7199 / 3600)) and one.nunique_c1 == raw.c1.nunique() and one.nunique_c7 == 1
    assert (few.discarded, few.n_gaps, few.n_error_episodes, few.last_code, few.top_code) == (1, 2, 0, None, None)  # '' in a CSV is read as null
    classes = {r["class"]: r for r in read("class_summary").collect()}
    assert set(classes) == {"E01", "E02", "E04"} and classes["E02"].discarded == 1 and classes["E01"].outlier_rate == pytest.approx(one.outlier_rate)
    gaps = {r["class"]: r for r in read("gap_stats").collect()}
    assert (gaps["E01"].n, gaps["E01"].max, gaps["E01"].p50, gaps["all"].n) == (3, 90, 2, 8)
    near = {r["class"]: r for r in read("codes_in_last10min_by_class").collect()}
    assert (near["E01"].E012, near["E01"].E003, near["E04"].E029, near["E02"].E012) == (1, 0, 1, 0)
    last = {r["class"]: r for r in read("last_code_by_class").collect()}
    assert (last["E02"].none, last["E04"].E029, last["E01"].none) == (1, 1, 0)
    episodes = {(r["class"], r.code): r for r in read("error_code_stats_by_class").collect()}
    assert (episodes["E04", "E003"].episodes, episodes["E04", "E003"].median_duration_s, episodes["E04", "E029"].min_ttf_end_h) == (1, 300, 0)
    hours = read("hourly_ttf_profile_by_file").filter("gun = 'E01_0'").orderBy("ttf_h").collect()
    assert [(r.ttf_h, r.n) for r in hours] == [(0, 3600), (1, 3507)] and hours[0].c5_mean > hours[1].c5_mean + 2
    report = "\n".join(r.value for r in spark.read.text(f"{made}/eda/report.md").collect())
    assert "3 files, 14217 readings, 1 files discarded, 4 episodes" in report and read("target_correlations").count() == 18
