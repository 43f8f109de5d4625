"""The batch chain from readings to scored and alarmed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.config import SCALED, Profile
from weldsight.operators import alarms, features, models, normalise, shape, windows
from weldsight.sources.events import sensor_view

ATTRIBUTED = list(normalise.SCORED_COLUMNS)


#: Windows, statistics and thresholds that several queries of a session read: few rows, kept for the folder read last.
_KEPT: dict[tuple, DataFrame] = {}


def _written(spark: SparkSession, path: str) -> tuple:
    """When the files at a path were written and how long they are: a folder that is rewritten is another one."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    return tuple(sorted((f.getModificationTime(), f.getLen()) for f in files.listStatus(at)))


class Chain:
    """Stages as lazy frames; each is asked for by name."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: Profile = SCALED):
        self.p = profile
        self.sensor = sensor_view(spark, sf_dir, profile)
        self.spark = spark
        self.key = (spark.sparkContext.applicationId, sf_dir, profile, _written(spark, f"{sf_dir}/events.parquet"))

    def grid(self) -> DataFrame:
        return shape.carry_code(shape.grid_align(shape.dedup_last(self.sensor)))

    def rows(self) -> DataFrame:
        return features.featured(shape.shaped(self.sensor, self.p), self.p)

    def scaled(self) -> DataFrame:
        """Readings scaled over all machines."""
        rows = self.rows()
        return normalise.zscore(rows, normalise.scaler_fit(rows))

    def gun_stats(self) -> DataFrame:
        return self._kept("gun_stats", lambda: normalise.warmup_stats(self.scaled(), self.p))

    def _windowed(self, rows: DataFrame) -> DataFrame:
        return windows.filled_windows(windows.window_stats(rows, self.p), self.p)

    def windows(self) -> DataFrame:
        return self._kept("windows", lambda: self._windowed(self.scaled()))

    def recentred(self, mode: str = "center", warm: bool = False) -> DataFrame:
        return normalise.mark_warmup(self._windowed(normalise.recentre(self.scaled(), self.gun_stats(), mode, warm)), self.gun_stats(), self.p)

    def scored(self) -> DataFrame:
        return self._kept("scored", lambda: normalise.distance_score(self.recentred()))

    def calibration(self) -> DataFrame:
        return normalise.distance_score(self.recentred(warm=True))

    def _kept(self, name: str, build) -> DataFrame:
        for old in [k for k in _KEPT if k[1:] != self.key]:  # one folder at a time
            _KEPT.pop(old).unpersist()
        if (name, *self.key) not in _KEPT:
            _KEPT[name, *self.key] = build().persist()
        return _KEPT[name, *self.key]

    #: Inputs of the forest: all window features.
    FOREST = [f"{c}_{s}" for s in ("mean", "std") for c in windows.FEATURES]

    def forest(self) -> models.Forest:
        """Grown on normal windows, each drawn by its gun and number."""
        return models.collected(models.iforest_fit(normalise.normal(self.scored()), self.FOREST, key=["gun", "win"]))

    def forest_alarmed(self) -> DataFrame:
        """Windows that the forest scores, judged as by the distance: own thresholds after the warm-up."""
        grown = self.forest()
        scored, calibration = (models.iforest_score(w.drop("score"), self.FOREST, grown).withColumn("score", F.round("score", 9)) for w in (self.scored(), self.recentred(warm=True)))
        return alarms.alarms(scored, normalise.gun_threshold(scored, calibration, normalise.global_threshold(scored, self.p.quantile), self.p), self.p)

    def thresholds(self, scored: DataFrame) -> DataFrame:
        return self._kept("thresholds", lambda: normalise.gun_threshold(scored, self.calibration(), normalise.global_threshold(scored, self.p.quantile), self.p))

    def alarmed(self) -> DataFrame:
        s = self.scored()
        return alarms.alarms(s, self.thresholds(s), self.p)

    def severities(self) -> DataFrame:
        a = self.alarmed()
        return alarms.severity(a, alarms.triggers(self.windows(), self.p), self.p)

