"""Online alarms and rules: one state per machine, updated by every micro-batch in time order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: how late a reading may come; it is the time that a machine's buffer holds.
WATERMARK = "30 minutes"
BUFFER_S = 1800

OUTPUT = "gun int, t bigint, alarm int, lasting int, sustained int, fired int, repeat int, severity string"
STATE = T.StructType([
    T.StructField("last", T.LongType()), T.StructField("since", T.LongType()), T.StructField("code", T.StringType()),
    T.StructField("fired_at", T.LongType()), T.StructField("codes", T.StringType()),
])
READING = ("gun", "t", "event_id", "alarm", "code")
KEPT = "state struct<last:bigint,since:bigint,code:string,fired_at:bigint,codes:string>"
_INT, _LONG, _TEXT = pa.int32(), pa.int64(), pa.string()
_OUT = pa.schema([("gun", _INT), ("t", _LONG), *[(c, _INT) for c in ("alarm", "lasting", "sustained", "fired", "repeat")], ("severity", _TEXT), ("state", pa.struct([("last", _LONG), ("since", _LONG), ("code", _TEXT), ("fired_at", _LONG), ("codes", _TEXT)]))])


class Decider:
    """The decisions for one machine; state is plain values, so that batches of any size give the same."""

    def __init__(self, step: int, sustain: int, cooldown: int, repeat: int, state: tuple | None = None):
        self.step, self.sustain, self.cooldown, self.repeat = step, sustain, cooldown, repeat
        self.last, self.since, self.code, self.fired_at, codes = state or (None, None, "0", None, "")
        self.codes = {c: int(t) for c, t in (x.split("=") for x in codes.split(";") if x)}

    def state(self) -> tuple:
        return self.last, self.since, self.code, self.fired_at, ";".join(f"{c}={t}" for c, t in sorted(self.codes.items()))

    def feed(self, t: int, alarm: int, code: str, terminal: bool) -> tuple | None:
        if self.last is not None and t <= self.last:
            return None  # a resend or a late reading never decides again
        if self.last is not None and t - self.last > self.step:
            self.since = None  # a run does not go over a gap
        self.since = (t if self.since is None else self.since) if alarm else None
        lasting = t - self.since + self.step if alarm else 0
        sustained = int(lasting >= self.sustain)
        fired = repeat = 0
        if terminal and code != self.code and (self.fired_at is None or t - self.fired_at >= self.cooldown):
            fired, repeat = 1, int(code in self.codes and t - self.codes[code] < self.repeat)
            self.fired_at = self.codes[code] = t
        self.last, self.code = t, code
        level = "critical" if sustained or (fired and not repeat) else "warning" if alarm or fired else "normal"
        return t, alarm, lasting, sustained, fired, repeat, level


def _feed(limits: tuple[int, int, int, int], terminal: tuple[str, ...]):
    """Rows by gun and time, each gun's state before them, to decisions and the gun's state after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gun, decider = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["gun"] != gun:
                    if decider is not None:
                        out.append((gun, *[None] * 7, dict(zip(STATE.fieldNames(), decider.state(), strict=True))))
                    gun, decider = row["gun"], Decider(*limits)
                if row["state"] is not None:
                    decider = Decider(*limits, tuple(row["state"][f] for f in STATE.fieldNames()))
                elif (d := decider.feed(row["t"], row["alarm"], row["code"], row["code"] in terminal)) is not None:
                    out.append((gun, *d, None))
            yield _batch(out)
        if decider is not None:
            yield _batch([(gun, *[None] * 7, dict(zip(STATE.fieldNames(), decider.state(), strict=True)))])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in rows], schema=_OUT)


class OnlineDecisions:
    """A foreachBatch sink of readings (gun, t, event_id, alarm, code) that keeps one state per gun between batches.

    Readings up to BUFFER_S older than the gun's newest wait in a buffer, and are decided in the order of time when a
    reading that much newer comes, or at ``finish``; what comes after later readings of its gun were decided is left
    out. Of readings of one time the largest event_id counts. Spark sorts a batch by gun and time, and the machine sees it
    Arrow batch by Arrow batch, so that no task holds a gun's readings. Each epoch writes its decisions, states and buffer
    below ``folder`` and reads those of the epoch before, so that a retry writes the same.
    """

    def __init__(self, folder: str, step: int, sustain: int, cooldown: int, repeat: int, terminal: tuple[str, ...]):
        self.folder, self.limits, self.terminal = folder, (step, sustain, cooldown, repeat), terminal
        self.last: int | None = None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self._decide(batch.sparkSession, batch.select(*READING), epoch, BUFFER_S)

    def finish(self, spark: SparkSession) -> None:
        """Decides what is still in the buffer, at the end of a stream."""
        if self.last is not None:
            self._decide(spark, None, self.last + 1, 0)

    def _decide(self, spark: SparkSession, rows: DataFrame | None, epoch: int, late: int) -> None:
        if epoch:
            waiting = spark.read.parquet(self._at("readings", epoch - 1)).filter("NOT ready").select(*READING)
            rows = waiting if rows is None else rows.unionByName(waiting)
        states = spark.read.schema(f"{OUTPUT}, {KEPT}").parquet(self._at("out", epoch - 1)).filter("state IS NOT NULL").select("gun", "state") if epoch else None
        last = F.max(F.struct(F.col("event_id").isNull().alias("none"), "event_id", "alarm", "code")).alias("_r")
        once = rows.groupBy("gun", "t").agg(last).select("gun", "t", "_r.event_id", "_r.alarm", "_r.code")
        newest = rows.groupBy("gun").agg(F.max("t").alias("newest"))
        once.join(newest, "gun").withColumn("ready", F.col("t") <= F.col("newest") - late).drop("newest").write.mode("overwrite").parquet(self._at("readings", epoch))
        fed = spark.read.parquet(self._at("readings", epoch)).filter("ready").select("gun", "t", "alarm", "code").withColumn("state", F.lit(None).cast(STATE))
        if states is not None:
            fed = fed.unionByName(states, allowMissingColumns=True)
        # a gun's state has no time and comes first
        ordered = fed.repartition("gun").sortWithinPartitions("gun", F.asc_nulls_first("t"))
        ordered.mapInArrow(_feed(self.limits, self.terminal), f"{OUTPUT}, {KEPT}").write.mode("overwrite").parquet(self._at("out", epoch))
        self.last = epoch

    def _at(self, what: str, epoch: int) -> str:
        return f"{self.folder}/{what}/epoch={epoch}"

    def decided(self, spark: SparkSession) -> DataFrame:
        """All decisions of a stream that wrote at least one epoch."""
        return spark.read.schema(f"{OUTPUT}, {KEPT}").parquet(f"{self.folder}/out").filter("state IS NULL").drop("state", "epoch")


def batch_decisions(readings: pd.DataFrame, step: int, sustain: int, cooldown: int, repeat: int, terminal: tuple[str, ...]) -> pd.DataFrame:
    """The same for one machine's readings at once."""
    decider = Decider(step, sustain, cooldown, repeat)
    rows = readings.sort_values(["t", "event_id"]).drop_duplicates("t", keep="last")
    out = [(int(g), *d) for g, t, a, c in zip(rows["gun"], rows["t"], rows["alarm"], rows["code"], strict=True) if (d := decider.feed(int(t), int(a), c, c in terminal))]
    return pd.DataFrame(out, columns=["gun", "t", "alarm", "lasting", "sustained", "fired", "repeat", "severity"])


def tumbling(stream: DataFrame, width: str, delay: str = WATERMARK) -> DataFrame:
    """Counts and means by type and clock-aligned window, with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def deliver_each(deliver: Callable[[dict], None], failed: list | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one attempt for each critical row; a failure is noted and never stops the stream. Critical
    rows are few by their cooldown, and come to the driver one at a time."""

    def sink(batch: DataFrame, epoch: int) -> None:
        for row in batch.filter("severity = 'critical'").toLocalIterator():
            try:
                deliver(row.asDict(recursive=True))
            except Exception as e:  # noqa: BLE001
                if failed is not None:
                    failed.append((epoch, row.asDict(recursive=True), str(e)))

    return sink
