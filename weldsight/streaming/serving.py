"""Online scoring: every machine's recent readings as keyed state, trailing windows, a warm-up that ends in own statistics.

A request is some readings of one machine. Of its readings of one slot the last arrival alone counts, and neither buffers
nor limits count the others. Spark deals requests by machine and keeps the state in its state store; what happens to one
machine's buffer of at most ``Card.buffer`` readings is a few array operations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weldsight.config import TERMINAL_CODES, Profile
from weldsight.operators.models import Forest

WARMING, OWN, OVERALL = "warming_up", "gun", "global"
TOP = 8
#: Readings of a machine after which those that do not count are dropped; results that go out together.
PACKED, ANSWERS = 100_000, 500

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _fields(text: str) -> list[T.StructField]:
    """Plain columns; workers have no session that could read DDL."""
    return [T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))]


_FOUND = T.StructType(_fields("feature string, statistic string, value double, reference double, contribution double, share double"))
RESULT = T.StructType([
    *_fields("gun string, request long, status string, message string, n_samples int, samples_needed int, history int, window_start long, window_end long, windows_scored int"),
    *_fields("anomaly_score double, threshold double, gun_threshold double, gun_norm string, score_z double, is_anomaly boolean, alarm_held boolean, sustained_alarm boolean"),
    *_fields("consecutive_alarms int, alarm_duration_s int, sustained_in_request boolean, rule_triggered boolean, rule_repeat boolean, rule_code string, rule_trigger_time long"),
    *_fields("severity string, severity_source string, critical_in_request boolean, hands_off boolean, latest_code string, error_active_share double, non_welding_share double"),
    T.StructField("activity", T.MapType(T.StringType(), T.DoubleType())), T.StructField("contributions", T.ArrayType(_FOUND)),
])
STATUS = T.StructType(_fields("n_samples int, first_time long, last_time long, consecutive_alarms int, last_score double, gun_norm string, gun_threshold double, warmup_rows long"))


@dataclass(frozen=True)
class Card:
    """What serving needs of a fitted bundle; all of it has a size that does not grow with the data.

    ``held`` columns keep their last welding value while a machine does not weld; ``counters`` maps a cumulative column
    to the names of its increase and of the increase over ``profile.rolling_slots`` (or None); ``duty`` is (name, column,
    limit) of the share of rows above the limit, ``share`` the name of the share of error states. ``welding`` is (column,
    low, high): at or below low, or above high where there is one, a machine does not weld.
    """

    profile: Profile
    inputs: tuple[str, ...]
    held: tuple[str, ...]
    counters: dict[str, tuple[str, str | None]]
    duty: tuple[str, str, float]
    share: str
    welding: tuple[str, float, float | None]
    scaler: dict[str, tuple[float, float]]
    centred: tuple[str, ...]
    forest: Forest
    threshold: float
    reference: np.ndarray
    score_mean: float = 0.0
    score_std: float = 1.0
    mode: str | None = "center"
    buffer: int = 1800
    codes: tuple[str, ...] = tuple(TERMINAL_CODES)

    @property
    def sensors(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.held, *self.counters, self.welding[0]]))

    @property
    def columns(self) -> list[str]:
        return [f"{c}_mean" for c in self.inputs] + [f"{c}_std" for c in self.inputs]

    @property
    def longest(self) -> int:
        """Slots of a request at most: what the buffer holds beside the history of the rolling columns."""
        return self.buffer - self.profile.rolling_slots


@dataclass
class Series:
    """The newest unbroken stretch of a buffer: slots, inputs by name, codes, and the rows that do not weld."""

    at: np.ndarray
    values: dict[str, np.ndarray]
    code: np.ndarray
    idle: np.ndarray


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    end = np.arange(1, len(x) + 1)
    return total[end] - total[np.maximum(end - n, 0)]


def shape(card: Card, t: np.ndarray, sensors: np.ndarray, code: np.ndarray, carried: np.ndarray | None) -> tuple[Series | None, np.ndarray | None]:
    """(series, held columns of the newest welding row) of a buffer in the order of arrival.

    Of readings of one slot the last arrival counts. Gaps up to ``gap_slots`` keep the reading before them, a longer one
    ends a stretch. Idle rows take the last welding row, be it one that has left the buffer (``carried``); before any,
    the first that follows. Without any the series is None.
    """
    p = card.profile
    order = np.argsort(t, kind="stable")
    last = np.append(np.diff(t[order]) > 0, True)
    rows = order[last]
    t, sensors, code = t[rows], sensors[rows], code[rows]
    gap = np.diff(t) - 1
    breaks = np.flatnonzero(gap > p.gap_slots)
    first = int(breaks[-1]) + 1 if len(breaks) else 0
    t, sensors, code = t[first:], sensors[first:], code[first:]
    copies = np.append(np.diff(t), 1)
    rows = np.repeat(np.arange(len(t)), copies)
    at = np.arange(int(t[0]), int(t[-1]) + 1)
    x = {c: sensors[rows, i] for i, c in enumerate(card.sensors)}
    column, low, high = card.welding
    idle = x[column] <= low
    if high is not None:
        idle = idle | (x[column] > high)
    welding = np.flatnonzero(~idle)
    if not len(welding) and carried is None:
        return None, None
    source = np.maximum.accumulate(np.where(idle, -1, np.arange(len(at))))
    fallback = carried if carried is not None else np.array([x[c][welding[0]] for c in card.held])
    for i, c in enumerate(card.held):
        x[c] = np.where(source >= 0, x[c][source], fallback[i])
    newest = np.array([x[c][-1] for c in card.held])
    for c, (delta, rolled) in card.counters.items():
        x[delta] = np.maximum(np.diff(x[c], prepend=x[c][0]), 0.0)
        if rolled:
            x[rolled] = _rolled(x[delta], p.rolling_slots)
    n = np.minimum(np.arange(1, len(at) + 1), p.rolling_slots)
    name, column, limit = card.duty
    x[name] = _rolled(x[column] > limit, p.rolling_slots) / n
    codes = code[rows]
    x[card.share] = _rolled(codes != "0", p.rolling_slots) / n
    minute = at * p.slot_s // 60 % 1440
    angle = 2 * np.pi * minute / 1440
    x |= {"hour_sin": np.sin(angle), "hour_cos": np.cos(angle)}
    values = {c: (x[c] - card.scaler[c][0]) / card.scaler[c][1] if c in card.scaler else x[c] for c in card.inputs}
    return Series(at, values, codes, idle), newest


def window_ends(at: np.ndarray, window: int, after: int | None) -> list[int]:
    """Places of the last rows of the windows to score, the newest row and every ``window`` rows back from it, as far as
    whole windows end after slot ``after``. If there are none, the newest alone."""
    ends = np.arange(len(at) - 1, window - 2, -window)
    if after is not None and after >= at[0]:
        ends = ends[at[ends] > after]
    return ends[::-1].tolist() or [len(at) - 1]


def _window(values: np.ndarray, end: int, window: int) -> np.ndarray:
    part = values[max(0, end + 1 - window) : end + 1]
    return np.concatenate([part.mean(0), part.std(0, ddof=1) if len(part) > 1 else np.zeros(part.shape[1])])


def own_statistics(card: Card, rows: np.ndarray, at: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float | None] | None:
    """(mean, deviation, threshold) from the rows of a warm-up, of which ``plain`` are normal and welding.

    The threshold comes from clock-aligned windows of all rows within their stretches, scaled by the statistics; None
    where there are too few of those. Without enough plain rows there are no statistics.
    """
    p = card.profile
    if int(plain.sum()) < p.warmup_rows:
        return None
    columns = [card.inputs.index(c) for c in card.centred]
    used = rows[plain][:, columns]
    mean = used.mean(0)
    spread = np.maximum(used.std(0), p.std_floor) if card.mode == "scale" else np.ones(len(columns))
    scaled = rows.copy()
    scaled[:, columns] = (scaled[:, columns] - mean) / spread
    stretch = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
    keys = stretch.astype(np.int64) * (1 << 40) + (at // p.window_slots - at[0] // p.window_slots)
    windows = [scaled[keys == k] for k in np.unique(keys)]
    windows = [w for w in windows if len(w) >= p.min_samples]
    if len(windows) < p.warmup_windows:
        return mean, spread, None
    scores = card.forest.score(np.stack([_window(w, len(w) - 1, p.window_slots) for w in windows]))
    return mean, spread, max(card.threshold, float(np.quantile(scores, p.quantile)))


@dataclass
class Memory:
    """What is kept of a machine beside its readings and the rows of its warm-up; plain values, so that JSON holds it."""

    since: int | None = None
    last_end: int | None = None
    consecutive: int = 0
    last_score: float | None = None
    seen: int | None = None
    code: str = "0"
    fired_at: int | None = None
    fired: dict | None = None
    carried: list | None = None
    norm: str = WARMING
    start: int | None = None
    warmed: int | None = None
    warmup_rows: int = 0
    mean: list | None = None
    spread: list | None = None
    own_from: int | None = None
    own_threshold: float | None = None
    critical: bool = False


def _rule(card: Card, m: Memory, s: Series) -> tuple[int, str, bool] | None:
    """The first trigger (slot, code, repeat) among rows not seen before: a terminal code begins, and the last trigger is
    at least the cooldown ago. It is a repeat where the same code fired within the time for that."""
    p = card.profile
    new = s.at > m.seen if m.seen is not None else np.ones(len(s.at), bool)
    if not new.any():
        return None
    codes, at, found = s.code[new], s.at[new], None
    before = np.concatenate([[m.code], codes[:-1]])
    m.fired = m.fired or {}
    for i in np.flatnonzero(np.isin(codes, card.codes) & (codes != before)):
        now, code = int(at[i]), str(codes[i])
        if m.fired_at is None or (now - m.fired_at) * p.slot_s >= p.cooldown_s:
            repeat = code in m.fired and (now - m.fired[code]) * p.slot_s < p.repeat_s
            m.fired_at = m.fired[code] = now
            found = found or (now, code, repeat)
    m.seen, m.code = int(at[-1]), str(codes[-1])
    return found


def _contributions(card: Card, x: np.ndarray) -> list[dict]:
    """The inputs whose place taken by their reference lowers the score most, with shares of what lowers it."""
    rows = np.repeat(x[None, :], len(x) + 1, axis=0)
    rows[np.arange(1, len(x) + 1), np.arange(len(x))] = card.reference
    score = card.forest.score(rows)
    gain = score[0] - score[1:]
    total = float(gain[gain > 0].sum()) or 1.0
    names = card.columns
    order = sorted(range(len(x)), key=lambda i: (-round(float(gain[i]), 12), names[i]))[:TOP]
    return [{"feature": names[i], "statistic": names[i].rpartition("_")[2], "value": float(x[i]), "reference": float(card.reference[i]), "contribution": float(gain[i]), "share": max(0.0, float(gain[i])) / total} for i in order]


def serve(card: Card, m: Memory, readings: list[tuple], warm: list[tuple]) -> tuple[dict, list[tuple]]:
    """(result, rows to add to the warm-up) of one request; ``readings`` is the buffer with it, ``warm`` the rows so far.

    ``m`` changes to what holds after the request. Until a window is full the result is ``warming_up``.
    """
    p = card.profile
    t = np.array([r[0] for r in readings], np.int64)
    sensors = np.array([r[1] for r in readings], float).reshape(len(readings), -1)
    s, carried = shape(card, t, sensors, np.array([r[2] for r in readings], object), None if m.carried is None else np.array(m.carried))
    rule = None
    if s is not None:
        m.carried = carried.tolist()
        rule = _rule(card, m, s)
    have = 0 if s is None else len(s.at)
    if have < p.window_slots:
        why = "no welding row yet, whose values idle ones would keep" if s is None else f"{have} of {p.window_slots} samples in a row"
        return {"status": WARMING, "message": why, "n_samples": have, "samples_needed": p.window_slots}, []

    values = np.column_stack([s.values[c] for c in card.inputs])
    added: list[tuple] = []
    if card.mode is None:
        m.norm = OVERALL
    elif m.norm == WARMING:
        m.start = int(s.at[0]) if m.start is None else m.start
        end = m.start + p.warmup_s // p.slot_s
        new = (s.at < end) & (s.at > (m.warmed if m.warmed is not None else s.at[0] - 1))
        plain = ~s.idle & (s.code == "0")
        added = [(int(a), bool(b), v) for a, b, v in zip(s.at[new], plain[new], values[new].tolist(), strict=True)]
        if added:
            m.warmed, m.warmup_rows = added[-1][0], m.warmup_rows + len(added)
        if s.at[-1] >= end:
            rows = [*warm, *added]
            fixed = own_statistics(card, np.array([r[2] for r in rows], float), np.array([r[0] for r in rows]), np.array([r[1] for r in rows], bool)) if rows else None
            m.norm = OWN if fixed else OVERALL
            if fixed:
                m.mean, m.spread, m.own_threshold, m.own_from = fixed[0].tolist(), fixed[1].tolist(), fixed[2], end
    if m.norm == OWN:
        after = s.at >= m.own_from
        columns = [card.inputs.index(c) for c in card.centred]
        values[np.ix_(after, columns)] = (values[np.ix_(after, columns)] - m.mean) / m.spread

    ends = window_ends(s.at, p.window_slots, m.last_end)
    fresh = m.last_end is None or s.at[ends[-1]] > m.last_end
    if m.last_end is None or m.last_end < s.at[0]:
        m.since, m.consecutive = None, 0  # a run does not go over a gap
    rows = np.stack([_window(values, e, p.window_slots) for e in ends])
    any_sustained = False
    for e, score in zip(ends, card.forest.score(rows), strict=True):
        begin = max(0, e + 1 - p.window_slots)
        first, last = int(s.at[begin]), int(s.at[e])
        limit = m.own_threshold if m.norm == OWN and m.own_threshold is not None and first >= m.own_from else card.threshold
        idle = float(s.idle[begin : e + 1].mean())
        over, held = bool(score > limit), idle > p.gate
        alarm = over and not held
        if fresh:
            m.consecutive = m.consecutive + 1 if alarm else 0
            m.since = (first if m.since is None else m.since) if alarm else None
            m.last_end = last
        lasted = (last - m.since + 1) * p.slot_s if alarm and m.since is not None else 0
        sustained = lasted >= p.sustain * p.window_slots * p.slot_s
        any_sustained |= sustained
    m.last_score = float(score)
    by_rule = rule is not None and not rule[2]
    critical = any_sustained or by_rule
    hands_off = by_rule or (critical and not m.critical)
    m.critical = critical
    part = slice(begin, e + 1)
    raw = {c: s.values[c] * card.scaler.get(c, (0.0, 1.0))[1] + card.scaler.get(c, (0.0, 1.0))[0] for c in card.inputs}
    activity = {}
    for delta, rolled in card.counters.values():
        activity |= {delta: float(raw[delta][part].sum())} if delta in raw else {}
        activity |= {rolled: float(raw[rolled][e])} if rolled in raw else {}
    activity |= {card.duty[0]: float(raw[card.duty[0]][e])} if card.duty[0] in raw else {}
    return {
        "status": "ok", "n_samples": e + 1 - begin, "samples_needed": p.window_slots, "history": have, "window_start": first, "window_end": last, "windows_scored": len(ends),
        "anomaly_score": float(score), "threshold": limit, "gun_threshold": m.own_threshold, "gun_norm": m.norm, "score_z": (float(score) - card.score_mean) / card.score_std,
        "is_anomaly": over, "alarm_held": held, "sustained_alarm": sustained, "consecutive_alarms": m.consecutive, "alarm_duration_s": lasted, "sustained_in_request": any_sustained,
        "rule_triggered": rule is not None, "rule_repeat": rule is not None and rule[2], "rule_code": rule[1] if rule else None, "rule_trigger_time": rule[0] if rule else None,
        "severity": "critical" if sustained or by_rule else "warning" if alarm or rule else "normal",
        "severity_source": "model+rule" if sustained and by_rule else "model" if sustained else "rule" if by_rule else "none",
        "critical_in_request": critical, "hands_off": hands_off, "latest_code": str(s.code[e]), "error_active_share": float((s.code[part] != "0").mean()), "non_welding_share": idle,
        "activity": activity, "contributions": _contributions(card, rows[-1]),
    }, added


def _answers(rows: list[dict]) -> pd.DataFrame:
    names = RESULT.fieldNames()
    return pd.DataFrame([{c: r.get(c) for c in names} for r in rows], columns=names).astype(object)


class Inbox:
    """A machine's readings of a micro-batch, in any order, by request: flat arrays of 36 bytes and 8 for each sensor a
    reading. Readings of one arrival are ordered by ``tie``, where there is one. Of a request's readings of one slot the last arrival stays, which alone counts. Of a request of more than
    ``longest`` slots only the number of readings stays, as it is refused whole."""

    def __init__(self, longest: int):
        self.longest = longest
        self.counts: dict[int, int] = {}
        self.resets: set[int] = set()
        self.refused: set[int] = set()
        self.codes: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows, self.most = 0, PACKED

    def add(self, chunk: pd.DataFrame) -> None:
        chunk = chunk[chunk["request"].notna()]
        if not len(chunk):
            return
        request = chunk["request"].to_numpy().astype(np.int64)
        for name, n in zip(*(x.tolist() for x in np.unique(request, return_counts=True)), strict=True):
            self.counts[name] = self.counts.get(name, 0) + n
        self.resets.update(request[(chunk["control"] == "reset").to_numpy()].tolist())
        code = np.array([self.codes.setdefault(c, len(self.codes)) for c in chunk["code"]], np.int32)
        sensors = np.array([list(x) for x in chunk["sensors"]], float).reshape(len(chunk), -1)
        tie = chunk["tie"].to_numpy() if "tie" in chunk else np.zeros(len(chunk), np.int64)
        self.parts.append((request, chunk["arrival"].to_numpy(), tie, chunk["t"].to_numpy(), code, sensors))
        self.rows += len(chunk)
        if self.rows > self.most:
            self._pack()
            self.most = max(PACKED, 2 * self.rows)

    def _pack(self) -> None:
        held = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        request, arrival, tie, t = held[:4]
        order = np.lexsort((tie, arrival, t, request))
        rows = order[np.append((np.diff(request[order]) != 0) | (np.diff(t[order]) != 0), True)] if len(order) else order
        names, slots = np.unique(request[rows], return_counts=True)
        self.refused.update(names[slots > self.longest].tolist())
        rows = rows[~np.isin(request[rows], np.array(list(self.refused), np.int64))]
        self.parts = [tuple(x[rows] for x in held)]
        self.rows = len(rows)

    def requests(self) -> Iterator[tuple[int, int, bool, list[tuple]]]:
        """(request, its number of readings, whether it resets, readings in the order of arrival) by request; resets and
        requests to be refused without readings."""
        if not self.parts:
            return
        self._pack()
        request, arrival, tie, t, code, sensors = self.parts[0]
        order = np.lexsort((tie, arrival, request))
        names = sorted(self.counts)
        bounds = np.searchsorted(request, [[r, r + 1] for r in names], sorter=order).tolist()
        words = np.array(list(self.codes), object)
        for name, (a, b) in zip(names, bounds, strict=True):
            at = order[a:b] if name not in self.resets else order[:0]
            yield name, self.counts[name], name in self.resets, list(zip(t[at].astype(int).tolist(), sensors[at].tolist(), words[code[at]].tolist(), strict=True))


class Server(StatefulProcessor):
    """Keyed by gun: the buffer and the warm-up as lists, the rest as one value, and a status that can be read as a table.

    Rows: request, arrival, t, sensors (array), code, control and perhaps tie. Requests of a gun are served in the order of their
    numbers; a request of control ``reset`` clears the gun, one of more than ``card.longest`` slots is refused whole.
    """

    def __init__(self, card: Card):
        self.card = card

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = T.ArrayType(T.DoubleType())
        self.buffer = handle.getListState("buffer", T.StructType([*_fields("t long"), T.StructField("sensors", numbers), *_fields("code string")]))
        self.warm = handle.getListState("warm", T.StructType([*_fields("t long, plain boolean"), T.StructField("x", numbers)]))
        self.memory = handle.getValueState("memory", T.StructType(_fields("json string")))
        self.status = handle.getValueState("status", STATUS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        inbox = Inbox(self.card.longest)
        for chunk in rows:
            inbox.add(chunk)
        known = self.memory.exists()
        m = Memory(**json.loads(self.memory.get()[0])) if known else Memory()
        buffer = [(int(r[0]), list(r[1]), r[2]) for r in self.buffer.get()] if known else []
        warm, added = None, []
        out = []
        for request, n, resets, readings in inbox.requests():
            if len(out) == ANSWERS:
                yield _answers(out)
                out = []
            head = {"gun": key[0], "request": request}
            if resets:
                out.append(head | ({"status": "reset"} if known else {"status": "unknown", "message": "no such gun"}))
                known, m, buffer, warm, added = False, Memory(), [], [], []
                for state in (self.buffer, self.warm, self.memory, self.status):
                    state.clear()
                continue
            if request in inbox.refused:
                out.append(head | {"status": "rejected", "message": f"{n} readings, {self.card.longest} slots at most", "n_samples": n})
                continue
            known = True
            buffer = [*buffer, *readings][-self.card.buffer :]
            if warm is None:  # read only while it is needed
                warm = [(int(r[0]), bool(r[1]), list(r[2])) for r in self.warm.get()] if m.norm == WARMING and self.warm.exists() else []
            result, new = serve(self.card, m, buffer, [*warm, *added])
            added += new
            out.append(head | result)
        if known:
            self.buffer.put([tuple(r) for r in buffer])
            if m.norm != WARMING:
                self.warm.clear()
            elif added:
                self.warm.appendList([tuple(r) for r in added])
            self.memory.update((json.dumps(m.__dict__),))
            t = [r[0] for r in buffer]
            self.status.update((len(buffer), min(t), max(t), m.consecutive, m.last_score, m.norm, m.own_threshold, m.warmup_rows))
        yield _answers(out)

    def close(self) -> None:
        pass


def requests(rows: DataFrame, card: Card) -> DataFrame:
    """gun, request, arrival, t, sensors, code, control from readings with the card's sensor columns, and tie where they
    have it; a control event has a gun, a request and a control alone."""
    sensors = F.array(*[F.col(c).cast("double") for c in card.sensors])
    tie = [F.col("tie").cast("long").alias("tie")] if "tie" in rows.columns else []
    return rows.select(F.col("gun").cast("string").alias("gun"), F.col("request").cast("long").alias("request"), F.col("arrival").cast("long").alias("arrival"), F.col("t").cast("long").alias("t"), sensors.alias("sensors"), F.coalesce("code", F.lit("0")).alias("code"), F.coalesce("control", F.lit("")).alias("control"), *tie)


def scored_stream(stream: DataFrame, card: Card) -> DataFrame:
    """A row of RESULT for each request of a stream that ``requests`` made; needs the RocksDB state store."""
    return stream.groupBy("gun").transformWithStateInPandas(Server(card), outputStructType=RESULT, outputMode="Append", timeMode="None")


def status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Status of every gun that a stream keeps, read from its state."""
    rows = spark.read.format("statestore").option("stateVarName", "status").load(checkpoint)
    return rows.select(F.col("key.gun").alias("gun"), "value.*")


def run(stream: DataFrame, card: Card, folder: str) -> DataFrame:
    """The results of a stream read to its end, which are written below ``folder``."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = scored_stream(stream, card).writeStream.format("parquet").option("path", f"{folder}/results").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(RESULT).parquet(f"{folder}/results")
