"""Toxicity from a weighted lexicon that Aho-Corasick matches in folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import BATCH_ROWS, small_batches, table, trim, written

#: Letters of other scripts that look like Latin ones, digits and signs that stand for letters, and
#: harmless phrases around words of the lexicon.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pond scum", "sore loser board")

#: Labelled documents that the lexicon and the weights are fitted on, at most.
TRAIN_DOCS = 10_000
STEMS = range(4, 10)
FEATURES = 6

_LOOKS = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_FOREIGN = re.compile("[ıɡɑͰ-ӿ！-～]")
# only from the start of a run of letters, so that a long one is read once
_MIXED = re.compile(r"(?<![^\W_])[^\W_]*[0134578@$][\w@$]*")
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W_]+")


def _spelled(m: re.Match) -> str:
    core = m[0].rstrip("@$")
    if not _LETTER.search(core):
        return m[0]
    return "".join(SUBSTITUTES.get(c, c) for c in core) + m[0][len(core) :]


def fold(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, digits inside words as letters, and one space around each word."""
    text = text.lower()
    if _FOREIGN.search(text):
        text = text.translate(_LOOKS).lower()
    return f" {_GAP.sub(' ', _MIXED.sub(_spelled, text)).strip()} "


@dataclass
class Lexicon:
    """Weights by entry: `` stem`` matches words that begin so, `` word `` the word alone; the longest counts.

    A phrase of several words has no weight and spares every word inside it.
    """

    weights: dict[str, float]
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight, " " in entry.strip()))
        found.make_automaton()
        return found

    def features(self, text: str, automaton: ahocorasick.Automaton) -> list[float]:
        folded = fold(text)
        at: dict[int, tuple[int, float]] = {}
        spared: set[int] = set()
        for end, (length, weight, phrase) in automaton.iter(folded) if len(automaton) else ():
            start = end - length
            if phrase:
                spared.update(start + i for i in range(length - 1) if folded[start + 1 + i] == " ")
            elif length > at.get(start, (0, 0.0))[0]:
                at[start] = (length, weight)
        hits = [w for start, (_, w) in at.items() if w > 0 and start not in spared]
        words = max(1, folded.count(" ") - 1)
        total, most = sum(hits), max(hits, default=0.0)
        return [math.log1p(total), total / math.sqrt(words), math.log1p(100 * total / words), most, float(len(hits) > 0), math.log1p(words)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[1:] + self.coefficients[0], -35, 35)))


def _held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _stems(text: str) -> set[str]:
    out = set()
    for word in set(fold(text).split()):
        if len(word) >= 3:
            out.add(f" {word} ")
            out.update(f" {word[:k]}" for k in STEMS if k <= len(word))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(_stems(text))
    keys = list(toxic | clean)
    columns = [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic", "clean"])


def _phrases(text: str, lexicon: Lexicon, automaton: ahocorasick.Automaton) -> set[str]:
    """Pairs of neighbouring words of which one is a hit."""
    folded = fold(text)
    out = set()
    for end, (length, weight, _) in automaton.iter(folded):
        if weight > 0:
            start = end - length + 1
            stop = folded.find(" ", start + 1)
            before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
            if before >= 0:
                out.add(folded[before : stop + 1])
            if after > stop:
                out.add(folded[start : after + 1])
    return out


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon with weights and a calibration, from at most ``train_docs`` labelled documents that are not held out.

    Labels that are null or have no document are left out; of repeated labels the largest counts. The lexicon comes
    from grouped counts over two thirds of the rows and the calibration from the other third, so that chance entries
    do not count for more than they are worth. Pairs of words around a hit that clean documents have and toxic ones
    hardly join the given exception phrases. Of repeated documents the largest text counts. Without labels of both kinds the lexicon is empty and scores are the
    share of toxic labels.
    """
    spark = docs.sparkSession
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    own = own.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = own.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(train_docs)
    ids = chosen.select(F.col("doc_id"), F.col("toxic"), (F.pmod(F.col("_h"), F.lit(3)) == 0).alias("calibrate")).collect()
    if not ids:
        return Lexicon({}, np.concatenate([[-35.0], np.zeros(FEATURES)]))
    picked = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int, calibrate boolean"))  # train_docs rows at most
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id")
    source = source.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"), F.max("calibrate").alias("calibrate"))

    counts = source.filter("not calibrate").select("text", "toxic").mapInArrow(_count, "entry string, toxic long, clean long")
    n_toxic = max(1, sum(r.toxic for r in ids if not r.calibrate))
    n_clean = max(1, sum(1 - r.toxic for r in ids if not r.calibrate))
    summed = counts.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    strength = (F.col("t") * n_clean - F.col("c") * n_toxic) / F.sqrt((F.col("t") + F.col("c") + 1) * F.lit(float(n_toxic)) * n_clean)
    whole = F.col("entry").endswith(" ")
    kept = summed.withColumn("z", strength).filter(((F.col("t") >= 3) & (F.col("z") >= 2.5)) | (whole & (F.col("c") >= 3) & (F.col("t") + F.col("c") >= 4)))
    strong = kept.filter("t >= 3 and z >= 2.5").collect()
    weights = {r.entry: w for r in strong if (w := _log_odds(r.t, r.c, n_toxic, n_clean)) > 0.7}
    heads = sorted({e[:5] for e in weights if not e.endswith(" ")})
    if heads:
        innocent = kept.filter(whole & F.substring("entry", 1, 5).isin(heads)).filter("z < 2.5").collect()
        weights |= {r.entry: 0.0 for r in innocent if _log_odds(r.t, r.c, n_toxic, n_clean) < 0.7}
    lexicon = Lexicon(weights)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, toxic, clean = lexicon.automaton(), Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (toxic if label else clean).update(_phrases(text, lexicon, automaton))
        keys = list(toxic | clean)
        columns = [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic", "clean"])

    learned = []
    if weights:
        pairs = source.filter("not calibrate").select("text", "toxic").mapInArrow(around, "entry string, toxic long, clean long")
        learned = pairs.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter("c >= 3").collect()
    spared = [r.entry for r in learned if _log_odds(r.t, r.c, n_toxic, n_clean) < 0]
    lexicon.weights |= dict.fromkeys([*spared, *(f" {' '.join(fold(p).split())} " for p in exceptions)], 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            rows = [lexicon.features(t, automaton) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = source.filter("calibrate").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").collect()
    y = np.array([r.toxic for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(rows) else n_toxic / (n_toxic + n_clean), 1e-6, 1 - 1e-6))
        return Lexicon({}, np.concatenate([[math.log(share / (1 - share))], np.zeros(FEATURES)]))
    x = np.array([r.x for r in rows])
    lexicon.centre, lexicon.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    lexicon.coefficients = _logistic((x - lexicon.centre) / lexicon.scale, y)
    return lexicon


def _scored(texts: pa.Array, lexicon: Lexicon, automaton: ahocorasick.Automaton) -> np.ndarray:
    return lexicon.scores(np.array([lexicon.features(t.as_py() or "", automaton) for t in texts]).reshape(len(texts), FEATURES))


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    Scores depend on the text alone, read whole. Null texts count as empty and get the score of a text without any
    hit; repeated rows get equal scores; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            score = _scored(b.column("text"), lexicon, automaton)
            columns = [b.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under 0.5, written in the shared folder at once;
    only texts go to Python and back comes one number a row."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for texts in batches:
            parts = [_scored(texts.slice(at, 500), lexicon, automaton) for at in range(0, len(texts), 500)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        trim()

    with small_batches(docs.sparkSession, BATCH_ROWS):
        return written(docs.filter(score("text") < 0.5), "not_toxic")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", "predicted")
