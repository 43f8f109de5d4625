"""Exact duplicates by content sort."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import BATCH_ROWS, cut, partitions, small_batches, table, trim

HEAD = 64
SAMPLE_PER_RANGE = 60
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _keys(texts: pa.Array) -> list[bytes]:
    """Place of a text among the splitters: its first bytes, then a digest that spreads texts with a common head."""
    out = []
    for t in texts.cast(pa.binary()).to_pylist():
        out.append(t[:HEAD].ljust(HEAD, b"\0") + xxhash.xxh64_digest(t))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_keys(pc.ascii_lower(b.column(0))), pa.binary())], ["key"])


def _heads(texts: pa.Array) -> np.ndarray:
    """Where a text differs from the one before it."""
    new = np.ones(len(texts), bool)
    if len(texts) > 1:
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
    return new


def _collapse(splitters: list[bytes]):
    """Sorted rows of one input partition to one row for each run of equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.Array, list[pa.Array]] | None = None

        def emit(texts: pa.Array, ids: pa.Array, starts: np.ndarray) -> pa.RecordBatch:
            pids = [bisect.bisect_right(splitters, k) for k in _keys(texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), texts, lists], ["pid", "text", "ids"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0), b.column(1)
            starts = np.flatnonzero(_heads(texts))
            if held is not None and held[0][0].equals(texts[0]):
                end = int(starts[1]) if len(starts) > 1 else len(texts)
                held[1].append(ids.slice(0, end))
                if end == len(texts):
                    continue
                ids, texts, starts = ids.slice(end), texts.slice(end), starts[1:] - end
            if held is not None:
                yield emit(held[0], pa.concat_arrays(held[1]), np.zeros(1, np.int64))
            last = int(starts[-1])
            if last:
                yield emit(texts.take(pa.array(starts[:-1])), pa.concat_arrays([ids.slice(0, last)]), starts[:-1])
            held = (pa.array([texts[last].as_py()], texts.type), [ids.slice(last)])
        if held is not None:
            yield emit(held[0], pa.concat_arrays(held[1]), np.zeros(1, np.int64))
        trim()

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of one range: equal neighbours are one group, whose first row has the largest identifier."""
    before, digest, keep, groups = None, "", None, {}
    for b in batches:
        if not b.num_rows:
            continue
        pids, texts, ids, tops = b.column("pid").to_pylist(), b.column("text"), b.column("ids"), b.column("top").to_pylist()
        new = _heads(texts)
        new[0] = before is None or not before.equals(texts[0])
        gids, keeps, leads, shas = [], [], [], []
        for i, fresh in enumerate(new):
            if fresh:
                groups[pids[i]] = groups.get(pids[i], -1) + 1
                keep, digest = tops[i], hashlib.sha256(texts[i].as_buffer()).hexdigest()
            gids.append((pids[i] << 40) + groups[pids[i]])
            keeps.append(keep)
            leads.append(bool(fresh))
            shas.append(digest)
        before = pa.array([texts[len(texts) - 1].as_py()], texts.type)[0]
        arrays = [pa.array(gids, pa.int64()), ids, pa.array(keeps, pa.int64()), pa.array(leads), pa.array(shas)]
        yield pa.RecordBatch.from_arrays(arrays, ["gid", "ids", "keep_id", "lead", "text_sha256"])
    trim()


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts (after lower-casing A-Z only), one row for each input row.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Null texts count as empty, so null and empty texts are
    one group. Of equal texts the largest doc_id stays; of repeated rows with that doc_id exactly one. A null doc_id
    stays only where its group has no other. An empty table gives no rows; other columns are not read.

    Each input partition is sorted and its runs of equal texts become one row, so that a text with any number of
    copies comes to the shuffle at most once for each input partition. Sampled splitters then deal the runs into
    ranges of the normalised bytes, Spark's external sort puts equals side by side, and neighbours are compared whole.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted, rows = SAMPLE_PER_RANGE * n, docs.count()
    sample = source.select("text")
    if rows > wanted:
        sample = sample.sample(fraction=min(1.0, wanted / rows), seed=7)
    with small_batches(spark, BATCH_ROWS):
        keys = sorted(bytes(r[0]) for r in sample.mapInArrow(_sampled, "key binary").limit(4 * wanted).collect())
    splitters = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    order = [F.asc("text"), F.desc_nulls_last("doc_id")]
    local = source.withColumn("text", F.translate("text", _UPPER, _UPPER.lower())).sortWithinPartitions(*order)
    runs = local.mapInArrow(_collapse(splitters), "pid int, text string, ids array<bigint>").withColumn("top", F.col("ids")[0])
    ranged = runs.repartitionById(n, "pid").sortWithinPartitions(F.asc("text"), F.desc_nulls_last("top"))
    schema = "gid long, ids array<bigint>, keep_id long, lead boolean, text_sha256 string"
    with small_batches(spark, BATCH_ROWS):
        found = cut(ranged.mapInArrow(_neighbours, schema))

    parts = found.groupBy("gid").agg(F.sum(F.size("ids")).alias("_size"), F.count(F.lit(1)).alias("_runs"))
    several = parts.filter("_runs > 1").select("gid", "_size")
    sized = found.join(several, "gid", "left").withColumn("group_size", F.coalesce("_size", F.size("ids")).cast("long"))
    rows_ = sized.select("keep_id", "group_size", "lead", "text_sha256", F.posexplode("ids").alias("_at", "doc_id"))
    return rows_.select("doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("_at") == 0)).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are named: exactly one of each group."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    stay = content_sort_dedup(docs).filter("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("digest"))
    sha = F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()).cast("binary"), 256)
    same = (F.col("sha") == F.col("digest")) & F.col("id").eqNullSafe(F.col("keep"))
    keyed = own.withColumn("sha", sha).withColumn("id", doc_id.cast("long"))
    return keyed.join(stay, same, "left_semi").dropDuplicates(["id", "sha"]).drop("id", "sha").toDF(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(table(spark, sf_dir, "documents"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = f"""
WITH t AS (SELECT doc_id, {_FOLD} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
