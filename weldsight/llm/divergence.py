"""How far the sources of a language are from each other: a rotation in which each source's vector visits its peers."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.llm.common import cut, settled_in_place, small_batches, table, trim

#: A term, documents that it needs, added occurrences, the scale of shares, terms a group.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a slice: a vector's share of a slice is 256 KB when spread out, whatever the vocabulary.
SLICE = 1 << 16
#: Groups that stay in a seat: from the least up, with the root of the groups, to the most.
SEATED = (8, 128)
#: Rounds whose visitors are shuffled together.
ROUNDS = 8
#: Documents in an Arrow batch, terms that a task counts before it hands them on, languages up to which their table is
#: broadcast (under 100 bytes a row).
BATCH_DOCS, HELD, BROADCAST_LANGS = 200, 400_000, 50_000

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTED = "lang string, source string, term string, n long, docs long"
MET = "part string, lang string, slice int, source string, item string, id int, value long"
_MET = pa.schema([("part", pa.string()), ("lang", pa.string()), ("slice", pa.int32()), ("source", pa.string()), ("item", pa.string()), ("id", pa.int32()), ("value", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of each (lang, source); a row with an empty term names the group."""
    find = re.compile(TERM).findall
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = ["", *n]
            size = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=_COUNTED)
        groups.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.ascii_lower(b.column(2)), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(find(text.as_py()))
            before = len(n)
            n.update(own)
            docs.update(own.keys())
            held += len(n) - before
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()
    trim()


def _pack(rows: pa.Table) -> pa.Table:
    """Counts of one vector's share of a slice, by id, in one compressed value."""
    order = np.argsort(rows.column("id").to_numpy())
    ids, n = (rows.column(c).to_numpy()[order] for c in ("id", "n"))
    packed = zlib.compress(np.diff(ids, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes(), 1)
    first = rows.slice(0, 1)
    source = first.column("source") if "source" in rows.column_names else pa.nulls(1, pa.string())
    return pa.table([first.column("lang"), first.column("slice"), source, pa.array([packed], pa.binary())], names=["lang", "slice", "source", "vector"])


PACKED = "lang string, slice int, source string, vector binary"


def _shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), exactly."""
    if (total + ADDED) * SCALE >= 1 << 63:
        count = count.astype(object)
    return np.asarray(1 + SCALE * (count + ADDED) // (total + ADDED * terms), np.int64)


def _spread(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the terms that occur, shares of all terms of the slice)."""
    raw = zlib.decompress(row["vector"]) if row["vector"] is not None else b""
    size = len(raw) // 12
    ids, n = np.cumsum(np.frombuffer(raw, "<i4", size)), np.frombuffer(raw, "<i8", size, 4 * size)
    shares = np.zeros(row["width"], np.int64)
    if row["width"]:
        shares[:] = _shares(np.zeros(1, np.int64), row["total"], row["terms"])[0]
        shares[ids] = _shares(n, row["total"], row["terms"])
    return ids, shares.astype(np.int32)  # at most SCALE + 1


def _met(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_MET), _MET, strict=True)], schema=_MET)


def _both(a: dict, b: dict, value: int) -> list[tuple]:
    return [("pair", x["lang"], x["slice"], x["source"], y["source"], None, value) for x, y in ((a, b), (b, a))]


def _home(seated: pa.Table, whole: pa.Table) -> pa.Table:
    """Those of a seat with each other, and the terms of each that are furthest above the language."""
    groups, out, before = seated.to_pylist(), [], []
    q = _spread(whole.to_pylist()[0])[1] if groups else None
    for g in groups:
        ids, shares = _spread(g)
        for other, theirs in before:
            out += _both(g, other, int(np.abs(shares - theirs).sum(dtype=np.int64)))
        before.append((g, shares))
        more = shares[ids] - q[ids]
        above = np.flatnonzero(more > 0)
        # a heap of the highest, of equals the first in the order of terms
        for value, i in heapq.nsmallest(TOP, zip((-more[above]).tolist(), ids[above].tolist(), strict=True)):
            out.append(("term", g["lang"], g["slice"], g["source"], None, i, -value))
    return _met(out)


def _meeting(seated: pa.Table, visitors: pa.Table) -> pa.Table:
    """Those of a seat with each visitor of some rounds, in both directions."""
    groups, out = seated.to_pylist(), []
    stay = np.array([_spread(g)[1] for g in groups], np.int32)
    for b in visitors.to_batches(max_chunksize=16):
        for v in b.to_pylist() if groups else []:
            far = np.abs(stay - _spread(v)[1]).sum(axis=1, dtype=np.int64)
            for g, value in zip(groups, far.tolist(), strict=True):
                out += _both(g, v, value)
    return _met(out)


def _visits(start: int) -> Column:
    """Seats that a block visits in ROUNDS rounds from ``start`` on, by the circle method over an even number of blocks.

    The last block stays in the middle and meets block r in round r; others b and c meet where b + c = 2 r, modulo the
    rest. Of two that meet, the lower visits where their sum is even, so that each visits about half of the others.
    """
    r = "r -> CASE WHEN block = blocks - 1 THEN r WHEN block = r THEN blocks - 1 ELSE pmod(2 * r - block, blocks - 1) END"
    rounds = f"transform(sequence({start}, least({start + ROUNDS}, blocks - 1) - 1), {r})"
    return F.expr(f"CASE WHEN blocks - 1 > {start} THEN filter({rounds}, c -> (block < c) = ((block + c) % 2 = 0)) END")


def divergence(docs: DataFrame, least: int = LEAST, slice_terms: int = SLICE // 2, seated: tuple[int, int] = SEATED) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others (part ``pair``), and
    its terms furthest above the language's share (part ``term``, TOP of them).

    Tasks count terms for each (lang, source) before the shuffle. The terms of a language that occur in ``least`` of its
    documents are dealt into slices by a hash, and each group's counts in a slice are one compressed vector. Groups are
    dealt to seats and stay there, checkpointed where they are; in the rounds of a tournament each block of vectors
    visits the seats of the others, where both directions are evaluated, and sums over the slices follow. A task holds
    one seat's share of one slice, so that neither a large source nor a large vocabulary needs more memory.

    Null lang, source and text are ''. Groups without terms, and languages without terms that are kept (all values 0),
    have their pairs; a language with one source has none. Repeated rows count each, ties go by the bytes of the item,
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    with small_batches(spark, BATCH_DOCS):
        counts = cut(texts.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups, found = counts.filter("term = ''").select("lang", "source"), counts.filter("term <> ''")
    words = cut(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).filter(F.col("docs") >= least).drop("docs"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(words.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all")), "lang", "left").fillna(0)
    seat = f"least({seated[1]}, greatest({seated[0]}, ceil(sqrt(groups))))"
    langs = cut(sizes.selectExpr("lang", "terms", "all", f"CAST(greatest(1, ceil(terms / {slice_terms})) AS INT) AS slices", f"CAST(2 * ceil(groups / (2 * {seat})) AS INT) AS blocks"))
    known = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    order = Window.partitionBy("lang", "slice").orderBy("term")
    named = words.join(known, "lang").withColumn("slice", F.expr("CAST(pmod(xxhash64(term), slices) AS INT)"))
    terms = cut(named.select("lang", "slice", "term", "n", (F.row_number().over(order) - 1).alias("id")))
    kept = cut(found.select("lang", "source", "term", "n").join(terms.select("lang", "term", "slice", "id"), ["lang", "term"]).drop("term"))

    vectors = kept.groupBy("lang", "slice", "source").applyInArrow(_pack, PACKED)
    whole = terms.groupBy("lang", "slice").applyInArrow(_pack, PACKED).drop("source")
    widths = terms.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("width"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sliced = groups.join(known, "lang").join(totals, ["lang", "source"], "left").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    members = sliced.withColumn("block", F.expr("CAST(pmod(xxhash64(source), blocks) AS INT)")).join(widths, ["lang", "slice"], "left").join(vectors, ["lang", "slice", "source"], "left").fillna(0, ["width", "total"])
    row = ("source", "total", "terms", "width", "vector")
    key = ("lang", "slice", "block")
    with settled_in_place(spark):  # later rounds move the visitors alone
        resident = cut(members.select(*key, "blocks", *row).repartition(*key))
    language = langs.withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)"))).join(widths, ["lang", "slice"], "left").join(whole, ["lang", "slice"], "left").fillna(0, ["width"])
    language = language.select(F.col("lang").alias("lang"), F.col("slice").alias("slice"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit("").alias("source"), F.col("all").alias("total"), "terms", "width", "vector")
    met = [resident.drop("blocks").groupBy(*key).cogroup(language.groupBy(*key)).applyInArrow(_home, MET)]
    most = langs.agg(F.max("blocks")).first()[0] or 0
    for start in range(0, most - 1, ROUNDS):
        visitors = resident.select(F.explode(_visits(start)).alias("block"), *[F.col(c).alias(c) for c in ("lang", "slice", *row)])
        met.append(resident.drop("blocks").groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(_meeting, MET))
    evaluated = met[0]
    for m in met[1:]:
        evaluated = evaluated.unionByName(m)
    evaluated = cut(evaluated)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = evaluated.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    top = evaluated.filter("part = 'term'").drop("item").join(terms.select("lang", "slice", "id", F.col("term").alias("item")), ["lang", "slice", "id"])
    top = top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(top.select(*columns))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_P = f"CAST(1 + {SCALE}::HUGEINT * ({{0}} + {ADDED}) // ({{1}} + {ADDED} * v) AS BIGINT)"
OP11_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '{TERM}') AS words FROM documents),
placed AS (SELECT d, lang, source, unnest(words) AS term FROM texts),
words AS (SELECT lang, term, count(*) AS n FROM placed GROUP BY ALL HAVING count(DISTINCT d) >= {LEAST}),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM words GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT lang, source, term, count(*) AS c FROM placed SEMI JOIN words USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, coalesce(CAST(sum(c) AS BIGINT), 0) AS s FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (SELECT lang, source, term, coalesce(c, 0) AS c, {_P.format("coalesce(c, 0)", "s")} AS p, {_P.format("n", "total")} AS q
  FROM sums JOIN words USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (FROM pairs UNION ALL FROM tops) QUALIFY part = 'pair' OR rank <= {TOP}
"""
