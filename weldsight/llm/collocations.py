"""Phrase collocations by hierarchical pair naming: a phrase of k words is a pair of neighbouring phrases of k - 1."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.llm.common import cut, discard, mix64, small_batches, table, text_buffers, trim, written

LEAST, LONGEST, TOP = 30, 4, 2000
#: Words of a block. Its distinct phrases are what meets, so that larger blocks move less; one takes a task some 200 MB.
BLOCK = 1 << 22
#: Bytes of text for each place where phrases meet: so many words at most, hence distinct phrases of blocks, about.
MEETING = 1 << 23
#: Documents in an Arrow batch.
BATCH_DOCS = 200

#: What ends a piece, what parts words. No text holds the byte 0xFF, as none is UTF-8 with it.
ENDS, GAP, MARK = b".,;:!?\n\x0b\x0c\r", b" ", b"\xff"
_TABLE = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _TABLE[_c] = _c + 32
for _c in ENDS:
    _TABLE[_c] = MARK[0]
_TABLE[ord("\t")] = GAP[0]
_TABLE = bytes(_TABLE)

#: A block's own line has its sequence of ``size`` numbers, of which those after ``own`` only follow phrases that start
#: before; the others have ``size`` phrases of the block that meet those of other blocks in ``bucket``, words as text of
#: ``own`` bytes.
BLOCKS = "lang string, block long, own int, size int, sequence binary, bucket int, phrases binary, words binary"
_BLOCKS = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("own", pa.int32()), ("size", pa.int32()), ("sequence", pa.binary()), ("bucket", pa.int32()), ("phrases", pa.binary()), ("words", pa.binary())])
#: A frequent phrase with its id, or ``size`` numbers of a block's phrases with their ids.
MET = "lang string, id long, x long, y long, f long, word binary, block long, size int, known binary"
_MET = pa.schema([("lang", pa.string()), ("id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("f", pa.int64()), ("word", pa.binary()), ("block", pa.int64()), ("size", pa.int32()), ("known", pa.binary())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers byte by byte (all lowest bytes, then all next ones): the high ones are alike and take next to no room."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int, *kinds: str) -> list[np.ndarray]:
    if not size:
        return [np.zeros(0, k) for k in kinds]
    raw = pa.decompress(packed, size * sum(np.dtype(k).itemsize for k in kinds), codec="zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        wide = np.dtype(k).itemsize
        out.append(np.frombuffer(raw, np.uint8, size * wide, at).reshape(wide, size).T.copy().view(k).ravel())
        at += size * wide
    return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in it, ascending)."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


class _Block:
    """Words of one language until there are enough of them; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        assert self.words[MARK] == 0

    def add(self, tokens: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(tokens) + 1

    def rows(self, lang: str, block: int, own: int, buckets: int) -> list[dict]:
        sequence = np.concatenate(self.parts)
        counts = np.bincount(sequence[:own], minlength=len(self.words))[1:].astype("<i4")
        words = list(self.words)[1:]
        out = [{"lang": lang, "block": block, "own": own, "size": len(sequence), "sequence": _pack(sequence - 1)}]  # -1 for ends
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        for at, part in _by_bucket(bucket):
            text = MARK.join([words[i] for i in part])
            out.append({"lang": lang, "block": block, "own": len(text), "bucket": at, "size": len(part), "phrases": _pack(part.astype("<i4"), counts[part]), "words": _pack(np.frombuffer(text, np.uint8))})
        return out


def _blocks(limit: int, buckets: int):
    """Texts to blocks of numbered words. A text that passes a block's end goes on in the next one; the words that
    phrases starting before the end may still need stay with them as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        open_: dict[str, _Block] = {}
        for b in batches:
            offsets, raw = text_buffers(b.column(1))
            for i, lang in enumerate(b.column(0).to_pylist()):
                tokens = raw[offsets[i] : offsets[i + 1]].tobytes().translate(_TABLE).replace(MARK, b" " + MARK + b" ").split()
                at = 0
                while at < len(tokens):
                    held = open_.setdefault(lang, _Block())
                    more = tokens[at : at + max(1, limit - held.size)]
                    at += len(more)
                    own = held.size + len(more)
                    held.add(more + tokens[at : at + LONGEST - 1])
                    if own >= limit:
                        yield _table(open_.pop(lang).rows(lang, number, own, buckets), _BLOCKS)
                        number += 1
        for lang, held in open_.items():
            yield _table(held.rows(lang, number, held.size, buckets), _BLOCKS)
            number += 1
        trim()

    return run


def _numbered(rows: list[dict], bucket: int, least: int, first: np.ndarray, group: np.ndarray, n: np.ndarray, local: np.ndarray, owner: np.ndarray, named: dict[str, np.ndarray | list]) -> pa.Table:
    """Phrases of a bucket: ``group`` numbers each row's phrase, ``first`` is a row of each phrase, ``named`` what it is."""
    f = np.bincount(group, n, len(first)).astype(np.int64)  # exact up to 2^53
    frequent = np.flatnonzero(f >= least)
    ids = (np.int64(bucket) << 32) + np.arange(len(first), dtype=np.int64)
    size = len(frequent)
    lang = rows[0]["lang"]
    columns = {"lang": pa.array([lang] * size, pa.string()), "id": pa.array(ids[frequent], pa.int64()), "f": pa.array(f[frequent], pa.int64())}
    columns |= {c: pa.array(v[first[frequent]] if isinstance(v, np.ndarray) else [v[i] for i in first[frequent]], _MET.field(c).type) for c, v in named.items()}
    out = [pa.RecordBatch.from_arrays([columns.get(c.name, pa.nulls(size, c.type)) for c in _MET], schema=_MET)]
    held = np.flatnonzero((f >= least)[group])
    known = [{"lang": lang, "block": rows[at]["block"], "size": len(part), "known": _pack(local[held[part]].astype("<i4"), ids[group[held[part]]].astype("<i8"))} for at, part in _by_bucket(owner[held])]
    trim()
    return pa.Table.from_batches([*out, _table(known, _MET)], schema=_MET)


def _meet(least: int, level: int):
    """Phrases of all blocks in a bucket to those that start ``least`` times or more, and their ids in each block.

    ``_pairs`` and ``_Block`` give a phrase to the same bucket in every block, and each block has it once.
    """

    def run(met: pa.Table) -> pa.Table:
        rows = met.to_pylist()
        bucket = rows[0]["bucket"]
        owner = np.repeat(np.arange(len(rows)), [r["size"] for r in rows])
        if level == 1:
            parts = [_unpack(r["phrases"], r["size"], "<i4", "<i4") for r in rows]
            local, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
            words = [w for r in rows for w in _unpack(r["words"], r["own"], "u1")[0].tobytes().split(MARK)]
            seen: defaultdict[bytes, int] = defaultdict()
            seen.default_factory = seen.__len__
            group = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
            first = np.unique(group, return_index=True)[1]
            return _numbered(rows, bucket, least, first, group, n, local, owner, {"word": words})
        parts = [_unpack(r["phrases"], r["size"], "<i4", "<i4", "<i8", "<i8") for r in rows]
        local, n, x, y = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((y, x))
        new = np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return _numbered(rows, bucket, least, order[new], group, n, local, owner, {"x": x, "y": y})

    return run


def _pairs(buckets: int):
    """A block and the ids of its frequent phrases to the pairs of neighbours that both have one."""

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _BLOCKS.empty_table()
        line = blocks.to_pylist()[0]
        sequence = _unpack(line["sequence"], line["size"], "<i4")[0]
        ids = np.full(max(int(sequence.max(initial=0)) + 1, 1), -1, np.int64)
        for k in known.to_pylist():
            local, own = _unpack(k["known"], k["size"], "<i4", "<i8")
            ids[local] = own
        at = np.where(sequence >= 0, ids[sequence], -1)
        starts = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        keys, which = np.unique(sequence[starts].astype(np.int64) << 32 | sequence[starts + 1], return_inverse=True)
        counts = np.bincount(which[starts < line["own"]], minlength=len(keys)).astype("<i4")
        named = np.full(len(sequence), -1, "<i4")
        named[starts] = which
        x, y = ids[keys >> 32], ids[keys & 0xFFFFFFFF]
        head = {c: line[c] for c in ("lang", "block")}
        out = [head | {"own": line["own"], "size": len(named), "sequence": _pack(named)}]
        bucket = (mix64(mix64(x.astype(np.uint64)) + y.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for b, part in _by_bucket(bucket):
            out.append(head | {"bucket": b, "size": len(part), "phrases": _pack(part.astype("<i4"), counts[part], x[part], y[part])})
        trim()
        return pa.Table.from_batches([_table(out, _BLOCKS)], schema=_BLOCKS)

    return run


def phrases(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language, n; for each length from 1 to LONGEST the phrases that occur ``least`` times or more).

    Phrases have lang, id, x and y (the ids of the phrases without their last and first word), f, phrase, last (its last
    word), heads and tails: how often its first and its last 1, 2, ... words occur. Words are split off in tasks into
    blocks, in which phrases are numbers. On every level the blocks' distinct phrases meet by a hash in one shuffle,
    packed by block and bucket; those that are frequent get ids, and the blocks replace neighbours that both have ids by
    pairs, the phrases of the next level: every part of a frequent phrase is as frequent, so that none is lost. A phrase
    meets once for each block, so that neither a common one nor a large language makes a bucket large.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MEETING
    with small_batches(spark, BATCH_DOCS):
        named = written(texts.mapInArrow(_blocks(block, buckets), BLOCKS), "words")
    levels: list[DataFrame] = []
    for k in range(1, LONGEST + 1):
        met = written(named.filter("bucket IS NOT NULL").groupBy("lang", "bucket").applyInArrow(_meet(least, k), MET), f"phrases-{k}")
        found = met.filter("id IS NOT NULL")
        if k == 1:
            words = cut(named.filter("bucket IS NOT NULL").select("lang", "size", "phrases").mapInArrow(_words, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")))
            word = F.col("word").cast("string")
            level = found.select("lang", "id", "f", word.alias("phrase"), word.alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
        else:
            first = levels[-1].select(F.col("id").alias("x"), "lang", "phrase", "heads")
            rest = levels[-1].select(F.col("id").alias("y"), "lang", "last", "tails")
            joined = found.join(first, ["lang", "x"]).join(rest, ["lang", "y"])
            grown = [F.concat(c, F.array("f")).alias(c) for c in ("heads", "tails")]
            level = joined.select("lang", "id", "x", "y", "f", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", *grown)
        levels.append(cut(level))
        before, key = named, ("lang", "block")
        if k < LONGEST:
            lines = named.filter("sequence IS NOT NULL").select(*key, "own", "size", "sequence")
            known = met.filter("known IS NOT NULL").select(*key, "size", "known")
            named = written(lines.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(_pairs(buckets), BLOCKS), f"pairs-{k}")
        discard(before)
        discard(met)
    return words, levels


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words each row of a block's distinct words stands for."""
    for b in batches:
        n = [int(_unpack(p, size, "<i4", "<i4")[1].sum(dtype=np.int64)) for size, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["lang", "n"])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to 4 words that occurs ``least`` times or more is cut where floor(2000000 * a / (l + r)) is least, of
    equals after the fewest words. It is dropped where a phrase of one word more around it occurs at least 0.8 times as
    often: a still longer one occurs no more often than the one between, so that the parents tell. Null texts have no
    words, a null language is ``und``; repeated rows count each; phrases of equal score go by a, then by their bytes; an
    empty table gives no rows; other columns are not read. Words are never joined over the end of a piece or text.
    """
    words, levels = phrases(docs, least, block)
    out = []
    for k in range(2, LONGEST + 1):
        level = levels[k - 1]
        cuts = [F.struct(F.expr(f"2000000BD * CAST(f AS DECIMAL(20, 0)) div CAST(heads[{j - 1}] + tails[{k - j - 1}] AS DECIMAL(20, 0))").alias("score"), F.lit(j).alias("k"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)]
        kept = level
        if k < LONGEST:
            longer = levels[k]
            around = longer.select("lang", F.col("x").alias("id"), "f").unionByName(longer.select("lang", F.col("y").alias("id"), "f")).groupBy("lang", "id").agg(F.max("f").alias("longer"))
            kept = level.join(around, ["lang", "id"], "left").filter(F.coalesce(100 * F.col("longer") < 80 * F.col("f"), F.lit(True)))
        out.append(kept.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut")))
    found = out[0].unionByName(out[1]).unionByName(out[2]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _grams(k: int) -> str:
    rest = "".join(f" || ' ' || w{i}" for i in range(1, k))
    return f"SELECT lang, {k} AS k, w0{rest} AS phrase, count(*) AS f FROM runs WHERE w{k - 1} IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}"


_PART = "(SELECT lang, phrase, f FROM grams) {0}"
OP13_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
listed AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces),
placed AS (SELECT p, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
runs AS (SELECT lang, w AS w0, {", ".join(f"lead(w, {i}) OVER (PARTITION BY p ORDER BY i) AS w{i}" for i in range(1, LONGEST))} FROM placed),
sizes AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
grams AS ({" UNION ALL ".join(_grams(k) for k in range(1, LONGEST + 1))}),
cuts AS (SELECT g.lang, g.phrase, g.k, g.f AS a, j, array_to_string(string_split(g.phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(g.phrase, ' ')[j + 1:], ' ') AS tail
  FROM grams g, range(1, {LONGEST}) t(j) WHERE j < g.k),
scored AS (SELECT c.lang, c.phrase, c.k, a, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase, c.k ORDER BY score, j) = 1),
inside AS (SELECT lang, f, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase FROM grams, range(1, {LONGEST}) a(s), range(2, {LONGEST}) b(m) WHERE m < k AND s + m - 1 <= k),
kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 80 * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang) QUALIFY rank <= {TOP}
"""
