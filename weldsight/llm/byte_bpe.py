"""Byte-level BPE with DuckDB: each task contracts its own distinct words by a recursive query."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import BATCH_ROWS, ragged, small_batches, table, text_buffers, trim, written

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a word goes to the query. One merge a step makes its cost grow with the square of a word's length,
#: so that the same contraction of longer words (long runs without any break) keeps its pairs in a heap. The query's
#: places hold a byte's number in its word in eight bits.
LONGEST = 256
#: Words kept encoded between tasks by a Python worker, and bytes or tokens handed to one query.
KEPT_WORDS, BLOCK_BYTES, DECODE_ROWS = 300_000, 200_000, 250_000
#: Bytes of text, and ids, that a worker holds as single words at a time; blocks after which it gives memory back.
TEXT_BYTES, IDS, TRIM = 1_000_000, 300_000, 16

# A row is one token of a word, at its place in the block (word, then first byte): one window over the places gives each
# token the next one. Each step joins neighbouring tokens to the merges and contracts, in every word that still has a
# merge, the leftmost pair of the least rank, whose second token goes; a word without one is done.
_CONTRACT_SQL = """
WITH RECURSIVE s AS (
  SELECT w, (w::BIGINT << 8) + pos AS place, tok, FALSE AS done FROM base
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT p.w, p.place, p.tok, p.after, CASE WHEN p.place >> 8 = p.after >> 8 THEN (m.rank::BIGINT << 40) + p.place END AS key
     FROM (SELECT w, place, tok, lead(tok) OVER o AS follows, lead(place) OVER o AS after FROM s WHERE NOT done WINDOW o AS (ORDER BY place)) p
     LEFT JOIN merges m ON m.l = p.tok AND m.r = p.follows),
   least AS (SELECT w, min(key) AS best, arg_min(after, key) AS gone FROM pairs GROUP BY w)
   SELECT pairs.w, place, CASE WHEN key = best THEN (key >> 40)::INTEGER ELSE tok END, best IS NULL
   FROM pairs JOIN least ON pairs.w = least.w
   WHERE place IS DISTINCT FROM gone))
SELECT w, tok FROM s WHERE done ORDER BY place
"""

_DECODE_SQL = "SELECT array_agg(bytes) AS parts FROM (SELECT bytes FROM tokens JOIN vocabulary USING (tok) ORDER BY pos)"


def _splitter(pattern: str):
    """A text's words. For the public pattern the standard library's engine is faster; it stands in wherever the text
    has none of the characters whose classes it sees otherwise."""
    whole = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return whole.findall
    quick = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    plain = {chr(c) for r in (range(0x250), range(0x2010, 0x2028), range(0x20A0, 0x20C0)) for c in r}
    same = "".join(c for c in sorted(plain) if all(bool(re.match(a, c)) == bool(regex.match(b, c)) for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"))))
    other = re.compile(f"[^{re.escape(same)}]")
    return lambda text: (whole if other.search(text) else quick).findall(text)


class _Codec:
    """One Python worker's vocabulary, merge table and encoded words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = _splitter(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        flat = array("i")
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                if t[:i] in self.ranks and t[i:] in self.ranks:
                    flat.extend((self.ranks[t[:i]], self.ranks[t[i:]], r))
        merges = np.frombuffer(flat, np.int32).reshape(-1, 3)
        self.tables = {
            "merges": pa.table({c: np.ascontiguousarray(merges[:, i]) for i, c in enumerate(("l", "r", "rank"))}),
            "vocabulary": pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}),
        }
        self._open()
        self._forget()

    def _open(self) -> None:
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        for name, rows in self.tables.items():
            self.db.register("loading", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
            self.db.unregister("loading")

    def trim(self) -> None:
        """Gives freed memory back, also what an open database keeps of it."""
        self.db.close()
        self._open()
        trim()

    def _forget(self) -> None:
        """No word is known: words has a word's place in start and size, which point into pool."""
        self.words: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, words: list[str], tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, tokens])

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        at = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = ragged(np.zeros(len(words)), lengths).astype(np.int32)
        self.db.register("base", pa.table({"w": at, "pos": pos, "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        out = self.db.sql(_CONTRACT_SQL).to_arrow_table()
        self.db.unregister("base")
        w, tok = out.column("w").to_numpy(), out.column("tok").to_numpy()
        return tok, np.bincount(w, minlength=len(words)).astype(np.int64)

    def _contract_long(self, word: bytes) -> np.ndarray:
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
        heap = [(r, i) for i in range(len(word) - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([self.ranks[p] for p in parts if p is not None], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encodes the words that are not known yet."""
        if len(self.words) > KEPT_WORDS:
            self._forget()
        done: list[tuple[str, np.ndarray]] = []
        names: list[str] = []
        new: list[bytes] = []
        for word in words:
            if word in self.words:
                continue
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                done.append((word, np.array([rank], np.int32)))
            elif len(data) > LONGEST:
                done.append((word, self._contract_long(data)))
            else:
                names.append(word)
                new.append(data)
        if done:
            self._keep([w for w, _ in done], np.concatenate([t for _, t in done]), np.array([len(t) for _, t in done], np.int64))
        ends, at = np.cumsum([len(d) for d in new]), 0
        while at < len(new):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            self._keep(names[at:end], *self._contract(new[at:end]))
            at = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of the texts, one after the other."""
        split = [self.split(t) for t in texts]
        flat = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
        counts = np.array([len(words) for words in split], np.int64)
        del split
        vocabulary = flat.dictionary.to_pylist()
        self.learn(vocabulary)
        place = np.fromiter(map(self.words.__getitem__, vocabulary), np.int64, len(vocabulary))
        at = place[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return self.pool[ragged(self.start[at], sizes)], np.diff(ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each document's ids, by joining token rows to the vocabulary and aggregating in order."""
        pieces: list[bytes] = []
        lengths: list[np.ndarray] = []
        for at in range(0, len(ids), DECODE_ROWS):
            block = ids[at : at + DECODE_ROWS]
            self.db.register("tokens", pa.table({"pos": np.arange(len(block), dtype=np.int32), "tok": block}))
            parts = self.db.sql(_DECODE_SQL).to_arrow_table().column("parts").combine_chunks().flatten()
            self.db.unregister("tokens")
            if len(parts) != len(block):
                raise ValueError("an id is not in the vocabulary")
            offsets, data = text_buffers(parts)
            pieces.append(data.tobytes())
            lengths.append(np.diff(offsets))
        raw = b"".join(pieces)
        edges = np.concatenate([[0], *lengths]).cumsum()[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].astype(np.int64).tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_CODECS: dict[tuple[str, str], _Codec] = {}


def _codec(path: str | None, pattern: str) -> _Codec:
    """The worker's codec; a rank file that is not named is looked for where the worker runs."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = _Codec(path or public_tokenizers.path(RANKS), pattern)
    return _CODECS[path, pattern]


def _blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``most`` bytes (of text) or values (of ids), one row at least."""
    for b in batches:
        c = b.column(column)
        sizes = pc.fill_null(pc.binary_length(c) if pa.types.is_string(c.type) else pc.list_value_length(c), 0).to_numpy()
        ends, at = np.cumsum(sizes.astype(np.int64)), 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches, "text", TEXT_BYTES):
        ids, sizes = _codec(path, pattern).encode(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids, sizes)], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str) -> Iterator[pa.RecordBatch]:
    for b in _blocks(batches, "ids", IDS):
        lists = b.column("ids")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        decoded = pa.array(_codec(path, pattern).decode(lists.flatten().to_numpy(zero_copy_only=False), sizes), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists, decoded = b.column("ids"), b.column("decoded")
        sizes = pc.list_value_length(lists).to_numpy()
        raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = 4 * np.cumsum(sizes.astype(np.int64))
        shas = [hashlib.sha256(raw[e - 4 * n : e]).hexdigest() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        back = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
        columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(shas), pa.array(back)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the tiktoken library encodes ordinary text.

    ``path`` names a rank file; the pattern splits a text into words, each of which is encoded by itself. A word that
    is a token is that token. Null and empty texts have no ids; repeated rows and null identifiers stay as they are;
    an empty table gives no rows; other columns are not read.
    """
    pattern = pattern or public_tokenizers.PATTERN
    return _source(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, path, pattern), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded bytes; no ids (or null) give no bytes, and ids outside the vocabulary are an error."""
    pattern = pattern or public_tokenizers.PATTERN
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, path, pattern), "doc_id long, ids array<int>, decoded binary")


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to (with_ids: and the ids themselves).

    bpe_encode and bpe_decode in one pass of one worker, so that bytes stay in the task; it runs at once and is written
    in the shared folder. Nulls, repeated rows and empty tables are as in bpe_encode."""
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(_digests(_decoded(_encoded(batches, path, pattern), path, pattern))):
            yield b if with_ids else b.drop_columns("ids")
            if i % TRIM == TRIM - 1:
                _codec(path, pattern).trim()
        codec = _codec(path, pattern)
        if len(codec.words) > KEPT_WORDS // 2:  # idle workers stay small
            codec._forget()
        codec.trim()

    ids = "ids array<int>, " if with_ids else ""
    coded = _source(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return written(coded, "byte_bpe")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
