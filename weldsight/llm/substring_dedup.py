"""Repeated 400-byte strings across all documents, by suffix sorting around shared anchors."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import MANY, cut, mix64, partitions, small_batches, table, text_buffers, trim
from weldsight.llm.grouping_sort import common_prefixes, suffix_array

LENGTH, GRAM = 400, 32
#: Rows of an anchor (copies of texts included) beyond which its strings are compared by their digests in a shuffle
#: instead of being sorted in one task; symbols that are sorted together.
HOT, SYMBOLS = 50_000, 30_000
#: Bytes of text whose anchors are found together; longer texts go in windows of so many.
WINDOW = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first starts, last starts) of the anchors of texts that lie one after the other in ``data``.

    Every string of ``length`` bytes within a text has one anchor: the first of its grams with the least hash. Equal
    strings have equal anchors at the same distance from their start. The strings of an anchor start side by side.
    """
    n = len(data)
    width = length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, m = _BYTES[data], 1
    while m < gram:
        h = (h[:-m] * _A) ^ (h[m:] * _B)
        h ^= h >> np.uint64(29)
        m *= 2
    h = mix64(h)
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = -(-len(keys) // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts])
    inside = np.ones(starts, bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1) : end] = False
    begins = np.flatnonzero(inside)
    at = (least[begins] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # ascending
    new = np.flatnonzero(np.diff(at, prepend=-1) > 0)
    lasts = np.append(new[1:], len(at)) - 1 if len(at) else new
    return at[new], h[at[new]], begins[new], begins[lasts]


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _windows(size: int, window: int, length: int = LENGTH) -> Iterator[tuple[int, int]]:
    """Windows of a text that share length - 1 bytes, so that each string lies in one of them."""
    for at in range(0, max(size - length + 1, 1), window):
        yield at, min(size, at + window + length - 1)


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """An anchor's place, its hash, and how far its strings reach to the left and right of it."""

    def rows(keys: pa.Array, doc: np.ndarray, data: np.ndarray, ends: np.ndarray, shift: np.ndarray) -> pa.RecordBatch:
        place, h, first, last = anchors(data, ends)
        own = np.searchsorted(ends, place, "right")
        columns = [(place - shift[own]).astype(np.int32), (place - first).astype(np.int16), (last + LENGTH - place).astype(np.int16), h.view(np.int64)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(doc[own])), *map(pa.array, columns)], ["key", "pos", "left", "right", "h"])

    for whole in batches:
        offsets, data = text_buffers(whole.column("text"))
        keys = pa.array([hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        at, n = 0, len(keys)
        while at < n:  # parts of a window's size, as their arrays take a hundred times that
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + window, "right")) - 1)
            if end == at + 1:
                # an anchor of two windows has a row for each, which share no string of the full length
                for first, stop in _windows(int(offsets[end] - offsets[at]), window):
                    yield rows(keys, np.array([at]), data[offsets[at] + first : offsets[at] + stop], np.array([stop - first]), np.array([-first]))
            else:
                ends = offsets[at + 1 : end + 1] - offsets[at]
                yield rows(keys, np.arange(at, end), data[offsets[at] : offsets[end]], ends, offsets[at:end] - offsets[at])
            at = end
    trim()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor that strings through it can have; equal ones of a text are one row with all places."""
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.binary())
    names = ("h", "hot", "key", "places", "left", "context")
    for b in _parts(batches, 50):
        rows: list[tuple] = []
        for i, (key, spots) in enumerate(zip(b.column("key").to_pylist(), b.column("spots").to_pylist(), strict=True)):
            text = b.column("text")[i].as_buffer()
            own: dict[tuple, list[int]] = {}
            for s in spots:
                context = text[s["pos"] - s["left"] : s["pos"] + s["right"]].to_pybytes()
                own.setdefault((s["h"], s["hot"], s["left"], context), []).append(s["pos"])
                if len(own) == 2000:  # of a long text, whose equal contexts then take several rows
                    yield pa.RecordBatch.from_arrays([pa.array([(h, hot, key, p, m, c)[j] for (h, hot, m, c), p in own.items()], t) for j, t in enumerate(kinds)], names)
                    own = {}
            rows.extend((h, hot, key, places, left, context) for (h, hot, left, context), places in own.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
    trim()


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


class _Side:
    """One side of the contexts of an anchor: the tree of their common prefixes, read away from the anchor."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.order = sorted(range(len(strings)), key=strings.__getitem__)
        self.lcp = [_shared(strings[i], strings[j]) for i, j in zip(self.order, self.order[1:], strict=False)]
        self.most = [0] * len(strings)
        for k, i in enumerate(self.order):
            self.most[i] = max(self.lcp[k - 1] if k else 0, self.lcp[k] if k < len(self.lcp) else 0)

    def paths(self) -> tuple[list[array], list[int]]:
        """For each string the inner nodes from the root to it, and the depth of each node: two strings have common
        nodes up to the depth to which they agree."""
        depth, parent, stack = [0], [-1], [0]
        owner = [0] * len(self.order)
        for k, common in enumerate(self.lcp, 1):
            last = -1
            while depth[stack[-1]] > common:
                last = stack.pop()
            if depth[stack[-1]] < common:
                depth.append(common)
                parent.append(stack[-1])
                stack.append(len(depth) - 1)
            if last >= 0:
                parent[last] = stack[-1]
            owner[k] = stack[-1]
            if depth[owner[k - 1]] < common:
                owner[k - 1] = stack[-1]
        out = [array("i") for _ in self.order]
        for k, i in enumerate(self.order):
            node = owner[k]
            while node > 0:
                out[i].append(node)
                node = parent[node]
            out[i].reverse()
        return out, depth


class _Sorter:
    """Collects the contexts of anchors as short strings of symbols and sorts their suffixes together."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.seq = array("i")
        self.rows: list[tuple] = []
        self.free = 1

    def add(self, contexts: dict[tuple[int, bytes], list[tuple[bytes, int]]]) -> list[tuple[bytes, int, int]]:
        """Spans that are known at once: contexts with several places."""
        known, items = [], list(contexts.items())
        for (left, context), places in items:
            if len(places) > 1 and len(context) >= LENGTH:
                known.extend((key, pos - left, pos - left + len(context)) for key, pos in places)
        while len(items) > 1:
            ahead, back = _Side([c[left:] for (left, c), _ in items]), _Side([c[:left][::-1] for (left, c), _ in items])
            able = [a + b >= LENGTH for a, b in zip(ahead.most, back.most, strict=True)]
            if all(able):
                break
            items = [x for x, ok in zip(items, able, strict=True) if ok]
        if len(items) < 2:
            return known
        right, depth_right = ahead.paths()
        left, depth_left = back.paths()
        first_right, first_left = self.free, self.free + len(depth_right)
        self.free += len(depth_right) + len(depth_left)
        for i, (_, places) in enumerate(items):
            self.rows.append((len(self.seq), places, array("i", [depth_left[x] for x in left[i]]), array("i", [depth_right[x] for x in right[i]])))
            self.seq.extend(array("i", [first_left + x for x in reversed(left[i])]))
            self.seq.extend(array("i", [first_right + x for x in right[i]]))
            self.seq.append(self.free)
            self.free += 1
        return known

    def spans(self) -> list[tuple[bytes, int, int]]:
        """The span of each collected context: from each left distance, how far the best other one agrees to the right.

        Every string of a context holds its anchor, so that what they cover together is one span.
        """
        if not self.seq:
            return []
        order = suffix_array(self.seq)
        lcp = common_prefixes(self.seq, order)
        best = array("i", bytes(4 * len(self.seq)))
        for k, i in enumerate(order):
            best[i] = max(lcp[k], lcp[k + 1] if k + 1 < len(lcp) else 0)
        out = []
        for at, places, lefts, rights in self.rows:
            count, reach, end = len(lefts), -1, 0
            for k in range(count, -1, -1):
                beyond = best[at + count - k] - k
                if beyond <= 0:
                    continue
                most = lefts[k - 1] if k else 0
                least = max((lefts[k - 2] + 1 if k > 1 else 1) if k else 0, LENGTH - rights[beyond - 1])
                if least <= most:
                    reach, end = max(reach, most), max(end, LENGTH - least)
            if reach >= 0:
                out.extend((key, pos - reach, pos + end) for key, pos in places)
        self.reset()
        return out


def _span_batch(spans: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], t) for i, t in enumerate(kinds)], ["key", "first", "end"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to spans of repeated strings."""
    sorter, spans = _Sorter(), []
    now, contexts = None, {}
    for b in _parts(batches, 500):
        for h, key, places, left, context in zip(*[b.column(c).to_pylist() for c in ("h", "key", "places", "left", "context")], strict=True):
            if h != now:
                spans += sorter.add(contexts)
                now, contexts = h, {}
                if len(sorter.seq) > SYMBOLS:
                    spans += sorter.spans()
                if len(spans) > 20_000:
                    yield _span_batch(spans)
                    spans = []
                    trim()
            contexts.setdefault((left, context), []).extend((key, p) for p in places)
    spans += sorter.add(contexts)
    spans += sorter.spans()
    yield _span_batch(spans)
    del spans, sorter, contexts
    trim()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the strings through very common anchors, each once for its context: ``several`` says whether the text
    has the context at several places, which are known spans then (rows without a digest)."""
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_())
    for b in _parts(batches, 50):
        rows = []
        for key, places, left, context in zip(*[b.column(c).to_pylist() for c in ("key", "places", "left", "context")], strict=True):
            several, first = len(places) > 1, places[0] - left
            if several:
                rows.extend((None, key, p - left, p - left + len(context), True) for p in places)
            rows.extend((xxhash.xxh3_128_digest(context[i : i + LENGTH]), key, first + i, first + i + LENGTH, several) for i in range(len(context) - LENGTH + 1))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["digest", "key", "first", "end", "several"])
    trim()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _parts(batches, 200):
        rows = []
        for i, (key, spans) in enumerate(zip(b.column("key").to_pylist(), b.column("spans").to_pylist(), strict=True)):
            text = b.column("text")[i].as_buffer()
            kept, at, removed, count, reach = hashlib.sha256(), 0, 0, 0, -1
            for first, end in sorted((s["first"], s["end"]) for s in spans):
                if first > reach:
                    kept.update(text[at:first])
                    count += 1
                    removed += end - first
                elif end > reach:
                    removed += end - reach
                reach = at = max(reach, end)
            kept.update(text[at:])
            rows.append((key, removed, count, kept.hexdigest()))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["key", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """key and spans (first, end) of each distinct text's bytes that a string found elsewhere covers.

    ``texts`` has text alone, copies included; key is the text's md5. Strings of 400 bytes meet by the anchor they
    share. The contexts of an anchor that occurs at several places come together; what they share on either side of it
    turns each into a few symbols, and a suffix array of these finds for each left reach the longest right reach.
    """
    n = partitions(texts.sparkSession)
    long_ = texts.filter(F.octet_length("text") >= LENGTH)
    rows = cut(long_.mapInArrow(_anchor_rows, "key binary, pos int, left smallint, right smallint, h long"))
    spot = F.xxhash64("key", "pos")
    several = cut(rows.groupBy("h").agg(F.min(spot).alias("a"), F.max(spot).alias("b"), F.count(F.lit(1)).alias("c")).filter("a < b").select("h", "c"))
    # anchors with over a quarter of a partition's share, 4 for each partition at most, are looked up in a broadcast table
    least = max(MANY, rows.count() // (4 * n) + 1)
    common = F.broadcast(several.filter(F.col("c") >= least))
    spots = rows.join(common, "h").unionByName(rows.join(common.select("h"), "h", "left_anti").join(several, "h"))
    by_text = cut(spots.groupBy("key").agg(F.collect_set(F.struct("pos", "left", "right", "h", (F.col("c") > hot).alias("hot"))).alias("spots")))
    whole = long_.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    contexts = whole.join(by_text, "key").mapInArrow(_contexts, "h long, hot boolean, key binary, places array<int>, left int, context binary")
    if by_text.filter(F.exists("spots", lambda s: s["hot"])).isEmpty():
        spans = contexts.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_resolve, "key binary, first int, end int")
    else:
        strings = cut(contexts.filter("hot").mapInArrow(_digests, "digest binary, key binary, first int, end int, several boolean"))
        twice = strings.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("key", "first")).alias("a"), F.max(F.struct("key", "first")).alias("b"), F.max("several").alias("s")).filter("s OR a <> b").select("digest")
        hot_spans = strings.join(twice, "digest", "left_semi").unionByName(strings.filter("digest IS NULL")).select("key", "first", "end")
        spans = contexts.filter("not hot").repartition(n, "h").sortWithinPartitions("h").mapInArrow(_resolve, "key binary, first int, end int").unionByName(hot_spans)
    return cut(spans.groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("spans")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row: what is left without repeated strings.

    Every byte goes that a string of 400 bytes covers which starts anywhere else too, in the same or another row's
    text; strings are judged on the input. Texts of 400 bytes and more that several rows have go whole. Null texts
    count as empty; nothing is removed from texts under 400 bytes; repeated rows are copies of one another, whatever
    their doc_id; an empty table gives no rows; other columns are not read.
    """
    with small_batches(docs.sparkSession, 500):
        return _remove_repeats(docs, id_col, text_col, hot)


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = F.col("text").cast("binary")
    rows = cut(source.select("doc_id", F.unhex(F.md5(raw)).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha")))
    copied = rows.filter(F.col("n_bytes") >= LENGTH).groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("key", F.lit(True).alias("_copied"))
    spans = repeated_spans(source.select("text"), hot).join(copied.select("key"), "key", "left_anti")
    keyed = source.filter(F.octet_length("text") >= LENGTH).select(F.unhex(F.md5(raw)).alias("key"), "text")
    partly = cut(keyed.join(spans, "key").mapInArrow(_remove, "key binary, n_removed long, n_spans long, kept_sha256 string"))
    found = rows.join(copied, "key", "left").join(partly, "key", "left")
    gone = F.col("_copied").isNotNull()
    return found.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
