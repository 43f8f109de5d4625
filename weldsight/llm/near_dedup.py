"""Near duplicates: BagMinHash signatures of word shingles, banded, and verified by multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import BATCH_ROWS, cut, lookup, mix64, narrow, ragged, settled, small_batches, table, trim, unit

WORDS, THRESHOLD = 5, 0.8
#: Jaccard similarity reaches 0.8 just if WHOLE times the symmetric difference is at most the sum of both sizes.
WHOLE = 9
#: A pair at the threshold meets in one band at least with probability 1 - (1 - 0.8**4)**20 > 0.99997.
BANDS, BAND_ROWS = 20, 4
REGISTERS = BANDS * BAND_ROWS
#: Slots by hash from which a region's consensus takes one member each; rows of a region that one salt of it holds.
MEMBERS, SALT_ROWS = 32, 500

_U = np.uint64
_STEP, _LEVEL = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _times(x: np.uint64, k: int) -> np.uint64:
    return _U((int(x) * k) & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles of each text): hashes of ``words`` consecutive lower-case words, sorted within a text.

    A text with fewer words is one shingle; one without words has none.
    """
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    if len(flat) == 0:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    coded = flat.dictionary_encode()
    by_word = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], _U)
    at = coded.indices.to_numpy(zero_copy_only=False)
    hashed = by_word[at]
    if len(empty := np.flatnonzero(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False))):
        keep = at != empty[0]
        counts = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(np.cumsum(counts) - counts, len(keep))) * (counts > 0)
        hashed = hashed[keep]
    begin = np.cumsum(counts) - counts
    full = np.maximum(counts - words + 1, 0)
    start = ragged(begin, full)
    found = np.zeros(len(start), _U)
    for j in range(words):
        found += hashed[start + j] * _PLACES[j % len(_PLACES)] if words <= len(_PLACES) else mix64(hashed[start + j] + _times(_STEP, j))
    found = mix64(found)
    sizes = full.copy()
    brief = np.flatnonzero((counts > 0) & (counts < words))
    if len(brief):
        short = np.array([xxhash.xxh64_intdigest(hashed[begin[i] : begin[i] + counts[i]].tobytes()) for i in brief], _U)
        sizes[brief] = 1
        place = np.cumsum(sizes) - sizes
        merged = np.empty(int(sizes.sum()), _U)
        is_brief = np.zeros(len(merged), bool)
        is_brief[place[brief]] = True
        merged[is_brief], merged[~is_brief] = short, found
        found = merged
    doc = np.repeat(np.arange(len(counts)), sizes)
    return found[np.lexsort((found, doc))], sizes


def bag_minhash(hashes: np.ndarray, sizes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Least times of Poisson processes, one row of registers for each text; equal with probability weighted Jaccard.

    The weight of a shingle is its count. Weights are cut into the dyadic levels (0,1], (1,2], (2,4] ..., each a
    Poisson process whose rate is its width and whose points carry a register and a place within the level. A text has
    the points below its weight, so that a level it fills only in part keeps part of the points. Processes run in time
    order until their next point comes after the largest register of their text. Texts without shingles keep infinity.
    """
    n = len(sizes)
    out = np.full((n, registers), np.inf)
    if len(hashes) == 0:
        return out
    doc = np.repeat(np.arange(n), sizes)
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(hashes)))
    nodes = []
    low, level, left = 0, 0, at
    while len(left):
        width = max(1, low)
        nodes.append((doc[left], mix64(hashes[left] + _times(_LEVEL, level + 1)), np.full(len(left), float(width)), np.minimum(weight - low, width).astype(float)))
        low, level = low + width, level + 1
        more = weight > low
        left, weight = left[more], weight[more]
    d, seed, rate, filled = (np.concatenate(x) for x in zip(*nodes, strict=True))
    time = np.zeros(len(d))
    flat, k = out.reshape(-1), 0
    while len(d):
        point = mix64(seed + _times(_STEP, k + 1))
        time = time - np.log(unit(point)) / rate
        alive = time < out.max(axis=1)[d]
        d, seed, rate, filled, time, point = d[alive], seed[alive], rate[alive], filled[alive], time[alive], point[alive]
        second = mix64(point ^ _LEVEL)
        register = ((second >> _U(32)) * _U(registers)) >> _U(32)
        inside = (rate == filled) | (unit(mix64(second)) * rate < filled)
        np.minimum.at(flat, d[inside] * registers + register[inside].astype(np.int64), time[inside])
        k += 1
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(_U).reshape(len(signature), BANDS, BAND_ROWS)
    keys = (mix64(bits) * _PLACES[:BAND_ROWS]).sum(axis=2, dtype=_U) + np.arange(1, BANDS + 1, dtype=_U) * _STEP
    return mix64(keys)


def _texts(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes of text, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = hashes.tobytes(), 8 * np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(raw[e - 8 * s : e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _texts(batches):
        hashes, sizes = shingles(b.column("text"))
        bags = _digests(hashes, sizes)
        keys = _band_keys(bag_minhash(hashes, sizes)).view(np.int64)
        filled = sizes > 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * BANDS)]), pa.int32()), pa.array(keys[filled].reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bags, pa.binary()), pa.array(sizes, pa.int32()), lists], ["doc_id", "bag", "n", "bands"])
    trim()


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multisets as sets: the k-th copy of a shingle is an element of its own."""
    for b in _texts(batches):
        hashes, sizes = shingles(b.column("text"))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(first)
        copy = np.arange(len(hashes)) - np.repeat(start, np.diff(np.append(start, len(hashes))))
        elements = mix64(hashes + copy.astype(_U) * _STEP).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(elements))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_digests(hashes, sizes), pa.binary()), lists], ["rep", "bag", "elements"])
    trim()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, by least labels and pointer jumps."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    n = labels.count()
    while True:
        near = lookup(both, labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = cut(narrow(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "near").alias("new"), F.col("root").alias("old")), n))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        now = cut(narrow(lookup(step, jump, "new").select("node", F.least("new", "far").alias("root"), "old"), n))
        labels = now.select("node", "root")
        if now.filter("root <> old").isEmpty():
            return labels


def _joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes after more edges: the components of the classes' roots."""
    rows = edges.count()
    for side in ("a", "b"):
        named = classes.select(F.col("node").alias(side), F.col("root").alias("_r"))
        edges = cut(narrow(lookup(edges, named, side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r"), rows))
    between = edges.filter("a <> b")
    if between.isEmpty():
        return classes
    roots = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    every = settled(classes.unionByName(roots.select(F.col("root").alias("node"), "root").join(classes, "node", "left_anti")))
    return settled(lookup(every, roots, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b, j) of the pairs: the exact overlap of their multisets over the size of their union."""
    right = bags.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    left = bags.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("ea", "eb")).cast("double")
    return both.select("a", "b", (shared / (F.size("ea") + F.size("eb") - shared)).alias("j"))


def _alike(n: str, m: str):
    """Sizes at which two multisets can reach the threshold."""
    return F.least(n, m) >= F.greatest(n, m) * THRESHOLD


def _rooted(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _regions(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (main, node, n): a bucket that holds several classes belongs to the region of the one with the most rows."""
    placed = _rooted(buckets, classes)
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return settled(placed.join(mixed.select("key", F.col("m.root").alias("main")), "key").select("main", "node", "n", (F.col("root") == F.col("main")).alias("member")).distinct())


def _consensus(rows: DataFrame, bags: DataFrame) -> DataFrame:
    """(main, common): the elements that at least half of some members of a region's main class have."""
    chosen = rows.filter("member").groupBy("main", F.pmod(F.xxhash64("node"), F.lit(MEMBERS)).alias("slot")).agg(F.min("node").alias("node"))
    counted = chosen.join(bags, "node").select("main", F.explode("elements").alias("e")).groupBy("main", "e").agg(F.count(F.lit(1)).alias("c"))
    asked = chosen.groupBy("main").agg(F.count(F.lit(1)).alias("members"))
    return counted.join(asked, "main").filter(F.col("c") * 2 >= F.col("members")).groupBy("main").agg(F.collect_list("e").alias("common"))


def _differences(rows: DataFrame, bags: DataFrame) -> DataFrame:
    """(main, node, n, diff, slack): where a multiset differs from its region's consensus.

    With D the difference, |x ^ y| <= |Dx| + |Dy|, and J >= 0.8 holds just if 9 |x ^ y| <= nx + ny. The slack is
    n - 9 |D|: two rows whose slacks sum to 0 or more are linked for certain, others just if 18 |Dx & Dy| makes up for
    what is missing. Large regions are salted.
    """
    wide = rows.groupBy("main").agg(F.floor(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("last"))
    common = _consensus(rows, bags).join(wide, "main").withColumn("salt", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    salted = lookup(rows, wide, "main").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    both = salted.join(bags, "node").join(common, ["main", "salt"])
    diff = F.concat(F.array_except("elements", "common"), F.array_except("common", "elements"))
    return cut(both.select("main", "node", "n", diff.alias("diff")).withColumn("slack", F.col("n") - WHOLE * F.size("diff")))


def _certain(diffs: DataFrame) -> DataFrame:
    """Links (a, b) of every row to the one nearest to its region's consensus where the slacks suffice: what slacks
    link at all is connected by these."""
    top = diffs.groupBy("main").agg(F.max_by("node", F.struct("slack", "node")).alias("top"), F.max("slack").alias("most"))
    return settled(lookup(diffs.select("main", "node", "slack"), top, "main").filter((F.col("slack") + F.col("most") >= 0) & (F.col("node") != F.col("top"))).select(F.col("top").alias("a"), F.col("node").alias("b")))


def _uncertain(diffs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes of a region that need common differences.

    One side is always outside the class of the region's nearest row. A pair must share so many differences that each
    side's rarest ones hold one of them (a prefix filter); differences that no other class can share are left out.
    Every surviving pair is counted exactly.
    """
    rows = settled(_rooted(diffs.select("main", "node", "slack"), classes))
    top = rows.groupBy("main").agg(F.max_by("root", F.struct("slack", "node")).alias("core"), F.max("slack").alias("most"))
    placed = settled(lookup(rows, top, "main").withColumn("outside", F.col("root") != F.col("core")))
    limits = placed.filter("outside").groupBy("main").agg(F.max("slack").alias("out"))
    other = F.when(F.col("outside"), F.col("most")).otherwise(F.col("out"))
    need = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + other) / (2 * WHOLE))).cast("int")
    held = settled(lookup(placed, limits, "main").select("main", "node", "root", "slack", "outside", need.alias("need")))
    if held.isEmpty():
        return held.select(F.col("node").alias("a"), F.col("node").alias("b"))
    single = held.join(diffs.select("main", "node", "diff"), ["main", "node"]).select("main", "node", "root", "slack", "outside", "need", F.explode("diff").alias("e"))
    shared = single.groupBy("main", "e").agg(F.count(F.lit(1)).alias("f"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.max("outside").alias("o")).filter("f > 1 AND r1 <> r2 AND o").select("main", "e", "f")
    usable = single.join(shared, ["main", "e"]).groupBy("main", "node", "root", "slack", "outside", "need").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("u"))
    ahead = usable.filter(F.size("u") >= F.col("need")).select("main", "node", "root", "slack", "outside", F.size("u").alias("size"), F.posexplode(F.slice("u", F.lit(1), F.size("u") - F.col("need") + 1)).alias("i", "s"))
    lists = cut(ahead.select("main", F.col("s.e").alias("e"), "node", "root", "slack", "outside", (F.col("size") - F.col("i")).alias("rest")))
    a = lists.filter("outside").select("main", "e", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("slack").alias("sa"), F.col("rest").alias("ta"))
    b = lists.select("main", "e", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("slack").alias("sb"), F.col("rest").alias("tb"), F.col("outside").alias("ob"))
    once = ~F.col("ob") | (F.col("a") < F.col("b"))
    enough = F.least("ta", "tb") * (2 * WHOLE) >= -(F.col("sa") + F.col("sb"))
    pairs = a.join(b, (a.main == b.main) & (a.e == b.e) & (F.col("ra") != F.col("rb")) & once & enough).select(a.main, "a", "b", "sa", "sb").distinct()
    left, right = (diffs.select("main", F.col("node").alias(x), F.col("diff").alias(f"d{x}")) for x in "ab")
    counted = pairs.join(left, ["main", "a"]).join(right, ["main", "b"])
    return settled(counted.filter(F.size(F.array_intersect("da", "db")) * (2 * WHOLE) >= -(F.col("sa") + F.col("sb"))).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for every row.

    Texts with a weighted Jaccard similarity of 0.8 or more over five-word shingles (words between white space, lower
    case, counted with their copies) are linked, and a class is what links connect. Null, empty and blank texts have
    no shingles and are one class; texts of fewer than five words are one shingle. Repeated rows share a class, and
    texts with one doc_id are linked, as they are one document; a row with a null doc_id has the class of its text's
    other rows, or none; an empty table gives no rows; other columns are not read.

    Texts with equal shingles are one node. In every bucket of a band all nodes are compared with the bucket's least
    one. Buckets that then hold several classes form regions, in which nodes are compared by where they differ from
    the consensus of the region's largest class: that takes no row for each pair in a large group of near copies.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(docs.sparkSession, BATCH_ROWS):
        signed = cut(source.mapInArrow(_sign, "doc_id long, bag binary, n int, bands array<bigint>"))
    reps = cut(signed.groupBy("bag").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    # a doc_id may be the least one of several texts: all but one of these are nodes by their digest
    twice = cut(reps.filter("rep IS NOT NULL").groupBy("rep").agg(F.min("bag").alias("own"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("rep", "own"))
    several = not twice.isEmpty()

    def with_node(rows: DataFrame) -> DataFrame:
        if not several:
            return rows.withColumn("node", F.col("rep"))
        node = F.when(F.col("own").isNull() | (F.col("own") == F.col("bag")), F.col("rep")).otherwise(F.xxhash64("bag"))
        return rows.join(twice, "rep", "left").withColumn("node", node).drop("own")

    reps = with_node(reps)
    members = signed.select("doc_id", "bag").join(reps.select("bag", "node"), "bag").select("doc_id", "node")
    versions = cut(members.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a"))

    rows = reps.filter("rep IS NOT NULL").select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "pivot")
    buckets = cut(rows.join(shared, "key"))
    ids = buckets.select("node").distinct().join(reps.select("node", "rep"), "node").select("rep").distinct() if several else buckets.select(F.col("node").alias("rep")).distinct()
    texts = source.withColumnRenamed("doc_id", "rep").join(ids, "rep", "left_semi").select(F.col("rep").alias("doc_id"), "text")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        bags = cut(with_node(texts.mapInArrow(_bags, "rep long, bag binary, elements array<bigint>")).select("node", "elements").dropDuplicates(["node"]))

    pivots = reps.select(F.col("node").alias("pivot"), F.col("n").alias("np"))
    stars = buckets.filter("node <> pivot").select("pivot", "node", "n").distinct().join(pivots, "pivot").filter(_alike("n", "np"))
    links = settled(_verified(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")), bags).filter(F.col("j") >= THRESHOLD).select("a", "b"))
    if not versions.isEmpty():
        links = links.unionByName(members.join(versions, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")))
    classes = components(links)
    regions = _regions(buckets, classes)
    if not regions.isEmpty():
        diffs = _differences(regions, bags)
        classes = _joined(classes, _certain(diffs))
        classes = _joined(classes, _uncertain(diffs, classes))
    if several:  # roots may be digests
        classes = classes.join(reps.select("node", "rep"), "node")
        names = classes.groupBy("root").agg(F.min("rep").alias("name"))
        classes = classes.join(names, "root").select("node", F.col("name").alias("root"))
    found = members.join(classes, "node", "left")
    return found.select("doc_id", F.coalesce("root", "node").alias("class_id"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
