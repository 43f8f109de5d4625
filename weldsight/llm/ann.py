"""Approximate nearest neighbours from balanced posting lists."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.llm.common import cut, partitions, table

#: Vectors that centroids are fitted on, centroids, and rows of a list's part, at most.
SAMPLE, CENTROIDS, LIST_ROWS = 20_000, 2048, 10_000
#: Vectors to a centroid at least; copies of a boundary vector at most, how much farther their centroids may be, and
#: how far apart, in distances of the vector.
PER_CENTROID, COPIES, BOUNDARY, APART = 100, 3, 1.15, 0.5
#: Lists whose centroid is up to this many times as far as the nearest are searched; neighbours in the centroid graph.
PROBE, DEGREE = 1.17, 24
#: The lists of a query hold at least ENOUGH times k distinct vectors. Those that hold NEAR times k are searched first,
#: and the others then return only what is nearer. Rows, and queries, that one block compares.
ENOUGH, NEAR, BLOCK = 20, 100, 20_000


@dataclass
class Centroids:
    """Centroids with a graph that links each to its nearest ones, both ways: else none may lead to a distant one."""

    points: np.ndarray
    links: list[np.ndarray]

    def search(self, query: np.ndarray, ratio: float, held: np.ndarray, need: int) -> list[int]:
        """Best-first walk over the graph: the nearest centroids up to the one by which these hold ``need`` vectors,
        and those within ``ratio`` times its distance.

        A query in a tight group that owns a centroid thus measures the ratio by the next one, not by a distance of 0.
        """
        start = np.unique(np.linspace(0, len(self.points) - 1, min(len(self.points), 32)).astype(int))
        dist = dict(zip(start.tolist(), np.sqrt(((self.points[start] - query) ** 2).sum(1)).tolist(), strict=True))
        heap = [(d, c) for c, d in dist.items()]
        heapq.heapify(heap)
        reach, have = math.inf, 0
        while heap:
            d, c = heapq.heappop(heap)
            if d > ratio * reach * 1.05:
                break
            have += held[c]
            if have >= need:
                reach = min(reach, d)
            new = [x for x in self.links[c].tolist() if x not in dist]
            if new:
                for x, far in zip(new, np.sqrt(((self.points[new] - query) ** 2).sum(1)).tolist(), strict=True):
                    dist[x] = far
                    heapq.heappush(heap, (far, x))
        out, reach, have = [], math.inf, 0
        for d, c in sorted((d, c) for c, d in dist.items()):
            if d > ratio * reach:
                break
            out.append(c)
            have += held[c]
            if have >= need:
                reach = min(reach, d)
        return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> Centroids:
    """k-means whose clusters pay for being larger than the mean."""
    rng = np.random.default_rng(seed)
    points = sample[rng.choice(len(sample), k, replace=False)].copy()
    price = np.zeros(k)
    for _ in range(rounds):
        near = np.concatenate([(_squared(sample[i : i + 4096], points) + price).argmin(1) for i in range(0, len(sample), 4096)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(points)
        np.add.at(total, near, sample)
        points = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], sample[rng.choice(len(sample), k)])
        spread = float(np.median(_squared(sample[:1024], points).min(1)))
        price = 0.1 * spread * (size * k / len(sample) - 1)
    degree = min(DEGREE, k - 1)
    between = _squared(points, points)
    np.fill_diagonal(between, np.inf)
    near = np.argsort(between, axis=1)[:, :degree]
    linked = np.zeros((k, k), bool)
    np.put_along_axis(linked, near, True, 1)
    return Centroids(points, [np.flatnonzero(row) for row in linked | linked.T])


def assign(vectors: np.ndarray, centroids: Centroids) -> list[np.ndarray]:
    """Lists of each vector: its nearest, and for boundary vectors others that no chosen one is nearer to."""
    d = np.sqrt(_squared(vectors, centroids.points))
    most = min(2 * COPIES, d.shape[1])
    some = np.argpartition(d, most - 1, axis=1)[:, :most]
    own = np.take_along_axis(d, some, 1)
    order = np.argsort(own, axis=1, kind="stable")
    some, own = np.take_along_axis(some, order, 1), np.take_along_axis(own, order, 1)
    # of the candidates within reach, one is taken if it is not much nearer to a taken one than to the vector
    gap = np.sqrt(((centroids.points[some][:, :, None] - centroids.points[some][:, None]) ** 2).sum(3))
    taken = np.zeros(own.shape, bool)
    taken[:, 0] = True
    for j in range(1, most):
        clear = np.where(taken[:, :j], gap[:, j, :j], np.inf).min(1) > APART * own[:, j]
        taken[:, j] = (own[:, j] <= BOUNDARY * own[:, 0]) & clear & (taken.sum(1) < COPIES)
    return [some[i, t] for i, t in enumerate(taken)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: Distances that are held at a time.
PAIRS = 1 << 21


def _answers(ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, qids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of each query's k nearest in a part: one product for all queries, and exact distances
    for those that it puts near enough."""
    own = (queries * queries).sum(1)
    about = norms - 2 * (queries @ vectors.T)  # squared distances but for the query's own norm
    about[ids == qids[:, None]] = np.inf
    cut_at = bounds * bounds - own
    if len(ids) > k:
        cut_at = np.minimum(cut_at, np.partition(about, k - 1, axis=1)[:, k - 1])
    row, at = np.nonzero((about <= (cut_at + 1e-9 * (own + norms.max()))[:, None]) & np.isfinite(about))
    score = np.sqrt(((vectors[at] - queries[row]) ** 2).sum(1))
    order = np.lexsort((ids[at], score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = (place < k) & (score <= bounds[row])
    return qids[row[kept]], ids[at[kept]], score[kept]


def _closest(k: int, dim: int):
    """The k nearest of a part for each query, and none beyond the query's bound. A part's vectors come before the queries
    that read it; these pass Arrow batch by Arrow batch, so that any number of queries may read a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("list", "part", "asks")])
            starts = np.append(0, np.flatnonzero((np.diff(key) != 0).any(0)) + 1) if b.num_rows else []
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                rows = b.slice(start, end - start)
                ids, v = rows.column("id").to_numpy(), _matrix(rows.column("v"), dim)
                if now != (now := tuple(key[:2, start])):
                    held, part = [], None
                if not key[2, start]:
                    held.append((ids, v))
                    continue
                if part is None and held:
                    part = [np.concatenate(x) for x in zip(*held, strict=True)]
                    part.append((part[1] * part[1]).sum(1))
                bounds = rows.column("bound").to_numpy()
                step = max(1, PAIRS // len(part[0])) if part else 0
                for at in range(0, len(ids), step) if part else ():
                    some = slice(at, at + step)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _answers(*part, ids[some], v[some], bounds[some], k)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean, in doubles): the k nearest found of each query, its own id left out.

    Both frames have vec_id and embedding. Vectors that are null, zero, hold null or non-finite components, or have
    another length than most take no part, nor do null ids; rows that repeat a vec_id are one vector; ties go to the
    smaller vec_id; an empty table gives no rows; other columns are not read. Centroids are fitted on a bounded sample,
    every vector is stored in its lists whole, and lists of more than LIST_ROWS rows are split by vec_id, all parts of
    which a query reads. A query has k rows, or all other vectors if these are fewer: its lists go on until they hold
    ENOUGH times k vectors, and one that still finds fewer than k is compared with all vectors, in blocks. The number of
    lists grows with the root of the vectors. A query's nearest lists bound what its other lists return, so that the
    rows between the two steps do not grow with the lists.
    """
    spark = vectors.sparkSession
    kind = "float" if all(d.schema["embedding"].dataType.simpleString() == "array<float>" for d in (vectors, queries)) else "double"

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding") if kind == "float" else F.transform("embedding", lambda x: x.cast("double"))
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return rows.filter(good)

    stored = usable(vectors)
    lengths = stored.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths[0]["d"], lengths[0]["count"]
    stored = stored.filter(F.size("v") == dim)
    asked = usable(queries).filter(F.size("v") == dim)
    picked = stored.sample(fraction=min(1.0, 1.2 * SAMPLE / n), seed=3) if n > SAMPLE else stored
    sample = np.array([r.v for r in picked.select("v").limit(SAMPLE).collect()])
    model = fit_centroids(sample, max(1, min(CENTROIDS, len(sample) // 8 or 1, n // PER_CENTROID, math.isqrt(n))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in ((b, i) for b in batches for i in range(0, b.num_rows, 2048)):
            b = whole.slice(at, 2048)
            lists = assign(_matrix(b.column("v"), dim), model)
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64))
            which = pa.array(np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32))
            own = pa.array([i == 0 for x in lists for i in range(len(x))], pa.bool_())
            yield pa.RecordBatch.from_arrays([which, b.column("vec_id").take(at), b.column("v").take(at), own], ["list", "vec_id", "v", "own"])

    postings = cut(stored.mapInArrow(post, f"list int, vec_id long, v array<{kind}>, own boolean"))
    # CENTROIDS rows at most; a vector counts as held by its nearest centroid's list alone
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("count"), F.count_distinct(F.when(F.col("own"), F.col("vec_id"))).alias("held")).collect()
    held = np.zeros(len(model.points), np.int64)
    held[[r["list"] for r in sizes]] = [r["held"] for r in sizes]
    need = ENOUGH * k + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [model.search(q, PROBE, held, need) for q in _matrix(b.column("v"), dim)]
            first = [c for x in lists for c in (np.cumsum(held[x]) - held[x] < NEAR * k).tolist()]
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64))
            which = pa.array([c for x in lists for c in x], pa.int32())
            yield pa.RecordBatch.from_arrays([which, b.column("vec_id").take(at), b.column("v").take(at), pa.array(first, pa.bool_())], ["list", "query_id", "v", "first"])

    parts = F.broadcast(spark.createDataFrame([(r["list"], math.ceil(r["count"] / LIST_ROWS)) for r in sizes], "list int, parts int"))
    left = postings.drop("own").join(parts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    probed = cut(asked.mapInArrow(probe, f"list int, query_id long, v array<{kind}>, first boolean"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def search(stored_: DataFrame, asked_: DataFrame) -> DataFrame:
        rows = stored_.select("list", "part", F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("bound"))
        both = rows.unionByName(asked_.select("list", "part", F.lit(1).alias("asks"), F.col("query_id").alias("id"), "v", "bound"))
        ordered = both.repartition("list", "part").sortWithinPartitions("list", "part", "asks")
        return ordered.mapInArrow(_closest(k, dim), "query_id long, vec_id long, score double")

    def in_lists(asked_: DataFrame) -> DataFrame:
        each = asked_.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return search(left, each.select("list", "part", "query_id", "v", "bound"))

    nearest_lists = cut(in_lists(probed.filter("first").withColumn("bound", F.lit(float("inf")))))
    bounds = ranked(nearest_lists).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    others = probed.filter("not first").join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    best = cut(ranked(nearest_lists.unionByName(in_lists(others))))
    full = best.groupBy("query_id").count().filter(F.col("count") >= k)
    short = cut(asked.withColumnRenamed("vec_id", "query_id").withColumn("bound", F.lit(float("inf"))).join(full, "query_id", "left_anti"))
    few = short.count()
    if not few:
        return best
    blocks, turns = max(partitions(spark), math.ceil(n / BLOCK)), math.ceil(few / BLOCK)
    every = stored.withColumn("list", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    each = short.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return best.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(ranked(search(every, each)))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
