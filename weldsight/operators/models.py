"""Detectors: isolation forest, principal components, boosted trees; attribution of a score to features."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trees, rows of a tree's sample, and seed of the isolation forest.
TREES, SAMPLE, SEED = 300, 256, 42
TREE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int"


def _depth(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """A forest's nodes as arrays, all trees one after the other; leaves lead to themselves.

    It is pickled compressed: TREES trees of SAMPLE rows come to under 1 MB, above which Spark would send a function as a
    broadcast variable, which stateful stream processors cannot read on the driver.
    """

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        start = nodes.groupby("tree").cumcount().to_numpy()  # place in the tree
        here = np.arange(len(nodes))
        leaf = nodes["feature"].to_numpy() < 0
        left, right = (np.where(leaf, 0, nodes[c] - start) for c in ("left", "right"))  # as steps from the node
        self.__setstate__((np.flatnonzero(start == 0), nodes["feature"].to_numpy(), left, right, nodes["size"].to_numpy(), nodes["split"].to_numpy(float)[here[~leaf]]))

    def __getstate__(self) -> tuple:
        here, inner = np.arange(len(self.left)), self.left != np.arange(len(self.left))
        parts = (self.roots, np.where(inner, self.feature, -1), self.left - here, self.right - here, self.size)
        return (*[zlib.compress(x.astype("<i4").tobytes(), 9) for x in parts], self.split[inner].astype("<f8").tobytes())

    def __setstate__(self, state: tuple) -> None:
        if isinstance(state[0], bytes):
            state = (*[np.frombuffer(zlib.decompress(x), "<i4") for x in state[:5]], np.frombuffer(state[5], "<f8"))
        self.roots, feature, left, right, self.size, split = state
        here, leaf = np.arange(len(feature)), feature < 0
        self.feature, self.left, self.right = np.where(leaf, 0, feature).astype(np.int32), here + left, here + right
        self.split = np.zeros(len(here))
        self.split[~leaf] = split
        depth = np.zeros(len(here))
        for i in here[~leaf]:  # parents come before children
            depth[self.left[i]] = depth[self.right[i]] = depth[i] + 1
        self.levels = int(depth.max(initial=0))
        self.depth = depth + np.where(leaf, [_depth(n) for n in self.size], 0.0)
        self.expected = max(sum(_depth(n) for n in self.size[self.roots]), 1e-9)

    def score(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """2 to the minus mean depth over the expected depth, for each row of ``x``."""
        out = []
        for part in (x[at : at + rows] for at in range(0, len(x), rows)):
            here = np.repeat(self.roots[:, None], len(part), axis=1)
            own = np.arange(len(part))[None, :]
            for _ in range(self.levels):
                here = np.where(part[own, self.feature[here]] < self.split[here], self.left[here], self.right[here])
            out.append(2.0 ** (-self.depth[here].sum(0) / self.expected))
        return np.concatenate(out) if out else np.zeros(0)


def iforest_fit(rows: DataFrame, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """The forest as a table of nodes. Each tree takes its rows by a seeded hash of ``key``, which names a row (the
    features if it is not given, so that equal rows go together), so that every row is looked at once and a tree's group
    holds about twice ``sample`` rows, and is grown in the task that has them."""
    share = min(1.0, 2.0 * sample / max(1, rows.count()))
    named = F.xxhash64(*[F.col(c) for c in key or features])
    picks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("int").alias("tree"), F.pmod(F.xxhash64(named, t, F.lit(seed)), F.lit(1_000_000_007)).alias("rank"))), lambda s: s["rank"] < int(1_000_000_007 * share))
    drawn = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.explode(picks).alias("p")).select("p.*", *[f"x{i}" for i in range(len(features))])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["rank", *[c for c in pdf.columns if c.startswith("x")]]).drop(columns=["tree", "rank"]).to_numpy()[:sample]
        rng, out = np.random.default_rng(seed * 100_003 + tree), []
        limit = math.ceil(math.log2(max(2, len(x))))

        def split(rows_: np.ndarray, depth: int) -> int:
            at = len(out)
            out.append(None)
            low, high = rows_.min(0), rows_.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(rows_) <= 1 or not len(wide):
                out[at] = (tree, at, -1, 0.0, -1, -1, len(rows_))
                return at
            f = int(rng.choice(wide))
            s = float(rng.uniform(low[f], high[f]))
            side = rows_[:, f] < s
            if side.all() or not side.any():  # neighbouring doubles
                out[at] = (tree, at, -1, 0.0, -1, -1, len(rows_))
                return at
            out[at] = (tree, at, f, s, split(rows_[side], depth + 1), split(rows_[~side], depth + 1), len(rows_))
            return at

        split(x, 0)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "left", "right", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def collected(forest: DataFrame) -> Forest:
    """The forest on the driver: TREES times twice SAMPLE nodes at most."""
    return Forest(forest.toPandas())


def iforest_score(rows: DataFrame, features: list[str], forest: DataFrame | Forest, name: str = "score") -> DataFrame:
    """The forest's score of every row, by Arrow batches."""
    grown = forest if isinstance(forest, Forest) else collected(forest)

    @F.pandas_udf("double")
    def score(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in columns:
            yield pd.Series(grown.score(np.column_stack([c.to_numpy(float) for c in batch])))

    return rows.withColumn(name, score(*[F.col(c).cast("double") for c in features]))


def forest_table_score(rows: DataFrame, nodes: DataFrame, key: list[str], features: list[str], depth: int) -> DataFrame:
    """Mean leaf depth by walking a small forest's table: one broadcast join for each level."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    small = F.broadcast(nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "feature", "split", "left", "right"))
    walk = rows.select(*key, x.alias("x")).join(F.broadcast(nodes.select("tree").distinct())).withColumn("at", F.lit(0)).withColumn("d", F.lit(0))
    for _ in range(depth):
        step = walk.join(small, (F.col("tree") == F.col("_t")) & (F.col("at") == F.col("_n")))
        inner = F.col("feature") >= 0
        down = F.when(F.element_at("x", F.greatest(F.col("feature"), F.lit(0)) + 1) < F.col("split"), F.col("left")).otherwise(F.col("right"))
        walk = step.select(*key, "x", "tree", F.when(inner, down).otherwise(F.col("at")).alias("at"), (F.col("d") + inner.cast("int")).alias("d"))
    return walk.groupBy(*key).agg(F.avg(F.col("d").cast("double")).alias("mean_depth"))


def pca_fit(rows: DataFrame, features: list[str], components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading axes from one aggregate of moments; the matrix is as large as the features squared."""
    d = len(features)
    sums = [F.sum(F.col(c).cast("double")) for c in features]
    products = [F.sum(F.col(features[i]).cast("double") * F.col(features[j]).cast("double")) for i in range(d) for j in range(i, d)]
    row = rows.agg(F.count(F.lit(1)), *sums, *products).first()
    n, mean = row[0], np.array(row[1 : d + 1], float) / row[0]
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = np.array(row[d + 1 :], float) / n
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    return mean, vectors[:, np.argsort(values)[::-1][:components]].T


def pca_score(rows: DataFrame, features: list[str], mean: np.ndarray, axes: np.ndarray, name: str = "score") -> DataFrame:
    """Norm of what the leading axes leave, as column expressions."""
    centred = [F.col(c).cast("double") - float(m) for c, m in zip(features, mean, strict=True)]
    total = sum((x * x for x in centred), F.lit(0.0))
    for axis in axes:
        along = sum((x * float(a) for x, a in zip(centred, axis, strict=True)), F.lit(0.0))
        total = total - along * along
    return rows.withColumn(name, F.sqrt(F.greatest(total, F.lit(0.0))))


def gbt_bound(rows: DataFrame, features: list[str], label: str, trees: int = 10, seed: int = SEED) -> tuple[DataFrame, dict[str, float]]:
    """Supervised upper bound: boosted trees' probability for each row, and gain shares of the features."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=3, seed=seed).fit(vectors)
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*rows.columns, "score"), dict(zip(features, model.featureImportances.toArray().tolist(), strict=True))


def trigger_classifier(rows: DataFrame, features: list[str], label: str, machine: str = "gun", folds: int = 8) -> DataFrame:
    """Adds ``score``: the probability that a trigger is a true one, from a model that has not seen its machine.

    Machines are dealt to folds by a digest; each fold is scored by a logistic regression on the others. Where those have
    one kind of label alone, or no rows, the score is their share of it (null without rows).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    dealt = rows.withColumn("_fold", F.pmod(F.xxhash64(F.col(machine).cast("string")), F.lit(folds)))
    vectors = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(dealt)
    sides = {r["_fold"]: (r["p"], r["n"]) for r in vectors.groupBy("_fold").agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).collect()}  # a row a fold
    out = None
    for fold in sides:
        p, n = (sum(v[i] for k, v in sides.items() if k != fold) for i in (0, 1))
        own = vectors.filter(F.col("_fold") == fold)
        if 0 < p < n:
            model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.1).fit(vectors.filter(F.col("_fold") != fold))
            scored = model.transform(own).withColumn("score", vector_to_array("probability")[1])
        else:
            scored = own.withColumn("score", F.lit(p / n if n else None).cast("double"))
        scored = scored.select(*rows.columns, "score")
        out = scored if out is None else out.unionByName(scored)
    return rows.withColumn("score", F.lit(None).cast("double")) if out is None else out


def attribution(rows: DataFrame, features: list[str], reference: DataFrame, score, key: list[str], k: int = 8) -> DataFrame:
    """Top features of each row: how much its score falls with the feature at its reference. ``score`` maps columns by
    name to a score; shares are of the positive contributions."""
    wide = rows.join(F.broadcast(reference.select(*[F.col(c).alias(f"_r_{c}") for c in features])))
    own = {c: F.col(c) for c in features}
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"_r_{c}").alias("reference"), (score(own) - score(own | {c: F.col(f"_r_{c}")})).alias("contribution")) for c in features]
    long = wide.select(*key, F.explode(F.array(*parts)).alias("p")).select(*key, "p.*")
    by = Window.partitionBy(*key)
    gain = F.greatest(F.col("contribution"), F.lit(0.0))
    total = F.sum(gain).over(by)
    ranked = long.withColumn("share", gain / F.when(total > 0, total).otherwise(1.0)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("contribution"), "feature")))
    return ranked.filter(F.col("rank") <= k)


def sum_of(columns: list[Column]) -> Column:
    return sum(columns, F.lit(0.0))
