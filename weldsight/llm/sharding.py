"""Shards of even size that keep linked documents together, by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.llm.common import MANY, cut, partitions, slots, table

SHARDS, ROUNDS = 16, 6
#: Share by which quotas are exceeded in the first round; rows beyond a shard's size move on at the end.
SLACK = 0.1
#: Parts of a shard in which rows are numbered; rows of a cell from which it is salted over a quarter of these.
BUCKETS, HOT = 1024, 32


def _loads(state: DataFrame, label: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in state.groupBy(label).agg(F.sum("n")).collect()}  # one row for each shard
    return [int(found.get(s, 0)) for s in range(shards)]


def _accepted(demand: dict[tuple[int, int, int], int], load: list[int], most: int) -> list[tuple[int, int, int, float]]:
    """(label, target, level, share): how much of each demand its target takes, the strongest levels first.

    What leaves a shard makes room in it, so that demands are gone through until no more can move.
    """
    left, taken = dict(demand), dict.fromkeys(demand, 0)
    moved = True
    while moved:
        moved = False
        for key in sorted(left, key=lambda k: (-k[2], k[1], k[0])):
            label, target, _ = key
            n = min(left[key], most - load[target])
            if n > 0:
                load[target] += n
                load[label] -= n
                left[key] -= n
                taken[key] += n
                moved = True
    return [(*key, taken[key] / n) for key, n in demand.items() if taken[key]]


def propagate(cells: DataFrame, quota: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Moves linked rows to the shard where most of their neighbours are, as far as quotas allow.

    ``cells`` has a row (hub, home, n) for the n rows that hang on a hub and start in shard ``home``: rows of a cell
    have the same links and move together. Each round joins the cells to their hub's tally by shard; cells propose the
    shard with the most neighbours, and a shard takes proposals by gain until its quota of linked rows is full; what
    leaves a shard makes room. The driver sees the demand by label, target and level of gain (a power of two), and
    answers with the share that is taken of each: shards x shards x 64 rows at most, joined as a table. Of a level that
    is taken in part, cells are drawn by hash. Returns hub, home, n, label.
    """
    spark = cells.sparkSession
    state = cut(cells.withColumn("label", F.col("home")))
    level = F.floor(F.log2(F.col("gain").cast("double") + 1)).cast("int")
    for turn in range(rounds):
        # quotas are loose at first, so that full shards can exchange rows, and every other round full ones draw none
        load = _loads(state, "label", shards)
        most = int(quota * (1 + SLACK * (rounds - 1 - turn) / max(1, rounds - 1)))
        full = [s for s in range(shards) if load[s] >= most] if turn % 2 else []
        tally = state.groupBy("hub", "label").agg(F.sum("n").alias("m"))
        wanted = F.when(F.col("label").isin(full), 0).otherwise(F.col("m")) if full else F.col("m")
        best = tally.groupBy("hub").agg(F.max(F.struct(wanted.alias("m"), F.xxhash64("hub", "label").alias("tie"), "label")).alias("best")).select("hub", F.col("best.label").alias("target"), F.col("best.m").alias("there"))
        here = state.join(tally.withColumnRenamed("m", "here"), ["hub", "label"]).join(best, "hub")
        moves = here.withColumn("gain", F.greatest(F.col("there") - F.col("here"), F.lit(0)) + 1).withColumn("level", level)
        proposals = cut(moves.select("hub", "home", "n", "label", F.when(F.col("there") > 0, F.col("target")).otherwise(F.col("label")).alias("target"), "level"))
        demand = proposals.filter("target <> label").groupBy("label", "target", "level").agg(F.sum("n").alias("n")).collect()
        taken = _accepted({(r.label, r.target, r.level): r.n for r in demand}, load, most)
        if not taken:
            continue
        answer = F.broadcast(spark.createDataFrame(taken, "label int, target int, level int, share double"))
        draw = F.pmod(F.xxhash64("hub", "home", F.lit(turn)), F.lit(1 << 20)) / (1 << 20)
        answered = proposals.join(answer, ["label", "target", "level"], "left")
        state = cut(answered.select("hub", "home", "n", F.when(draw < F.col("share"), F.col("target")).otherwise(F.col("label")).alias("label")))
    return state


def cut_share(rows: DataFrame) -> float:
    """Share of the linked rows (hub, shard) that are not where most of their hub's rows are."""
    by = rows.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    found = by.filter("all > 1").agg(F.sum("all").alias("all"), F.sum("most").alias("most")).first()
    return 1 - found.most / found.all if found.all else 0.0


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """A shard and a gapless slot for each row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: the shards' counts are at most one apart. Equal texts are linked; propagation brings them together
    under the quota of the smallest shard, so that a group is split only where it does not fit. Rows without links
    fill what is left. Null and empty texts are one group of size 1; repeated rows get slots of their own; a null
    doc_id is a row like any other; an empty table gives no rows; other columns are not read.

    Shards are numbered within BUCKETS parts each, and a group of HOT rows in a cell is salted over a quarter of them.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hub = F.unhex(F.md5(F.col("text").cast("binary")))
    rows = cut(raw.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), hub.alias("hub"))
               .withColumn("home", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(shards)).cast("int")))
    total = rows.count()
    cells = rows.groupBy("hub", "home").agg(F.count(F.lit(1)).alias("n"))
    linked = cells.groupBy("hub").agg(F.sum("n").alias("_all")).filter("_all > 1").select("hub", "_all")
    state = propagate(cells.join(linked, "hub").select("hub", "home", "n"), total // shards, shards, rounds)

    # cells with over a quarter of a partition's share, 4 for each partition at most, are looked up in a broadcast table
    key, least = ["hub", "home"], max(MANY, total // (4 * partitions(docs.sparkSession)) + 1)
    known = cut(state.select(*key, "n", "label"))
    large = F.broadcast(known.filter(F.col("n") >= least))
    labelled = rows.join(large, key).unionByName(rows.join(large.select(*key), key, "left_anti").join(known, key, "left"))
    salt = F.when(F.col("n") >= HOT, F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS // 4))).otherwise(0)
    part = F.pmod(F.xxhash64("hub") + salt, F.lit(BUCKETS)).cast("int") + F.when(F.col("n").isNull(), BUCKETS).otherwise(0)
    placed = cut(slots(labelled.withColumn("label", F.coalesce("label", "home")), "label", part, [F.asc("hub"), F.asc("doc_id"), F.asc("size")], "place").drop("n", "home"))

    load = {r[0]: r[1] for r in placed.groupBy("label").count().collect()}  # one row for each shard
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    # rows beyond a shard's size are numbered one after the other and fill the shards that have room
    before, free, at, room = [0] * shards, [], 0, 0
    for s in range(shards):
        spare = wanted[s] - load.get(s, 0)
        if spare < 0:
            before[s], at = at, at - spare
        elif spare > 0:
            free.append((room, s, load.get(s, 0) - room))
            room += spare
    limits = F.array(*[F.lit(w).cast("long") for w in wanted])[F.col("label")]
    offset = F.array(*[F.lit(b).cast("long") for b in before])[F.col("label")]
    moved = placed.withColumn("_beyond", F.when(F.col("place") >= limits, F.col("place") - limits + offset))
    if not free:
        free = [(0, 0, 0)]
    firsts, into, shift = (F.array(*[F.lit(f[i]).cast("long") for f in free]) for i in range(3))
    gap = F.size(F.filter(firsts, lambda x: x <= F.col("_beyond"))) - 1
    to = F.when(F.col("_beyond").isNull(), F.col("label")).otherwise(F.get(into, gap))
    slot = F.when(F.col("_beyond").isNull(), F.col("place")).otherwise(F.get(shift, gap) + F.col("_beyond"))
    return moved.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
