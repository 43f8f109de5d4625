"""From raw readings to an aligned, filled and segmented series. Keys: gun, and slot as its grid step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weldsight.config import Profile

#: Slots of the grid that a row lays out.
BLOCK = 4096


def by_gun(order: str = "slot"):
    return Window.partitionBy("gun").orderBy(order)


def past(order: str = "slot"):
    return by_gun(order).rowsBetween(Window.unboundedPreceding, 0)


def whole(order: str = "slot"):
    return by_gun(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def dedup_last(readings: DataFrame) -> DataFrame:
    """The last arrival of each gun and slot: an aggregate, so that repeats combine before the shuffle."""
    rest = [c for c in readings.columns if c not in ("gun", "slot")]
    last = readings.groupBy("gun", "slot").agg(F.max_by(F.struct(*rest), F.struct("us", "event_id")).alias("r"))
    return last.select("gun", "slot", "r.*")


def grid_align(rows: DataFrame) -> DataFrame:
    """Every slot from a gun's first to its last, absent ones null, with a flag for those present. Slots are laid out in
    blocks, so that no row holds a gun's whole span."""
    span = rows.groupBy("gun").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.first("class").alias("class"))
    blocks = span.select("*", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor(F.col("b") / BLOCK))).alias("_block"))
    grid = blocks.select("gun", "class", F.explode(F.sequence(F.greatest("a", F.col("_block") * BLOCK), F.least("b", F.col("_block") * BLOCK + (BLOCK - 1)))).alias("slot"))
    joined = grid.join(rows.drop("class").withColumn("_here", F.lit(1)), ["gun", "slot"], "left")
    return joined.withColumn("present", F.coalesce("_here", F.lit(0))).drop("_here")


def carry_code(grid: DataFrame) -> DataFrame:
    """A state code holds until the next one, over any gap."""
    return grid.withColumn("code", F.coalesce(F.last("code", True).over(past()), F.lit("0")))


def bounded_fill(grid: DataFrame, limit: int, columns: tuple[str, ...] = ("value", "k", "nw", "buys")) -> DataFrame:
    """Gaps up to ``limit`` slots keep the last reading; longer ones are removed whole."""
    island = grid.withColumn("_island", F.sum("present").over(past()))
    gap = F.count(F.lit(1)).over(Window.partitionBy("gun", "_island")) - 1
    held = island.withColumn("_gap", gap).select("*", *[F.last(c, True).over(past()).alias(f"_{c}") for c in columns])
    kept = held.filter((F.col("present") == 1) | (F.col("_gap") <= limit))
    return kept.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in grid.columns])


def segments(rows: DataFrame) -> DataFrame:
    """A new segment wherever more than one slot lies between neighbours."""
    step = F.col("slot") - F.lag("slot").over(by_gun())
    return rows.withColumn("_new", F.when(step > 1, 1).otherwise(0)).withColumn("segment", F.sum("_new").over(past())).drop("_new")


def last_segment(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("gun").agg(F.max("segment").alias("segment"))
    return rows.join(newest, ["gun", "segment"], "left_semi")


def carry_non_welding(rows: DataFrame, columns: tuple[str, ...] = ("value", "k")) -> DataFrame:
    """Readings while not welding are blank; the last welding one stands in, before the first the next.

    Where none came before, the next is the first of the whole series: a frame that is computed once, not for each row.
    """
    blank = rows.select("*", *[F.when(~F.col("nw"), F.col(c)).alias(f"_{c}") for c in columns])
    carried = [F.coalesce(F.last(f"_{c}", True).over(past()), F.first(f"_{c}", True).over(whole())).alias(f"_{c}") for c in columns]
    both = blank.select(*rows.columns, *carried)
    return both.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def label(rows: DataFrame, profile: Profile) -> DataFrame:
    """Seconds to the gun's last slot, and whether they are within the label window (inclusive)."""
    ttf = (F.max("slot").over(Window.partitionBy("gun")) - F.col("slot")) * profile.slot_s
    return rows.withColumn("ttf_s", ttf).withColumn("label", (ttf <= profile.label_s).cast("int"))


def shaped(readings: DataFrame, profile: Profile) -> DataFrame:
    """All of the above in order, on one partitioning by gun."""
    filled = bounded_fill(carry_code(grid_align(dedup_last(readings))), profile.gap_slots)
    return label(carry_non_welding(segments(filled)), profile)
