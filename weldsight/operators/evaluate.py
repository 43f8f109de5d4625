"""Metrics of scored windows, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weldsight.config import Profile


def _sides(scored: DataFrame) -> DataFrame:
    """pos: labelled; negatives are neither labelled nor in an error state; others take no part."""
    return scored.withColumn("pos", (F.col("label") == 1).cast("int")).filter("label = 1 OR error_active = 0")


#: Ranges that scores are ranked in, ranges of a quantile's pass, and values that are looked at one by one in the end.
RANGES, BINS, FEW = 64, 4096, 10_000


def quantiles(rows: DataFrame, columns: list[str], q: float) -> dict[str, float | None]:
    """Exact quantiles, linear between neighbours, by counted ranges: each pass counts BINS ranges of the one before
    that holds the rank, until FEW values or a single one are left. Nulls do not count; no values give None."""
    ends = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max), ("n", F.count))]).first()
    out: dict[str, float | None] = {}
    todo = {}
    for i, c in enumerate(columns):
        a, b, n = ends[f"a{i}"], ends[f"b{i}"], ends[f"n{i}"]
        if not n or a == b:
            out[c] = float(a) if n else None
        else:
            todo[c] = (float(a), float(b), 0, n, q * (n - 1))
    while todo:
        parts = []
        for c, (a, b, _, n, _) in todo.items():
            x = F.col(c).cast("double")
            bin_ = F.least(F.lit(BINS - 1), F.floor((x - a) / ((b - a) / BINS)).cast("int")) if n > FEW else F.lit(-1)
            parts.append(F.when(x.between(a, b), F.struct(F.lit(c).alias("c"), bin_.alias("bin"), x.alias("x"))))
        held = rows.select(F.explode(F.array(*parts)).alias("p")).filter("p IS NOT NULL").select("p.*")
        lists = held.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.when(F.col("bin") == -1, F.array_sort(F.collect_list(F.when(F.col("bin") == -1, F.col("x"))))).alias("xs"))
        found: dict[str, list] = {}
        for r in lists.orderBy("c", "bin").collect():  # BINS rows a column at most, FEW values in a list
            found.setdefault(r["c"], []).append(r)
        after = {}
        for c, (_, _, below, _, at) in todo.items():
            low, high = int(at), min(int(at) + 1, int(at) + (at > int(at)))
            values: dict[int, float] = {}
            for r in found[c]:
                if r["xs"]:
                    values |= {k: r["xs"][k - below] for k in (low, high)}
                    break
                here = [k for k in (low, high) if below <= k < below + r["n"]]
                if here and (r["a"] == r["b"] or (len(set(here)) == 1 and low != high)):
                    # of two ranks in two ranges, the lower is the last of its own and the higher the first
                    values |= {k: r["b"] if k == low else r["a"] for k in here}
                elif here:
                    after[c] = (r["a"], r["b"], below, r["n"], at)
                    break
                below += r["n"]
            if c not in after:
                out[c] = values[low] if low == high else (high - at) * values[low] + (at - low) * values[high]
        todo = after
    return out


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    return quantiles(rows, [column], q)[column]


def _before(counts: DataFrame, by: list[str], values: list[str], down: bool = False) -> DataFrame:
    """Adds ``_<value>``, its sum over the lower (with ``down`` higher) scores: sums of ranges, and ranks within each."""
    edges = sorted(set(counts.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 0.01)))
    ranged = counts.withColumn("_range", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("score"))) if edges else F.lit(0))
    whole = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(v) for v in values])
    order = lambda c: F.desc(c) if down else F.asc(c)
    earlier = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a key
    offsets = whole.select(*by, "_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy(*by, "_range").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.join(offsets, [*by, "_range"])
    return ranked.select(*counts.columns, *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"_{v}") for v in values])


def auroc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with ties at mid rank, over all rows or by keys; null without both sides.

    Rows first become one for each score; ranks come from ranges of scores, so that no task has all of them."""
    by = by or []
    counts = _sides(scored).groupBy(*by, "score").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("n"))
    placed = _before(counts, by, ["n"]).withColumn("won", F.col("p") * (F.col("_n") + F.col("n") / 2.0))
    pairs = F.sum("p") * F.sum("n").cast("double")
    return placed.groupBy(*by).agg(F.when(pairs > 0, F.sum("won") / pairs).alias("auroc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def auprc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average precision, over all rows or by keys: precision at each score, weighted by the recall it adds."""
    by = by or []
    counts = _sides(scored).groupBy(*by, "score").agg(F.sum("pos").alias("p"), F.count(F.lit(1)).alias("c"))
    steps = _before(counts, by, ["p", "c"], down=True)
    return steps.groupBy(*by).agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * (F.col("_p") + F.col("p")) / (F.col("_c") + F.col("c"))) / F.sum("p")).alias("auprc"))


def auroc_of_guns(scored: DataFrame) -> DataFrame:
    return auroc(scored, ["gun"]).agg(F.avg("auroc").alias("gun_mean"), F.min("auroc").alias("gun_min"), F.max("auroc").alias("gun_max"))


def alarm_rates(alarmed: DataFrame) -> DataFrame:
    """Rates over normal windows (all, after warm-up), error states and labelled windows; held windows; spread by gun."""
    when = lambda cond: F.avg(F.when(cond, F.col("alarm").cast("double")))
    quiet = (F.col("label") == 0) & (F.col("error_active") == 0)
    total = alarmed.agg(when(quiet).alias("normal_rate"), when(quiet & (F.col("warmup") == 0)).alias("after_warmup_rate"), when(F.col("error_active") == 1).alias("error_rate"), when(F.col("label") == 1).alias("recall"), F.sum("held").alias("held"))
    each = alarmed.filter(quiet).groupBy("gun").agg(F.avg(F.col("alarm").cast("double")).alias("r")).agg(F.min("r").alias("gun_min"), F.max("r").alias("gun_max"), F.stddev_pop("r").alias("gun_sd"))
    return total.join(F.broadcast(each))  # one row each


def rule_metrics(windows: DataFrame, fired: DataFrame, profile: Profile) -> DataFrame:
    """Per gun: triggers, repeats, the lead of the first within the label window, false ones a day before it."""
    spans = windows.groupBy("gun").agg(F.max("ttf_s").alias("span"))
    inside = F.col("ttf_s") <= profile.label_s
    agg = fired.groupBy("gun").agg(F.count(F.lit(1)).alias("triggers"), F.sum("repeat").alias("repeats"), F.max(F.when(inside, F.col("ttf_s"))).alias("lead_s"), F.sum((~inside & (F.col("repeat") == 0)).cast("int")).alias("false_n"))
    days = (F.col("span") - profile.label_s) / 86400.0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return spans.join(agg, "gun", "left").select("gun", zero("triggers").alias("triggers"), zero("repeats").alias("repeats"), F.col("lead_s").isNotNull().cast("int").alias("hit"), "lead_s", F.when(days > 0, zero("false_n") / days).alias("false_per_day"))


def operating_point(final: DataFrame, false_per_day: DataFrame, profile: Profile, most: float = 1.0) -> DataFrame:
    joined = final.join(false_per_day, "gun")
    lead, quiet = F.coalesce(F.col("final_run_h") * 3600 >= profile.lead_s, F.lit(False)), F.coalesce(F.col("false_runs_per_day") <= most, F.lit(True))
    return joined.agg(F.count(F.lit(1)).alias("guns"), F.sum(lead.cast("int")).alias("lead_met"), F.sum(quiet.cast("int")).alias("quiet_met"), F.sum((lead & quiet).cast("int")).alias("both_met"))


def folds(files: DataFrame, k: int) -> DataFrame:
    """Stratified folds: round robin over each class in an order drawn from the file's digest."""
    order = Window.partitionBy("class").orderBy(F.md5(F.col("gun").cast("string")), "gun")
    return files.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


def holdout(files: DataFrame, fraction: float) -> DataFrame:
    """Stratified split: of each class the first ``fraction`` (rounded) in the digest's order validate."""
    by = Window.partitionBy("class")
    order = by.orderBy(F.md5(F.col("gun").cast("string")), "gun")
    return files.withColumn("validation", (F.row_number().over(order) <= F.round(F.count(F.lit(1)).over(by) * fraction)).cast("int"))


def relabel(windows: DataFrame, seconds: int) -> DataFrame:
    return windows.withColumn("label", (F.col("ttf_s") <= seconds).cast("int"))


def infer_class(rows: DataFrame, codes: Column, rule_s: int) -> DataFrame:
    """Per gun the class of the terminal code closest to failure within ``rule_s``, and where it comes from."""
    near = rows.filter((F.col("ttf_s") <= rule_s) & (F.col("terminal_any") == 1)).groupBy("gun").agg(F.max_by("code", "slot").alias("code"))
    guns = rows.select("gun").distinct().join(near, "gun", "left")
    return guns.select("gun", codes[F.col("code")].alias("inferred"), F.when(F.col("code").isNull(), "none").otherwise("terminal_code").alias("class_source"))


def ttf_bucket(seconds: Column) -> Column:
    """Buckets of time to failure, in days for the scaled profile: the last hour up to more than a week."""
    return F.when(seconds <= 3600, "0-1h").when(seconds <= 21_600, "1-6h").when(seconds <= 86_400, "6-24h").when(seconds <= 604_800, "1-7d").otherwise(">7d")


def cohens_d(scored: DataFrame, column: str) -> DataFrame:
    s = _sides(scored)
    a = s.groupBy("pos").agg(F.avg(column).alias("m"), F.var_samp(column).alias("v"), F.count(F.lit(1)).alias("n"))
    p, n = (a.filter(f"pos = {i}").select(F.col("m").alias(f"m{i}"), F.col("v").alias(f"v{i}"), F.col("n").alias(f"n{i}")) for i in (1, 0))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return p.join(F.broadcast(n)).select(((F.col("m1") - F.col("m0")) / F.sqrt(pooled)).alias("cohens_d"))


def spearman(rows: DataFrame, a: str, b: str, by: str = "gun") -> DataFrame:
    """Rank correlation by key, ties at mid rank: what leaks the clock correlates with elapsed time."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(by, c)) - 1) / 2.0

    return rows.select(by, rank(a).alias("ra"), rank(b).alias("rb")).groupBy(by).agg(F.corr("ra", "rb").alias("spearman"))
