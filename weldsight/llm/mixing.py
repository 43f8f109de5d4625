"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.llm.common import cut, table

log = logging.getLogger(__name__)

MARGINS = ("source", "lang", "topic")
#: Share of a margin's value: its tokens to this power, over the sum of these.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.8}
ROUNDS = 8
#: Share of the input's tokens that the pipeline's mixture takes.
SHARE = 0.5
#: Cells up to which their table is broadcast (under 100 bytes a row); beyond it they are joined by key.
BROADCAST_CELLS = 50_000

#: The topics, by the first rule that holds, and what counts as a token. Spark and DuckDB read both alike.
TOPIC_SQL = """CASE WHEN contains(body, 'License') OR contains(body, 'Copyright') THEN 'licence'
 WHEN contains(body, '@') THEN 'contact'
 WHEN contains(body, ' | ') OR contains(body, '%%%') OR contains(body, '###') THEN 'markup'
 WHEN tokens < 100 THEN 'brief' WHEN tokens < 1000 THEN 'article' ELSE 'longform' END"""
TOKENS_SQL = "length(body) - length(replace(replace(body, ' ', ''), chr(10), '')) + CASE WHEN body = '' THEN 0 ELSE 1 END"
DRAW_SQL = "substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR(20)), ''), '|mix')), 1, 8)"


def with_attributes(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of each row; a null source or language is ``?``, a null text is empty."""
    named = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in ("source", "lang")], F.coalesce("text", F.lit("")).alias("body"))
    counted = named.withColumn("tokens", F.expr(TOKENS_SQL).cast("long"))
    return counted.select("doc_id", "source", "lang", F.expr(TOPIC_SQL).alias("topic"), "tokens")


def targets(cells: DataFrame, margin: str, wanted: dict[str, float] | None) -> Column:
    """Target share of the margin's value of each cell."""
    own = Window.partitionBy(margin)
    if wanted is None:
        # every cell of a value adds the same part of the value's tempered mass
        return F.pow(F.sum("base").over(own), F.lit(TEMPER[margin]))
    pairs = [F.lit(x) for kv in wanted.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.col(margin)].cast("double"), F.lit(0.0))


def with_targets(cells: DataFrame, wanted: dict[str, dict[str, float]] | None) -> DataFrame:
    """Adds, for each margin m, the target share ``_t_m`` and the tokens ``_b_m`` of the cell's value."""
    wanted = wanted or {}
    out = cells
    for m in MARGINS:
        # the total of a margin's targets, from one row for each of its values
        values = cells.groupBy(m).agg(F.sum("base").alias("base")).withColumn("_t", targets(cells, m, wanted.get(m)))
        total = values.agg(F.sum("_t").alias("_s"))
        out = out.join(values.join(F.broadcast(total)).select(m, (F.col("_t") / F.col("_s")).alias(f"_t_{m}"), F.col("base").cast("double").alias(f"_b_{m}")), m)
    return out


def rake(cells: DataFrame, rounds: int = ROUNDS, wanted: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds ``weight``: the cells' ``base`` raked in turn to the margins' targets, ``rounds`` times.

    ``wanted`` may give shares for a margin; values that it leaves out get none. Margins without any follow their
    tempered base. A cell without base keeps weight 0.
    """
    out = cut(with_targets(cells, wanted).withColumn("weight", F.col("base").cast("double")))
    mass = out.agg(F.sum("base").cast("double").alias("_mass"))
    out = out.join(F.broadcast(mass))
    for turn in range(rounds):
        if turn and turn % 8 == 0:  # longer plans take the driver longer than the work
            out = cut(out)
        for m in MARGINS:
            now = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_t_{m}") * F.col("_mass") / now).otherwise(0.0))
    return out.select(*MARGINS, "base", "weight")


def level(rows: DataFrame, budget: float) -> dict[str, float]:
    """For each value of ``part``, the scale c at which least(base, c * want) sums to the budget.

    The sum is concave in c, so that Newton's steps come from below, and they end when no further row reaches its base.
    Where all rows with a want are at their base, the budget is out of reach and c is one that takes them whole.
    """
    scale: dict[str, float] = {}
    while True:
        now = F.coalesce(F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])[F.col("part")], F.lit(0.0)) if scale else F.lit(0.0)
        full = (F.col("want") > 0) & (F.col("want") * now >= F.col("base"))
        sums = rows.groupBy("part").agg(F.sum(F.when(full, F.col("base")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("want"))).alias("rest")).collect()  # a row a part
        found = {r["part"]: max(scale.get(r["part"], 0.0), (budget - r["full"]) / r["rest"]) if r["rest"] > 0 else scale.get(r["part"], 0.0) for r in sums}
        if all(c <= scale.get(part, 0.0) * (1 + 1e-12) for part, c in found.items()):
            return found
        scale = found


def ration(cells: DataFrame, share: float, rounds: int = ROUNDS, wanted: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds ``weight``: the tokens taken of each cell, at most its ``base``, together ``share`` of all tokens.

    A margin's value whose target is more than its tokens is taken whole, and the others get what it leaves, in
    proportion to their targets. Cells are raked to these amounts; a cell that is taken whole leaves what it lacks to
    the others of its value. Where ``wanted`` leaves out values, the tokens may come to less than the share.
    """
    start = cut(with_targets(cells, wanted).withColumn("base", F.col("base").cast("double")))
    budget = share * (start.agg(F.sum("base").alias("mass")).collect()[0]["mass"] or 0.0)
    values = [start.select(F.lit(m).alias("part"), F.col(m).alias("value"), F.col(f"_b_{m}").alias("base"), (F.col(f"_t_{m}") * budget).alias("want")).distinct() for m in MARGINS]
    scale = level(cut(values[0].unionByName(values[1]).unionByName(values[2])), budget)
    out = start.withColumn("weight", F.col("base") * share)
    taken = F.least("base", "weight")
    for turn in range(rounds):
        if turn and turn % 8 == 0:
            out = cut(out)
        for m in MARGINS:
            own = Window.partitionBy(m)
            due = F.least(F.col(f"_b_{m}"), F.col(f"_t_{m}") * (budget * scale.get(m, 0.0)))
            full = F.col("weight") >= F.col("base")
            sums = out.withColumn("_now", F.sum(taken).over(own)).withColumn("_full", F.sum(F.when(full, F.col("base")).otherwise(0.0)).over(own)).withColumn("_rest", F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(own))
            more = F.when(F.col("_rest") > 0, F.col("weight") * (due - F.col("_full")) / F.col("_rest")).otherwise(F.col("weight"))
            out = sums.withColumn("weight", F.when(F.col("_now") >= due, F.when(F.col("_now") > 0, taken * due / F.col("_now")).otherwise(0.0)).otherwise(F.when(full, F.col("weight")).otherwise(more))).drop("_now", "_full", "_rest")
    raked = cut(out.select(*MARGINS, "base", taken.alias("weight")))
    last = level(raked.select(F.lit("").alias("part"), "base", F.col("weight").alias("want")), budget).get("", 0.0)
    return raked.withColumn("weight", F.least("base", F.col("weight") * last))


def mixture(attributes: DataFrame, rounds: int = ROUNDS, wanted: dict[str, dict[str, float]] | None = None, share: float | None = None) -> DataFrame:
    """source, lang, topic and ``prob``: the share of the cell's documents that the mixture takes.

    A document of a cell is worth weight / base of its tokens; the probabilities are these ratios over the largest,
    so that no document is taken twice and the expected tokens have the raked margins. Cells without tokens have 0.
    The smallest cell then sets how much is taken; with ``share``, the probabilities take that share of all tokens.
    """
    cells = attributes.groupBy(*MARGINS).agg(F.sum("tokens").alias("base"))
    if share is not None:
        rationed = cut(ration(cut(cells), share, rounds, wanted))
        kept = rationed.agg(F.sum("base").alias("base"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cells")).collect()[0]
        log.info("mixture: %.0f of %.0f tokens expected, a share of %.4f", kept["weight"] or 0, kept["base"] or 0, (kept["weight"] or 0) / (kept["base"] or 1))
        found = rationed.select(*MARGINS, F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(0.0).alias("prob"))
        return F.broadcast(found) if kept["cells"] <= BROADCAST_CELLS else found
    raked = cut(rake(cells, rounds, wanted))
    ratio = F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(0.0)
    most = raked.agg(F.max(ratio).alias("_most"))
    found = raked.join(F.broadcast(most)).select(*MARGINS, F.when(F.col("_most") > 0, ratio / F.col("_most")).otherwise(0.0).alias("prob"))
    return F.broadcast(found) if raked.count() <= BROADCAST_CELLS else found


def draw() -> Column:
    """A number in [0, 1) that follows from doc_id alone."""
    return F.conv(F.expr(DRAW_SQL), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, rounds: int = ROUNDS, wanted: dict[str, dict[str, float]] | None = None, share: float | None = None) -> DataFrame:
    """One row for each document: doc_id, source, lang, topic, tokens, prob (6 places) and taken.

    Tokens are the parts of a text between spaces and line breaks. Documents without tokens have probability 0. Null
    sources, languages and texts are values of their own (``?``, empty); repeated rows share one draw; an empty table
    gives no rows; other columns are not read.
    """
    attributes = with_attributes(docs)
    joined = attributes.join(mixture(attributes, rounds, wanted, share), list(MARGINS))
    prob = F.round(F.when(F.col("tokens") > 0, F.col("prob")).otherwise(0.0), 6)
    return joined.withColumn("prob", prob).select("doc_id", *MARGINS, "tokens", "prob", (draw() < F.col("prob")).alias("taken"))


def take(docs: DataFrame, rounds: int = ROUNDS, wanted: dict[str, dict[str, float]] | None = None, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, with all their columns."""
    found = mixture(with_attributes(docs), rounds, wanted, share)
    rows = docs.select(F.struct("*").alias("_row")).select("_row", "_row.doc_id", "_row.source", "_row.lang", "_row.text")
    named = rows.select("_row", "doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in ("source", "lang")], F.coalesce("text", F.lit("")).alias("body"))
    counted = named.withColumn("tokens", F.expr(TOKENS_SQL).cast("long")).withColumn("topic", F.expr(TOPIC_SQL)).drop("body")
    joined = counted.join(found, list(MARGINS))
    return joined.filter((F.col("tokens") > 0) & (draw() < F.round("prob", 6))).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle(rounds: int) -> str:
    parts = [
        f"""WITH body AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang, coalesce(text, '') AS body FROM documents),
counted AS (SELECT *, CAST({TOKENS_SQL} AS BIGINT) AS tokens FROM body),
attributes AS (SELECT doc_id, source, lang, {TOPIC_SQL} AS topic, tokens FROM counted),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS base FROM attributes GROUP BY ALL)"""
    ]
    for m in MARGINS:
        parts.append(f"t_{m} AS (SELECT {m}, pow(sum(base), {TEMPER[m]}) / sum(pow(sum(base), {TEMPER[m]})) OVER () AS t_{m} FROM cells GROUP BY {m})")
    parts.append("r0 AS MATERIALIZED (SELECT *, base AS weight, sum(base) OVER () AS mass FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            now = f"sum(weight) OVER (PARTITION BY {m})"
            parts.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {now} > 0 THEN weight * t_{m} * mass / {now} ELSE 0 END AS weight) FROM r{n})")
            n += 1
    parts.append(f"ratios AS (SELECT source, lang, topic, CASE WHEN base > 0 THEN weight / base ELSE 0 END AS ratio FROM r{n})")
    parts.append("""found AS (SELECT doc_id, source, lang, topic, tokens,
  round(CASE WHEN tokens > 0 AND max_ratio > 0 THEN ratio / max_ratio ELSE 0 END, 6) AS prob
  FROM attributes JOIN (SELECT *, max(ratio) OVER () AS max_ratio FROM ratios) USING (source, lang, topic))""")
    return ",\n".join(parts) + f"\nSELECT *, CAST(('0x' || {DRAW_SQL}) AS BIGINT) / 4294967296.0 < prob AS taken FROM found"


OP6_SQL = _oracle(ROUNDS)
