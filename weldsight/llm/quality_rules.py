"""Quality rules whose cutoffs hold a stated risk of rejecting good documents, with DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weldsight.llm.common import cut, table

WORD, SYMBOL, LINE_WITH_WORD = r"[^\x20\x09-\x0D]+", "[#*$%&|<>]", r"[^\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Largest share of a stratum's good documents that the rules together may reject, and the chance that any stratum has more.
RISK, CHANCE = 0.05, 0.05
#: A share of good documents rejected weighs as much as so many times that share of bad ones missed.
COST = 4
#: Letters a word, in hundredths, from which all means count alike.
LONGEST = 2000
#: What the rules look at, as whole numbers that are higher for worse texts; Spark and DuckDB read them alike.
RULES = {
    "symbols": "least(1000, 1000 * n_symbols {div} greatest(word_chars, 1))",
    "long_words": f"least({LONGEST}, 100 * word_chars {{div}} greatest(n_words, 1))",
    "short_words": f"{LONGEST} - least({LONGEST}, 100 * word_chars {{div}} greatest(n_words, 1))",
    "repeated_lines": "1000 * n_dup_lines {div} greatest(n_lines, 1)",
}
#: Strata up to which the table of cutoffs is broadcast (under 100 bytes a row); beyond it they are joined by key.
BROADCAST_STRATA = 50_000


def _alike(words: Column, pairs: Column) -> Column:
    """Windows of three words that share their hash with another, in the order of their words and starts."""
    near = F.filter(pairs, lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]))
    return F.sort_array(F.transform(near, lambda x: F.struct(*[F.get(words, x["p"] + k).alias(f"w{k}") for k in range(3)], x["p"].alias("p"))))


def text_counts(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the columns ``kept``, COUNTS and n_lines (lines with a word) of every whole text; a null text has none.

    Each text is one row from start to end, so that nothing is shuffled. Windows are told apart by a hash first; those
    that share one are compared by their words.
    """
    named = docs.select("doc_id", *kept, F.coalesce("text", F.lit("")).alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(LINE_WITH_WORD))
    split = named.select("doc_id", *kept, F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"), F.regexp_count("body", F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    words = F.col("words")
    counted = split.select(
        "doc_id", *kept, "words", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("hashes"),
    )
    several = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rest = ("doc_id", *kept, *COUNTS[:4], "n_lines")
    hashed = counted.select(*rest, "words", F.when(several, pairs).alias("pairs"))
    found = hashed.select(*rest, F.when(F.col("pairs").isNotNull(), _alike(words, F.col("pairs"))).alias("found"))
    at = F.col("found")

    def same(x: Column, other: Column) -> Column:
        return x["w0"].eqNullSafe(other["w0"]) & x["w1"].eqNullSafe(other["w1"]) & x["w2"].eqNullSafe(other["w2"])

    starts = F.transform(F.filter(at, lambda x, i: same(x, F.get(at, i - 1)) | same(x, F.get(at, i + 1))), lambda x: x["p"])
    begun = found.select(*rest, F.sort_array(starts).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return begun.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def judged(counts: DataFrame) -> DataFrame:
    """Adds stratum, base_failed and the value ``r_<rule>`` of each rule."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select("*", F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("stratum"), base.alias("base_failed"), *[F.expr(sql.format(div="div")).cast("long").alias(f"r_{name}") for name, sql in RULES.items()])


def most_rejected(strata: DataFrame, risk: float, chance: Column) -> DataFrame:
    """Adds ``allowed``: the largest k for which P(X <= k) <= chance, X binomial of ``good`` draws at ``risk``; -1 if none.

    With so many of the good documents rejected, a true share of ``risk`` or more is ruled out at that chance: the exact
    upper bound of the share lies below ``risk``. One number for each k up to good * risk is held in a row.
    """
    odds = math.log(risk) - math.log1p(-risk)
    first = F.col("good") * math.log1p(-risk)
    start = F.struct(first.alias("term"), first.alias("total"), F.when(first <= F.log(chance), F.lit(0)).otherwise(-1).cast("long").alias("k"))

    def more(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((F.col("good") - i + 1) / i) + odds
        total = F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= F.log(chance), i).otherwise(a["k"]).alias("k"))

    upto = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("good") * risk).cast("long")))
    return strata.withColumn("allowed", F.aggregate(upto, start, more, lambda a: a["k"]))


def cutoffs(labelled: DataFrame, risk: float = RISK, chance: float = CHANCE) -> DataFrame:
    """A row for each stratum with the cutoff of each rule (a document at or over it is rejected; null: the rule is off).

    ``labelled`` has stratum, quality (1 good, 0 bad) and the rules' values of documents that pass the base rules. A
    rule's cutoffs are tested on the stratum's good documents from loose to strict and hold up to the first one whose
    exact binomial bound passes the rule's part of ``risk``; so each sequence needs no correction of its own. ``risk``
    is dealt to the rules and ``chance`` to the strata and rules alike (Bonferroni), so that with probability
    1 - ``chance`` the rules together reject at most ``risk`` of the good documents of every stratum. Of the cutoffs
    that hold, the one that gains most (share of bad ones less COST times the share of good ones) is taken, of equals
    the loosest, put midway to the next value below it that occurs; a rule without gain is off.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r_{name}").alias("value")) for name in RULES]))
    good, bad = (F.sum((F.col("quality") == q).cast("long")) for q in (1, 0))
    bins = labelled.select("stratum", "quality", rules.alias("x")).groupBy("stratum", "x.rule", "x.value").agg(good.alias("good"), bad.alias("bad"))
    bins = cut(bins)  # at most LONGEST + 1 values a rule and stratum
    strata = bins.filter(F.col("rule") == next(iter(RULES))).groupBy("stratum").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tests = strata.agg((F.count(F.lit(1)) * len(RULES)).alias("tests"))
    limits = most_rejected(strata.join(F.broadcast(tests)), risk / len(RULES), F.lit(chance) / F.col("tests"))  # one row
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    over = bins.withColumn("good_over", F.sum("good").over(above)).withColumn("bad_over", F.sum("bad").over(above)).withColumn("below", F.lead("value").over(above)).drop("good", "bad")
    held = over.join(limits, "stratum").filter(F.col("good_over") <= F.col("allowed"))
    gain = F.col("bad_over") * F.col("good") - COST * F.col("good_over") * F.col("bad")
    best = held.withColumn("gain", gain).filter("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "value", "below")).alias("b"))
    middle = F.expr("b.value - (b.value - coalesce(b.below, b.value - 1)) div 2")
    return best.withColumn("cutoff", middle).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"c_{name}") for name in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, chance: float = CHANCE) -> DataFrame:
    """One row for each document: doc_id, COUNTS, base_failed and kept.

    Documents of fewer than 50 words or with over half of their words in repeated windows of three fail; of the others
    those stay that no rule of their stratum (the language, ``?`` for null) rejects. Cutoffs come from all labelled
    documents that pass the base rules; a doc_id with several labels counts as bad if one of them says so, labels other
    than 0 and 1 do not count, and repeated rows of documents count each. Strata without labels, or with too few for the
    bound, have the base rules alone. Null texts have no words and fail; null doc_ids are kept as rows and have no label;
    empty tables give no rows; other columns are not read.
    """
    # counts of all texts, a few numbers a row, are read for the cutoffs and for the verdicts
    found = judged(cut(text_counts(docs, "lang")))
    quality = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    limits = cut(cutoffs(found.filter(~F.col("base_failed")).join(quality, "doc_id"), risk, chance))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_STRATA else limits
    rejected = F.lit(False)
    for name in RULES:
        rejected = rejected | F.coalesce(F.col(f"r_{name}") >= F.col(f"c_{name}"), F.lit(False))
    return found.join(limits, "stratum", "left").select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
_VALUES = ", ".join(f"CAST({sql.format(div='//')} AS BIGINT) AS r_{name}" for name, sql in RULES.items())
_LONG = " UNION ALL ".join(f"SELECT stratum, quality, '{name}' AS rule, r_{name} AS value FROM labelled" for name in RULES)
_CUTS = ", ".join(f"max(CASE WHEN rule = '{name}' THEN cutoff END) AS c_{name}" for name in RULES)
_REJECTED = " OR ".join(f"coalesce(r_{name} >= c_{name}, FALSE)" for name in RULES)
OP12_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM texts),
shifted AS (SELECT r, i, w, lead(w) OVER (PARTITION BY r ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w2 FROM placed),
windows AS (SELECT r, i FROM shifted WHERE w2 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, w1, w2) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM windows, range(3) t(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{LINE_WITH_WORD}') GROUP BY r),
counts AS (SELECT doc_id, stratum, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '{SYMBOL}')) AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM texts LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_VALUES} FROM counts),
labelled AS (SELECT judged.*, quality FROM judged JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
bins AS (SELECT stratum, rule, value, count(*) FILTER (quality = 1) AS g, count(*) FILTER (quality = 0) AS b FROM ({_LONG}) GROUP BY ALL),
strata AS (SELECT stratum, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) OVER () * {len(RULES)} AS tests FROM labelled GROUP BY stratum),
terms AS (SELECT stratum, tests, k, sum(exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({RISK / len(RULES)!r}::DOUBLE) + (good - k) * ln(1 - {RISK / len(RULES)!r}::DOUBLE))) OVER (PARTITION BY stratum ORDER BY k) AS p
  FROM (SELECT *, unnest(range(0, least(good, greatest(1, CAST(floor(good * {RISK / len(RULES)!r}::DOUBLE) AS BIGINT))) + 1)) AS k FROM strata)),
limits AS (SELECT stratum, good, bad, coalesce(allowed, -1) AS allowed FROM strata LEFT JOIN (SELECT stratum, max(k) AS allowed FROM terms WHERE p <= {CHANCE!r}::DOUBLE / tests GROUP BY stratum) USING (stratum)),
overs AS (SELECT stratum, rule, value, CAST(sum(g) OVER w AS BIGINT) AS go, CAST(sum(b) OVER w AS BIGINT) AS bo, lead(value) OVER w AS below FROM bins WINDOW w AS (PARTITION BY stratum, rule ORDER BY value DESC)),
best AS (SELECT stratum, rule, value - (value - coalesce(below, value - 1)) // 2 AS cutoff FROM overs JOIN limits USING (stratum) WHERE go <= allowed AND bo * good - {COST} * go * bad > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bo * good - {COST} * go * bad DESC, value DESC) = 1),
cuts AS (SELECT stratum, {_CUTS} FROM best GROUP BY stratum)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND NOT ({_REJECTED}) AS kept FROM judged LEFT JOIN cuts USING (stratum)
"""
