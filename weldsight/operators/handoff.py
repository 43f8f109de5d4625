"""From attributed windows to findings, symptoms and a hand-off document, as joins and aggregates of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weldsight.config import CLASS_NAMES, CLASS_SITUATIONS, STANDSTILL, SYMPTOMS, TERMINAL_CODES, WEAK

#: Smallest share and deviation of a finding, and findings of a document at most.
MIN_SHARE, MIN_DEVIATION, MOST = 0.05, 1.0, 6


def sensor_findings(contributions: DataFrame, sensors: dict[str, str], key: list[str]) -> DataFrame:
    """Contributions that say something about a sensor: positive, a share of 5 % or more, off by 1 or more; a mean is
    high or low, a deviation unstable when it grows. At most six by share."""
    names = F.create_map(*[F.lit(x) for kv in sensors.items() for x in kv])
    base, stat = F.regexp_replace("feature", "_(mean|std)$", ""), F.regexp_extract("feature", "_(mean|std)$", 1)
    off = F.col("value") - F.col("reference")
    direction = F.when(stat == "std", F.when(off > 0, "unstable")).otherwise(F.when(off > 0, "high").otherwise("low"))
    kept = contributions.withColumn("sensor", names[base]).withColumn("direction", direction).withColumn("deviation", F.round(off, 2))
    kept = kept.filter((F.col("contribution") > 0) & (F.col("share") >= MIN_SHARE) & (F.abs(off) >= MIN_DEVIATION) & F.col("sensor").isNotNull() & F.col("direction").isNotNull())
    return kept.filter(F.col("rank") <= MOST).select(*key, "rank", "sensor", "direction", "deviation", F.round("share", 3).alias("share"))


def rule_table(spark: SparkSession) -> DataFrame:
    """(symptom, part, sensor, direction) of every condition of the symptom rules."""
    rows = [(i, part, *c.split(":")) for i, core, aux, _, _ in SYMPTOMS for part, conditions in (("core", core), ("aux", aux), ("weak", WEAK.get(i, ()))) for c in conditions]
    return spark.createDataFrame(rows, "symptom string, part string, sensor string, direction string")


def symptom_match(findings: DataFrame, key: list[str], welds: DataFrame | None = None) -> DataFrame:
    """Symptoms of each key: full with a core and, where the rule has one, an auxiliary condition, else partial; partial
    with a weak condition alone.

    ``welds`` (the key and welds_in_window) tells which keys stood still: only those can have the symptoms of
    STANDSTILL. Null counts and keys without a row are not known to stand still.
    """
    rules = rule_table(findings.sparkSession)
    needs_aux = F.col("symptom").isin([s[0] for s in SYMPTOMS if s[2]])
    hits = findings.join(F.broadcast(rules), ["sensor", "direction"]).groupBy(*key, "symptom").agg(F.max((F.col("part") == "core").cast("int")).alias("core"), F.max((F.col("part") == "aux").cast("int")).alias("aux"), F.max((F.col("part") == "weak").cast("int")).alias("weak"))
    full = (F.col("core") == 1) & ((F.col("aux") == 1) | ~needs_aux)
    if welds is None:
        hits = hits.filter(~F.col("symptom").isin(*STANDSTILL))
    else:
        still = welds.filter("welds_in_window = 0").select(*key, F.lit(True).alias("_still")).distinct()
        hits = hits.join(still, key, "left").filter(~F.col("symptom").isin(*STANDSTILL) | F.col("_still"))
    return hits.filter("core = 1 OR weak = 1").select(*key, "symptom", F.when(full, "full").otherwise("partial").alias("match"))


def fault_class(events: DataFrame) -> DataFrame:
    """fault and basis of events: the rule's code if it fired and is no repeat, else the latest code, else none."""
    classes = F.create_map(*[F.lit(x) for kv in TERMINAL_CODES.items() for x in kv])
    rule = F.when((F.col("fired") == 1) & (F.col("repeat") == 0), classes[F.col("rule_code")])
    hint = classes[F.col("latest_code")]
    basis = F.when(rule.isNotNull(), "rule_trigger").when(hint.isNotNull(), "latest_error_code")
    return events.withColumn("fault", F.coalesce(rule, hint)).withColumn("basis", basis)


def documents(events: DataFrame, findings: DataFrame, symptoms: DataFrame) -> DataFrame:
    """One document for each event (gun, win, fired, repeat, rule_code, latest_code): class, symptoms, situations in
    order, confidence and a summary. The id is a digest of gun, window and trigger, so that a retry has the same."""
    key = ["gun", "win"]
    told = findings.groupBy(*key).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "sensor", "direction").alias("t")))), lambda s: s["t"])).alias("told"))
    owners = F.create_map(*[F.lit(x) for s in SYMPTOMS for x in (s[0], ",".join(s[3]))])
    places = F.create_map(*[F.lit(x) for s in SYMPTOMS for x in (s[0], ",".join(s[4]))])
    seen = symptoms.join(fault_class(events).select(*key, "fault"), key).withColumn("agrees", F.coalesce(owners[F.col("symptom")].contains(F.col("fault")), F.lit(False)))
    order = F.struct((~F.col("agrees")).alias("o"), (F.col("match") != "full").alias("p"), "symptom")
    listed = F.array_sort(F.collect_list(order))
    grouped = seen.groupBy(*key).agg(F.concat_ws(",", F.transform(listed, lambda s: s["symptom"])).alias("symptoms"), F.flatten(F.transform(listed, lambda s: F.split(places[s["symptom"]], ","))).alias("_places"))
    rows = fault_class(events).join(told, key, "left").join(grouped, key, "left")
    own = F.create_map(*[F.lit(x) for kv in CLASS_SITUATIONS.items() for x in kv])[F.col("fault")]
    named = F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])[F.col("fault")]
    none = F.expr("cast(array() as array<string>)")
    fallback = F.when(F.col("_places").isNull() & (F.col("fired") == 1) & F.col("fault").isNull(), F.array(F.lit("S09"))).otherwise(none)
    situations = F.array_distinct(F.concat(F.when(own.isNotNull(), F.array(own)).otherwise(none), F.coalesce("_places", fallback)))
    return rows.select(
        *key,
        F.md5(F.concat_ws("|", F.col("gun").cast("string"), F.col("win").cast("string"), F.when(F.col("fired") == 1, "rule").otherwise("model"))).alias("event_id"),
        "fault", "basis",
        F.coalesce("symptoms", F.when(F.col("fired") == 1, "P9").otherwise("")).alias("symptoms"),
        F.concat_ws(",", situations).alias("situations"),
        F.when((F.col("fired") == 1) & (F.col("repeat") == 0) & F.col("fault").isNotNull(), "medium").otherwise("low").alias("confidence"),
        F.concat_ws("; ", "told", F.concat(F.lit("fault class "), F.col("fault"), F.lit(" ("), named, F.lit(")"))).alias("summary"),
    )


def outbox(documents_: DataFrame, limit: int = 50, gun=None, delivery: str | None = None, capacity: int = 1000) -> DataFrame:
    """The newest ``limit`` documents among the newest ``capacity``, on demand of one gun or in one state of delivery."""
    newest = [F.desc("win"), F.asc("gun")]
    held = documents_.orderBy(*newest).limit(capacity)
    for column, wanted in (("gun", gun), ("delivery", delivery)):
        if wanted is not None:
            held = held.filter(F.col(column) == wanted)
    return held.orderBy(*newest).limit(min(capacity, max(1, limit)))
