"""Results of online scoring to nested hand-off documents: expressions over each result's own contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weldsight.config import CAVEATS, CLASS_DEFINITIONS, CLASS_NAMES, CLASS_SITUATIONS, CLASS_WORDS, DIRECTION_WORDS, SENSOR_WORDS, STANDSTILL, SYMPTOM_WORDS, SYMPTOMS, TERMINAL_CODES, WEAK
from weldsight.operators.handoff import MIN_DEVIATION, MIN_SHARE, MOST

VERSION, SWITCH = "1.0", "c10"
DOCUMENT = "schema_version event_id gun_id detected_at window_start trigger summary_ko sensor_findings fault_class symptoms situation_ids context detector caveats".split()


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def findings(contributions: Column) -> Column:
    """Contributions that say something about a sensor, with wording: positive, a share of 5 % or more, off by 1 or more;
    a mean is high or low, a deviation unstable where it grows. Six at most, in the order they come."""
    words = [_map({s: w[i] for s, w in SENSOR_WORDS.items()}) for i in range(3)]

    def told(c: Column) -> Column:
        sensor, off = F.regexp_replace(c["feature"], "_(mean|std)$", ""), c["value"] - c["reference"]
        direction = F.when(c["statistic"] == "std", F.when(off > 0, "unstable")).otherwise(F.when(off > 0, "high").otherwise("low"))
        said = F.when((sensor == SWITCH) & (direction == "low"), DIRECTION_WORDS["off"]).when((sensor == SWITCH) & (direction == "high"), DIRECTION_WORDS["on"]).otherwise(_map(DIRECTION_WORDS)[direction])
        text = F.concat(words[1][sensor], F.lit("("), sensor, F.lit(") "), said)
        return F.struct(sensor.alias("sensor"), words[0][sensor].alias("sensor_name"), words[1][sensor].alias("sensor_name_ko"), words[2][sensor].alias("group"), c["statistic"].alias("statistic"), direction.alias("direction"), F.round(off, 2).alias("deviation_z"), F.round(c["share"], 3).alias("share"), text.alias("text_ko"))

    kept = F.filter(contributions, lambda c: (c["contribution"] > 0) & (c["share"] >= MIN_SHARE) & (F.abs(c["value"] - c["reference"]) >= MIN_DEVIATION))
    return F.slice(F.filter(F.transform(kept, told), lambda f: f["sensor_name"].isNotNull() & f["direction"].isNotNull()), 1, MOST)


def _among(conditions: Column):
    return lambda f: F.array_contains(conditions, F.concat(f["sensor"], F.lit(":"), f["direction"]))


def symptoms(found: Column, fault: Column, by_rule: Column, still: Column) -> Column:
    """Symptoms that the findings show, those of the fault class first, then full matches, then by id; P9 where a rule
    fired and there is none. Medium confidence needs a rule that fired and agrees."""
    seen = F.transform(found, lambda f: F.concat(f["sensor"], F.lit(":"), f["direction"]))
    none = F.expr("cast(array() as array<string>)")

    def one(i: str, match: Column, evidence: Column, classes: tuple, situations: Column) -> Column:
        agrees = F.coalesce(F.array_contains(_array(classes), fault), F.lit(False)) if classes else F.lit(False)
        document = F.struct(F.lit(i).alias("id"), F.lit(SYMPTOM_WORDS[i]).alias("name_ko"), match.alias("match"), evidence.alias("evidence"), _array(classes).alias("related_classes"), situations.alias("situation_ids"), agrees.alias("agrees_with_fault_class"), F.when(agrees & by_rule, "medium").otherwise("low").alias("confidence"))
        return F.struct((~agrees).alias("o"), (match != "full").alias("p"), F.lit(i).alias("i"), document.alias("d"))

    parts = []
    for i, core, aux, classes, situations in SYMPTOMS:
        weak = WEAK.get(i, ())
        has = lambda conditions: F.arrays_overlap(seen, _array(conditions)) if conditions else F.lit(False)
        full = has(core) & (has(aux) if aux else F.lit(True))
        shown = (has(core) | has(weak)) & (still if i in STANDSTILL else F.lit(True))
        named = _array((*core, *aux, *weak))
        evidence = F.transform(F.filter(found, _among(named)), lambda f: f["text_ko"])
        parts.append(F.when(shown, one(i, F.when(full, "full").otherwise("partial"), evidence, classes, _array(situations))))
    listed = F.transform(F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull())), lambda x: x["d"])
    silent = F.transform(F.array(one("P9", F.lit("no_sensor_signal"), none, (), F.when(fault.isNull(), F.array(F.lit("S09"))).otherwise(none))), lambda x: x["d"])
    return F.when((F.size(listed) == 0) & by_rule, silent).otherwise(listed)


def nested(results: DataFrame, name: str = "iforest", created: str | None = None, slot_s: int = 1, window_s: int = 60, welds: str = "welds_delta", welds_10min: str = "welds_10min", ready: bool = False) -> DataFrame:
    """gun, request, event_id and document (JSON with the keys of DOCUMENT) of the results that hand off.

    With ``ready`` every scored result gets one, as a preview. The id is a digest of gun, window and trigger, so that a
    retry writes the same. A trigger that repeats is no rule: the class then comes from the latest code, if it has one.
    """
    rows = results.filter("status = 'ok'") if ready else results.filter("hands_off")
    by_rule = F.col("rule_triggered") & ~F.col("rule_repeat")
    classes, at = _map(TERMINAL_CODES), lambda c: F.date_format(F.timestamp_seconds(F.col(c) * slot_s).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    rows = rows.withColumn("_f", findings(F.col("contributions"))).withColumn("_rule", F.when(by_rule, F.col("rule_code")))
    rows = rows.withColumn("_class", F.coalesce(classes[F.col("_rule")], classes[F.col("latest_code")]))
    still = F.coalesce(F.round(F.col("activity")[welds], 6) <= 0, F.lit(False))
    rows = rows.withColumn("_s", symptoms(F.col("_f"), F.col("_class"), by_rule, still))
    own = F.col("_class")
    code = _map({v: k for k, v in TERMINAL_CODES.items()})[own]
    fault = F.when(own.isNotNull(), F.struct(own.alias("code"), _map({k: v.capitalize() for k, v in CLASS_NAMES.items()})[own].alias("name_en"), _map(CLASS_WORDS)[own].alias("name_ko"), code.alias("terminal_code"), _map(CLASS_SITUATIONS)[own].alias("situation_id"), _map(CLASS_DEFINITIONS)[own].alias("definition"), F.when(F.col("_rule").isNotNull(), "rule_trigger").otherwise("latest_error_code").alias("basis")))
    situations = F.array_distinct(F.concat(F.when(own.isNotNull(), F.array(_map(CLASS_SITUATIONS)[own])).otherwise(F.expr("cast(array() as array<string>)")), F.flatten(F.transform("_s", lambda s: s["situation_ids"]))))
    clause = F.when(own.isNotNull(), F.concat(F.lit("고장 유형 "), own, F.lit("("), _map(CLASS_WORDS)[own], F.lit(") 의심, 에러 코드 "), F.coalesce("_rule", code), F.lit(".")))
    summary = F.concat_ws("; ", F.when(F.size("_f") > 0, F.array_join(F.transform("_f", lambda f: f["text_ko"]), ", ")), clause)
    event = F.md5(F.concat_ws("|", "gun", F.col("window_end").cast("string"), F.coalesce("_rule", F.lit("model"))))
    trigger = F.struct(F.col("severity_source").alias("source"), F.col("_rule").alias("rule_code"), F.when(by_rule, at("rule_trigger_time")).alias("rule_trigger_time"), "anomaly_score", "threshold", "score_z", "alarm_duration_s", F.col("sustained_in_request").alias("sustained"))
    context = F.struct(F.col("latest_code").alias("latest_error_code"), "error_active_share", "non_welding_share", F.col("activity")[welds].alias("welds_in_window"), F.col("activity")[welds_10min].alias("welds_10min"), "alarm_held", "gun_norm")
    detector = F.struct(F.lit(name).alias("name"), F.lit(created).cast("string").alias("created"), F.lit(window_s).alias("window_s"))
    values = [F.lit(VERSION), event, F.col("gun"), at("window_end"), at("window_start"), trigger, summary, F.col("_f"), fault, F.col("_s"), situations, context, detector, _array(CAVEATS)]
    document = F.struct(*[v.alias(n) for n, v in zip(DOCUMENT, values, strict=True)])
    return rows.select("gun", "request", event.alias("event_id"), F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
