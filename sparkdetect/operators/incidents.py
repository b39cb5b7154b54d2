"""Incidents: alerts that share a host, user or destination within a window, as components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import with_previous
from ..functions.tables import stored
from .detect import all_events
from .graph import components

WINDOW_SECONDS = 900
# Tactics in kill-chain order, tactics of techniques, risk by severity.
TACTIC_ORDER = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)
TECHNIQUE_TACTICS = {
    "T1003": "credential-access", "T1003.001": "credential-access", "T1021": "lateral-movement", "T1021.002": "lateral-movement", "T1041": "exfiltration", "T1046": "discovery", "T1052": "exfiltration", "T1052.001": "exfiltration",
    "T1059": "execution", "T1059.001": "execution", "T1087": "discovery", "T1087.002": "discovery", "T1133": "initial-access", "T1134": "privilege-escalation", "T1134.001": "privilege-escalation", "T1213": "collection",
    "T1213.003": "collection", "T1486": "impact", "T1490": "impact", "T1546": "persistence", "T1546.003": "persistence", "T1560": "collection", "T1560.001": "collection", "T1562": "defense-evasion",
    "T1562.001": "defense-evasion", "T1566": "initial-access", "T1566.001": "initial-access", "T1567": "exfiltration", "T1567.002": "exfiltration",
}
SEVERITY_RISK = {"info": 10.0, "low": 25.0, "medium": 50.0, "high": 75.0, "critical": 95.0}


def distinct_firings(alerts: DataFrame) -> DataFrame:
    """Alerts of one id get occurrence numbers in their ids, so that each stays a row of its own."""
    own = Window.partitionBy("alert_id").orderBy("event.ts", "rule_id")
    n = F.row_number().over(own)
    return alerts.withColumn("alert_id", F.when(n == 1, F.col("alert_id")).otherwise(F.concat("alert_id", F.lit("-"), n.cast("string"))))


def entities(alerts: DataFrame) -> DataFrame:
    """(run_id, alert_id, ts, entity): distinct hosts, users, destination addresses and destination domains of all events of an alert, case folded; time is the trigger's."""
    rows = alerts.select("run_id", "alert_id", F.col("event.ts").alias("ts"), F.explode(F.concat(F.array("event"), "supporting")).alias("e"))
    return rows.select("run_id", "alert_id", "ts", F.explode(_entities(F.col("e"))).alias("entity")).distinct()


def _entities(e: Column) -> Column:
    of = lambda kind, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(kind + ":"), folded(v)))
    return F.array_compact(F.array(of("host", e["host"]), of("user", e["user"]), of("destination", e["destination"]), of("destination", e["domain"])))


def folded(text: Column) -> Column:
    """Lower case of upper case, ß as ss and the final sigma as any other."""
    return F.replace(F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def edges(alert_entities: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """(src, dst): alerts that follow each other on an entity within the window. Consecutive ones give the same components as all pairs."""
    if window < 0:
        raise ValueError("the window must not be negative")
    rows = with_previous(alert_entities, ["run_id", "entity"], ["ts", "alert_id"], {"src": "alert_id", "_t": "ts"})
    near = F.unix_micros("ts") - F.unix_micros("_t") <= window * 1_000_000
    return rows.where(F.col("src").isNotNull() & near).select("src", F.col("alert_id").alias("dst")).distinct()


def alert_risk() -> Column:
    """The triage score within 0 to 100, else by severity."""
    table = F.lit(0.0)
    for s, r in SEVERITY_RISK.items():
        table = F.when(F.col("severity") == s, r).otherwise(table)
    own = F.col("risk_score").cast("double")
    return F.when(own.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), own))).otherwise(table)


def tactic_table(mapping: dict[str, str] | None = None) -> Column:
    """The tactics of techniques; ``mapping`` adds to them and overrides them."""
    pairs = [x for kv in (TECHNIQUE_TACTICS | (mapping or {})).items() for x in map(F.lit, kv)]
    return F.create_map(*pairs)


def members(alerts: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """(incident, evidence, risk and the alert's columns): each alert with its component, stored once for all that reads it."""
    own = stored(distinct_firings(alerts if "risk_score" in alerts.columns else alerts.withColumn("risk_score", F.lit(None).cast("int"))))
    label = components(edges(entities(own), window))
    ids = F.array_sort(F.transform(all_events(), lambda e: F.coalesce(e["event_id"], F.lit(""))))
    member = own.join(label.withColumnRenamed("node", "alert_id"), "alert_id", "left").withColumn("incident", F.coalesce("label", "alert_id")).drop("label")
    return stored(member.withColumns({"evidence": ids, "risk": alert_risk()}))


def lineage(member: DataFrame) -> DataFrame:
    """(incident, alert_id, rule_id, event_ids, entities): a row for each alert, what an incident rests on."""
    every = F.array_sort(F.array_distinct(F.flatten(F.transform(F.concat(F.array("event"), "supporting"), _entities))))
    return member.select("incident", "alert_id", "rule_id", F.col("evidence").alias("event_ids"), every.alias("entities"))


def figures(member: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(incident, alerts, started_at, ended_at, risk_score, confidence): a row for each incident by sums and counts, however many alerts it gathers."""
    # the same rule on the same events counts once, at its highest risk
    once = member.groupBy("incident", "rule_id", "evidence").agg(F.max("risk").alias("risk"))
    risk = once.groupBy("incident").agg((100 * (1 - F.product(1 - F.col("risk") / 100))).alias("risk_score"), F.count("*").alias("_firings"))
    count = lambda rows, c, name: rows.distinct().groupBy("incident").agg(F.count(c).alias(name))
    names = count(lineage(member).select("incident", F.explode("entities").alias("x")), "x", "_entities")
    proof = count(member.select("incident", F.explode("evidence").alias("x")), "x", "_evidence")
    stages = count(_stages(member, mapping).select("incident", "tactic"), "tactic", "_tactics")
    base = member.groupBy("incident").agg(F.min("event.ts").alias("started_at"), F.max("event.ts").alias("ended_at"), F.countDistinct("rule_id").alias("_rules"), F.count("*").alias("alerts"))
    out = base.join(risk, "incident").join(names, "incident", "left").join(proof, "incident", "left").join(stages, "incident", "left").fillna(0, ["_entities", "_evidence", "_tactics"])
    part = lambda a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), a) / b)
    sure = 0.15 + 0.25 * part(F.col("_rules") - 1, 3.0) + 0.2 * part(F.col("_entities") - 1, 4.0) + 0.2 * part(F.col("_evidence"), 5.0) + 0.2 * part(F.col("_tactics"), 4.0)
    return out.select("incident", "alerts", "started_at", "ended_at", F.round("risk_score", 2).alias("risk_score"), F.round(sure * F.col("_firings") / F.col("alerts"), 3).alias("confidence"))


def reconstruct(alerts: DataFrame, window: int = WINDOW_SECONDS, mapping: dict[str, str] | None = None) -> DataFrame:
    """A row for each incident: id, alerts, start, end, risk, confidence, entities, tactics in kill-chain order, evidence.

    Ground truth takes no part. ``alerts`` may have risk_score. This is the listing, whose arrays hold all alerts of an
    incident; ``members``, ``lineage`` and ``figures`` give the same as long tables.
    """
    member = members(alerts, window)
    rows = lineage(member)
    names = rows.select("incident", F.explode("entities").alias("entity")).distinct().groupBy("incident").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    listed = rows.groupBy("incident").agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"), F.array_sort(F.collect_list(F.struct("alert_id", "rule_id", "event_ids", "entities"))).alias("evidence_lineage"))
    stages = progression(member, mapping).groupBy("incident").agg(F.array_sort(F.collect_list(F.struct("rank", "tactic", "first_seen", "techniques", "alert_ids"))).alias("p"))
    none = stages.schema["p"].dataType
    out = figures(member, mapping).join(listed, "incident").join(names, "incident", "left").join(stages, "incident", "left")
    out = out.withColumns({"entities": F.coalesce("entities", F.array().cast("array<string>")), "p": F.coalesce("p", F.array().cast(none))})
    ident = F.concat(F.lit("inc-"), F.substring(F.sha2(F.array_join("alert_ids", "\u0000"), 256), 1, 16))
    return out.select(
        ident.alias("incident_id"), "alert_ids", "alerts", "started_at", "ended_at", "risk_score", "confidence", "entities",
        F.transform("p", lambda s: F.struct(s["tactic"].alias("tactic"), s["first_seen"].alias("first_seen"), s["techniques"].alias("techniques"), s["alert_ids"].alias("alert_ids"))).alias("tactic_progression"), "evidence_lineage",
    )


def _stages(member: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """(incident, alert_id, ts, technique, tactic) for each technique of an alert whose tactic is known."""
    table = tactic_table(mapping)
    rows = member.select("incident", "alert_id", F.col("event.ts").alias("ts"), F.explode(F.array_distinct("techniques")).alias("technique"))
    tactic = F.coalesce(F.try_element_at(table, F.col("technique")), F.try_element_at(table, F.substring_index("technique", ".", 1)))
    return rows.withColumn("tactic", tactic).where("tactic IS NOT NULL")


def progression(member: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(incident, tactic, rank, first_seen, techniques, alert_ids): tactics by exact technique, else by its base; unknown ones drop out."""
    order = F.array_position(F.array(*map(F.lit, TACTIC_ORDER)), F.col("tactic"))
    out = _stages(member, mapping).groupBy("incident", "tactic").agg(F.min("ts").alias("first_seen"), F.array_sort(F.collect_set("technique")).alias("techniques"), F.array_sort(F.collect_set("alert_id")).alias("alert_ids"))
    return out.withColumn("rank", F.when(order > 0, order - 1).otherwise(len(TACTIC_ORDER)).cast("int"))


def ranked(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.col("risk_score").desc(), F.col("confidence").desc(), "started_at", "incident_id")


def truth(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """(incident_id, alert_purity, event_purity): kept apart from the incidents; ``alerts`` has is_tp."""
    member = incidents.select("incident_id", F.explode("alert_ids").alias("alert_id"))
    own = distinct_firings(alerts).select("alert_id", "is_tp", F.explode(F.concat(F.array("event"), "supporting")).alias("e"))
    rows = member.join(own, "alert_id")
    bad = rows.groupBy("incident_id").agg(
        (F.countDistinct(F.when(F.col("is_tp"), F.col("alert_id"))) / F.countDistinct("alert_id")).alias("alert_purity"),
        (F.countDistinct(F.when(F.col("e.technique_id").isNotNull(), F.col("e.event_id"))) / F.countDistinct("e.event_id")).alias("event_purity"),
    )
    return bad


def compression(incidents: DataFrame) -> DataFrame:
    """One row: alerts, incidents and their ratio."""
    out = incidents.agg(F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"), F.count("*").alias("incidents"))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("alerts").cast("double"), F.col("incidents").cast("double")), F.lit(0.0)))
