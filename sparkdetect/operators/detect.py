"""Detection: every enabled rule on every event in one scan; alerts and their ground truth."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Field
from .rule_index import indexed_hits
from .rules import SEVERITIES, Correlation, Rule, compile_all

#: What alerts keep of an event. A missing column is null.
EVENT = {"event_id": "string", "ts": "timestamp", "event_type": "string", "host": "string", "user": "string", "technique_id": "string", "tactic": "string", "destination": "string", "domain": "string"}
SCOPE = ("run_id", "scenario_id")
#: Rules whose conditions are laid into one array, and the number of rules above which an index of their terms is used.
CHUNK, MANY = 200, 400
HEAD = "rule_id string, rule_title string, severity string, severity_rank int, techniques array<string>, rule_tactic string"


def event_struct(events: DataFrame) -> Column:
    have = set(events.columns)
    return F.struct(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in EVENT.items()])


def _head(rule: Rule | Correlation) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.title).alias("rule_title"), F.lit(rule.severity).alias("severity"), F.lit(SEVERITIES.index(rule.severity)).alias("severity_rank"),
        F.array(*map(F.lit, rule.techniques)).cast("array<string>").alias("techniques"), F.lit(rule.tactic).alias("rule_tactic"),
    )


def scoped(events: DataFrame) -> DataFrame:
    """Events with run_id and scenario_id, empty where the table has none."""
    return events.withColumns({c: F.lit("") for c in SCOPE if c not in events.columns})


def with_alert_id(alerts: DataFrame) -> DataFrame:
    """A content hash of scope, rule and events: the same in every run of the same data."""
    ids = F.array_sort(F.transform(F.concat(F.array("event"), "supporting"), lambda e: F.coalesce(e["event_id"], F.lit(""))))
    key = F.concat_ws("\u0000", *SCOPE, "rule_id", F.array_join(ids, "\u0000"))
    return alerts.withColumn("alert_id", F.substring(F.sha2(key, 256), 1, 16))


def _any(conditions: list[Column]) -> Column:
    """Their OR, as a tree of low depth."""
    while len(conditions) > 1:
        conditions = [reduce(Column.__or__, conditions[i : i + 8]) for i in range(0, len(conditions), 8)]
    return conditions[0] if conditions else F.lit(False)


def detect(events: DataFrame, rules: Iterable[Rule], fields: Callable[[str], Field | None]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(alerts, errors): a row for each event and enabled rule that matches it, and the rules that do not compile.

    One scan: a row that no rule matches is dropped by the OR of all conditions before anything is built for it.
    Works on streams too. An event that is there twice gives two alerts of one id. More than ``MANY`` rules go through
    an index of their terms instead of one Column each, with the same result.
    """
    rules, base = [r for r in rules if r.enabled], scoped(events)
    if len(rules) > MANY:
        return detect_indexed(events, rules, fields)
    good, bad = compile_all(rules, fields)
    any_of = _any([c for _, c in good])
    # arrays of some conditions each keep generated methods small
    some = [F.array(*[F.when(c, _head(r)) for r, c in good[i : i + CHUNK]]) for i in range(0, len(good), CHUNK)]
    hits = F.filter(F.concat(*some), lambda x: x.isNotNull()) if some else F.array().cast("array<struct<rule_id:string,rule_title:string,severity:string,severity_rank:int,techniques:array<string>,rule_tactic:string>>")
    alerts = base.where(any_of).select(*SCOPE, event_struct(base).alias("event"), F.explode(hits).alias("hit")).select(*SCOPE, "hit.*", "event")
    return _single(alerts), bad


def _single(alerts: DataFrame) -> DataFrame:
    none = F.array().cast(alerts.select(F.array("event")).schema[0].dataType)
    return with_alert_id(alerts.withColumns({"supporting": none, "correlation_type": F.lit("")}))


def detect_indexed(events: DataFrame, rules: Iterable[Rule], fields: Callable[[str], Field | None]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``detect`` for very many rules: one scan, and only rules of which a term holds are judged."""
    base = scoped(events)
    hits, good, bad = indexed_hits(base.withColumn("_event", event_struct(base)), [r for r in rules if r.enabled], fields, [*SCOPE, "_event"])
    if hits is None:
        return detect(events, [], fields)[0], bad
    heads = events.sparkSession.createDataFrame([(i, r.rule_id, r.title, r.severity, SEVERITIES.index(r.severity), list(r.techniques), r.tactic) for i, r in enumerate(good)], f"rule int, {HEAD}")
    # a row for each rule
    return _single(hits.join(F.broadcast(heads), "rule").select(*SCOPE, *heads.columns[1:], F.col("_event").alias("event"))), bad


def claims(techniques: Column, actual: Column) -> Column:
    """Does a rule for ``techniques`` claim an event of technique ``actual``? Never a benign one; a rule without techniques any other.

    A technique that starts with the event's base technique counts too, so sub-techniques of one base claim each other.
    """
    base = F.substring_index(actual, ".", 1)
    some = F.exists(techniques, lambda t: (t == actual) | (t == base) | t.startswith(base))
    return F.coalesce(actual.isNotNull() & ((F.size(techniques) == 0) | some), F.lit(False))


def all_events() -> Column:
    """Trigger and supporting events, once for each id."""
    both = F.concat(F.array("event"), "supporting")
    return F.aggregate(
        both, F.slice(both, 1, 0), lambda acc, e: F.when(F.exists(acc, lambda a: a["event_id"].eqNullSafe(e["event_id"])), acc).otherwise(F.concat(acc, F.array(e)))
    )


def with_truth(alerts: DataFrame) -> DataFrame:
    """Add is_tp (a claim on the trigger; for correlations on any event of the chain) and purity (the share of malicious events)."""
    chain = F.exists(F.concat(F.array("event"), "supporting"), lambda e: claims(F.col("techniques"), e["technique_id"]))
    tp = F.when(F.size("supporting") > 0, chain).otherwise(claims(F.col("techniques"), F.col("event.technique_id")))
    events = all_events()
    bad = F.size(F.filter(events, lambda e: e["technique_id"].isNotNull()))
    return alerts.withColumn("is_tp", tp).withColumn("purity", bad / F.size(events))


def ordered(alerts: DataFrame) -> DataFrame:
    """By time, then severity from the highest; for output only."""
    return alerts.orderBy("event.ts", F.col("severity_rank").desc(), "rule_id", "alert_id")


def top_alerts(alerts: DataFrame, n: int = 25) -> DataFrame:
    return ordered(alerts).limit(n)


def combined(single: DataFrame, correlated: DataFrame) -> DataFrame:
    return single.unionByName(correlated)
