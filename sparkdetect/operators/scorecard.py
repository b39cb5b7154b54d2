"""Coverage, precision and recall of alerts against labelled events, and a gate on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def executed_techniques(steps: DataFrame) -> DataFrame:
    """(run_id, scenario_id, ord, technique_id, name, tactic): techniques in order, each at its first step."""
    first = Window.partitionBy("run_id", "scenario_id", "technique_id").orderBy("ord")
    return steps.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("run_id", "scenario_id", "ord", "technique_id", "name", "tactic")


def coverage(events: DataFrame, alerts: DataFrame, executed: DataFrame) -> DataFrame:
    """A row for each run, scenario and executed technique: events, alerts on its events, true positives, detecting rules.

    ``alerts`` carries is_tp. An alert counts for the technique of its trigger.
    """
    keys = ["run_id", "scenario_id", "technique_id"]
    made = events.where("technique_id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("events_generated"))
    fired = alerts.where("event.technique_id IS NOT NULL").groupBy("run_id", "scenario_id", F.col("event.technique_id").alias("technique_id")).agg(
        F.count("*").alias("alerts_fired"), F.count_if("is_tp").alias("true_positives"), F.array_sort(F.collect_set(F.when(F.col("is_tp"), F.col("rule_id")))).alias("detecting_rules")
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("events_generated", "alerts_fired", "true_positives")}
    out = executed.join(made, keys, "left").join(fired, keys, "left").withColumns(zero)
    return with_status(out.withColumn("detecting_rules", F.coalesce("detecting_rules", F.array().cast("array<string>"))))


def with_status(rows: DataFrame) -> DataFrame:
    """detected: a true positive at least; status full (as many as events), partial or none."""
    tp, made = F.col("true_positives"), F.col("events_generated")
    status = F.when(tp <= 0, "none").when(tp >= made, "full").otherwise("partial")
    return rows.withColumns({"detected": tp > 0, "status": status})


def merged(cover: DataFrame, keep: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Coverage over scenarios: sums, the union of the rules, name and tactic as first seen."""
    first = F.min_by(F.struct("name", "tactic"), F.struct("scenario_id", "ord"))
    out = cover.groupBy(*keep, "technique_id").agg(
        first.alias("f"), F.sum("events_generated").alias("events_generated"), F.sum("alerts_fired").alias("alerts_fired"), F.sum("true_positives").alias("true_positives"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("detecting_rules")))).alias("detecting_rules"),
    )
    return with_status(out.select(*keep, "technique_id", "f.name", "f.tactic", "events_generated", "alerts_fired", "true_positives", "detecting_rules"))


def grade(f1: Column) -> Column:
    return F.when(f1 >= 0.9, "A").when(f1 >= 0.8, "B").when(f1 >= 0.65, "C").when(f1 >= 0.5, "D").otherwise("F")


def summary(events: DataFrame, alerts: DataFrame, cover: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """A row for each of ``keys``: totals, technique recall, precision, F1, event recall, alerts for each true positive, grade.

    ``cover`` is merged coverage. Empty denominators give 0; event recall counts distinct triggers of true
    positives and is 1 at most.
    """
    e = events.groupBy(*keys).agg(F.count("*").alias("total_events"), F.count_if(F.col("technique_id").isNotNull()).alias("malicious_events"))
    a = alerts.groupBy(*keys).agg(
        F.count("*").alias("total_alerts"), F.count_if("is_tp").alias("true_positives"), F.count_if(~F.col("is_tp")).alias("false_positives"), F.countDistinct(F.when(F.col("is_tp"), F.col("event.event_id"))).alias("_hit"),
    )
    c = cover.groupBy(*keys).agg(F.count("*").alias("techniques"), F.count_if("detected").alias("techniques_detected"))
    out = e.join(a, list(keys), "left").join(c, list(keys), "left").na.fill(0)
    out = out.withColumns({"technique_recall": ratio(F.col("techniques_detected"), F.col("techniques")), "precision": ratio(F.col("true_positives"), F.col("total_alerts")), "event_recall": F.least(F.lit(1.0), ratio(F.col("_hit"), F.col("malicious_events")))})
    p, r = F.col("precision"), F.col("technique_recall")
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    noise = F.when(F.col("true_positives") > 0, F.col("total_alerts") / F.col("true_positives")).otherwise(F.col("total_alerts").cast("double"))
    return out.withColumns({"alerts_per_tp": noise, "grade": grade(F.col("f1"))}).drop("_hit")


def gaps(cover: DataFrame, status: str = "none") -> DataFrame:
    """Techniques of a status, those with most events first."""
    return cover.where(F.col("status") == status).orderBy(F.col("events_generated").desc(), "technique_id")


def by_tactic(cover: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    out = cover.groupBy(*keys, "tactic").agg(F.count("*").alias("total"), F.count_if("detected").alias("detected"), F.array_sort(F.collect_set("technique_id")).alias("techniques"))
    return out.withColumn("coverage", ratio(F.col("detected"), F.col("total")))


def by_rule(alerts: DataFrame) -> DataFrame:
    out = alerts.groupBy("rule_id", "rule_title").agg(F.count_if("is_tp").alias("true_positives"), F.count_if(~F.col("is_tp")).alias("false_positives"))
    return out.withColumn("fp_rate", ratio(F.col("false_positives"), F.col("true_positives") + F.col("false_positives")))


def noisiest(alerts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rules with most false positives, of those that have any."""
    return by_rule(alerts).where("false_positives > 0").orderBy(F.col("false_positives").desc(), "rule_id").limit(k)


def by_scenario(events: DataFrame, alerts: DataFrame, executed: DataFrame) -> DataFrame:
    """A row for each run and scenario: events, alerts, duration, and techniques detected (of a true positive's trigger) and missed."""
    keys = ["run_id", "scenario_id"]
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    e = events.groupBy(*keys).agg(F.count("*").alias("events"), seconds.alias("duration_seconds"))
    a = alerts.groupBy(*keys).agg(F.count("*").alias("alerts"), F.collect_set(F.when(F.col("is_tp"), F.col("event.technique_id"))).alias("hit"))
    x = executed.groupBy(*keys).agg(F.collect_set("technique_id").alias("ran"))
    none = F.array().cast("array<string>")
    out = e.join(a, keys, "left").join(x, keys, "left").withColumns({"hit": F.coalesce("hit", none), "ran": F.coalesce("ran", none), "alerts": F.coalesce("alerts", F.lit(0).cast("long"))})
    return out.select(*keys, "events", "alerts", "duration_seconds", F.array_sort("hit").alias("detected"), F.array_sort(F.array_except("ran", "hit")).alias("missed"))


def metrics(score: DataFrame) -> DataFrame:
    """The eight figures by which two rule sets are compared."""
    return score.select("run_id", "technique_recall", "precision", "f1", "event_recall", "alerts_per_tp", "total_alerts", "true_positives", "grade")


def gate(score: DataFrame, floors: dict[str, float], rule_errors: int = 0, robustness: DataFrame | None = None, frameworks: DataFrame | None = None) -> DataFrame:
    """(run_id, check, actual, floor, passed): figures against floors, the weakest framework's coverage, and no rule errors.

    ``robustness`` has one row with a column score, ``frameworks`` a coverage for each framework.
    """
    rows = score.select("run_id", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("double").alias("actual"), F.lit(v).alias("floor")) for n, v in floors.items() if n in score.columns])).alias("x")).select("run_id", "x.*")
    for name, table, value in (("robustness", robustness, "score"), ("control_coverage", frameworks, "coverage")):
        if table is not None and name in floors:
            one = table.agg(F.min(value).cast("double").alias("actual"))
            rows = rows.unionByName(score.select("run_id").crossJoin(F.broadcast(one)).select("run_id", F.lit(name).alias("check"), "actual", F.lit(floors[name]).alias("floor")))
    rows = rows.unionByName(score.select("run_id", F.lit("rule_errors").alias("check"), F.lit(float(-rule_errors)).alias("actual"), F.lit(0.0).alias("floor")))
    return rows.withColumn("passed", F.coalesce(F.col("actual") >= F.col("floor"), F.lit(False)))
