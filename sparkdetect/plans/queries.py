"""Queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import FlatFields
from ..functions.predicates import selection
from ..operators import baseline, controls, drafting, exposure, incidents, robustness, scorecard, stats, triage
from ..operators.correlate import correlate_one
from ..operators.detect import detect, with_truth
from ..operators.rules import Rule, compiled, errors_table, rule_listing, rules_table, validate
from ..sources.events import layer_techniques, scenario_listing
from ..streaming.jobs import correlate_stream, detect_stream, settled
from . import packs
from .telemetry import ALERTS, CATALOGUE, CORRELATIONS, COVER, EXECUTED, RULES, SQL_RULES, TELE, TRUTH, alerts, executed, telemetry, telemetry_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _matching(df: DataFrame, detection: dict, condition: str, keep: str) -> DataFrame:
    return df.where(compiled(Rule("Q", detection, condition), FlatFields(df))).select(keep)


# -- predicates and detection


@query("SELECT event_id FROM events WHERE lower(event_type) = 'error' AND value >= 100")
def rule_exact_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark.read.parquet(f"{sf_dir}/events.parquet"), {"s": {"event_type": "Error", "value|gte": "100"}}, "s", "event_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_quantity < 50 AND l_discount >= 0.05 AND l_discount <= 0.07 AND NOT l_linenumber = 1""")
def rule_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rule = Rule("Q", {"q": {"l_quantity|gt": 45, "l_quantity|lt": 50}, "d": {"l_discount|gte": 0.05, "l_discount|lte": 0.07}, "n": {"l_linenumber": 1}}, "q and d and not n")
    return df.where(compiled(rule, FlatFields(df))).select("l_orderkey", "l_linenumber")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'rights reserved') OR starts_with(lower(text), 'licensed') OR ends_with(lower(text), 'the.')
   OR regexp_matches(text, '(?i)(password|token)[ ]*[=:]') OR regexp_matches(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')""")
def rule_text_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sel = {"c": {"text|contains": "Rights Reserved"}, "s": {"text|startswith": "LICENSED"}, "e": {"text|endswith": "the."}, "r": {"text|re": ["(password|token)[ ]*[=:]", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"]}}
    return _matching(df, sel, "any of them", "doc_id")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('f', 'p') AND o_orderpriority IS NOT NULL AND o_custkey IN (1, 2, 3, 10, 50, 77)")
def rule_in_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _matching(df, {"a": {"o_orderstatus|in": ["F", "P"], "o_orderpriority|exists": True, "nothing|exists": "false"}, "b": {"o_custkey|in": [1, "2", 3, 10, 50, 77]}}, "all of them", "o_orderkey")


@query("""SELECT event_id FROM (SELECT event_id, (event_type = 'error')::INT + (value > 50)::INT + (user_id < 40)::INT AS n, event_type LIKE 'p%' OR value > 200 AS alt FROM events) WHERE n >= 2 OR (alt AND n = 0)""")
def rule_quantifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    sel = {"x_1": {"event_type": "error"}, "x_2": {"value|gt": 50}, "x_3": {"user_id|lt": 40}, "alt": [{"event_type|startswith": "P"}, {"value|gt": 200}]}
    return _matching(df, sel, "2 of x_* OR (alt AND NOT 1 of x_*)", "event_id")


@query(f"WITH {ALERTS} SELECT run_id, scenario_id, alert_id, rule_id, severity_rank, event_id, is_tp FROM alerts")
def multi_rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).select("run_id", "scenario_id", "alert_id", "rule_id", "severity_rank", F.col("event.event_id").alias("event_id"), "is_tp")


@query(f"WITH {ALERTS} SELECT rule_id, event_id, ts FROM alerts ORDER BY ts, severity_rank DESC, rule_id LIMIT 25")
def top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.detect import top_alerts as top

    return top(alerts(spark, sf_dir)).select("rule_id", F.col("event.event_id").alias("event_id"), F.col("event.ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {ALERTS} SELECT r.rule_id, r.severity, count(a.event_id) AS alerts, r.status FROM (VALUES
  {', '.join(f"('{r.rule_id}', '{r.severity}', '{'invalid' if r.rule_id == 'R-BAD' else 'ok' if r.enabled else 'disabled'}')" for r in RULES)}) r(rule_id, severity, status)
  LEFT JOIN alerts a ON a.rule_id = r.rule_id GROUP BY ALL""")
def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    found, _ = detect(t, RULES, FlatFields(t))
    listing = rule_listing(rules_table(spark, RULES), errors_table(spark, validate(RULES, FlatFields(t))))
    n = found.groupBy("rule_id").agg(F.count("*").alias("alerts"))
    return listing.join(n, "rule_id", "left").select("rule_id", "severity", F.coalesce("alerts", F.lit(0).cast("long")).alias("alerts"), "status")


def _many_rules(n: int = 3000) -> list[Rule]:
    """Rules made by a formula, on users, kinds, parts of words, bounds and exceptions."""
    kinds, parts = ("error", "click", "view", "signup", "purchase"), ("ER", "ic", "ew", "ign", "ur")
    return [
        Rule(f"M{i:04}", {"who": {"user": str(i % 150)}, "what": [{"event_type": kinds[i % 5]}, {"event_type|contains": parts[i // 150 % 5], "k|lt": 10}], "big": {"value|gte": 10 * (i % 7)}, "not_now": {"k": [i % 100, i % 97]}}, "who and what and (big or 2 of not_*) and not not_now" if i % 2 else "all of who and 2 of them and not not_now")
        for i in range(n)
    ]


@query(f"""WITH {TELE}, r AS (SELECT i::INT AS i, ['error', 'click', 'view', 'signup', 'purchase'][i % 5 + 1] AS kind, ['er', 'ic', 'ew', 'ign', 'ur'][i // 150 % 5 + 1] AS part FROM range(3000) t(i)
), m AS (SELECT r.i, tele.event_id, usr = (i % 150)::VARCHAR AS who, event_type = kind OR (contains(event_type, part) AND k < 10) AS what, value >= 10 * (i % 7) AS big, k IN (i % 100, i % 97) AS not_now FROM tele JOIN r ON usr = (i % 150)::VARCHAR)
SELECT 'M' || lpad(i::VARCHAR, 4, '0') AS rule_id, event_id FROM m WHERE NOT not_now AND CASE WHEN i % 2 = 1 THEN what AND big ELSE who::INT + what::INT + big::INT >= 2 END""")
def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3,000 rules in one scan."""
    t = telemetry(spark, sf_dir)
    return detect(t, _many_rules(), FlatFields(t))[0].select("rule_id", F.col("event.event_id").alias("event_id"))


# -- correlation


def _correlated(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all")})
    return _chains(correlate_one(t, CORRELATIONS[i], FlatFields(t)))


def _chains(found: DataFrame) -> DataFrame:
    found = with_truth(found)
    ids = F.array_join(F.transform(F.concat("supporting", F.array("event")), lambda e: e["event_id"]), ",")
    return found.select("rule_id", "correlation_type", ids.alias("chain"), "is_tp", F.round("purity", 6).alias("purity"))


def _counted_sql(i: int, where: str, value: str, fires: str) -> str:
    c = CORRELATIONS[i]
    tp = "len(list_filter(list_slice(techs_of, s, i), lambda t: t IN ('T1059.001', 'T1059'))) > 0" if i == 0 else "len(list_filter(list_slice(techs_of, s, i), lambda t: t IS NOT NULL)) > 0"
    return f"""WITH RECURSIVE {TELE}, ev AS (SELECT usr, event_id, technique_id, {value} AS v, row_number() OVER w AS i,
  count(*) OVER (PARTITION BY usr ORDER BY epoch_us(ts) RANGE BETWEEN {c.window * 1_000_000} PRECEDING AND CURRENT ROW) AS near FROM tele WHERE {where} WINDOW w AS (PARTITION BY usr ORDER BY ts, event_id)
), lists AS (SELECT usr, list(event_id ORDER BY i) AS ids, list(technique_id ORDER BY i) AS techs_of, list(v ORDER BY i) AS vals, list(i - near + 1 ORDER BY i) AS firsts FROM ev GROUP BY usr
), run(usr, i, s, fired) AS (SELECT usr, 1::BIGINT, 1::BIGINT, false FROM lists
  UNION ALL SELECT usr, i, s, {fires} FROM (SELECT r.usr, r.i + 1 AS i, CASE WHEN r.fired THEN r.i + 1 ELSE greatest(r.s, l.firsts[r.i + 1]) END AS s, l.vals AS vals, len(l.ids) AS n FROM run r JOIN lists l USING (usr)) WHERE i <= n
) SELECT '{c.rule_id}' AS rule_id, '{c.kind}:user=' || usr AS correlation_type, array_to_string(list_slice(ids, s, i), ',') AS chain, {tp} AS is_tp,
  round(len(list_filter(list_slice(techs_of, s, i), lambda t: t IS NOT NULL)) / (i - s + 1), 6) AS purity
FROM run JOIN lists USING (usr) WHERE fired"""


@query(_counted_sql(0, "event_type = 'error'", "event_id", "i - s + 1 >= 3"))
def corr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlated(spark, sf_dir, 0)


@query(_counted_sql(1, "value >= 20", "event_type", "len(list_distinct(list_slice(vals, s, i))) >= 4"))
def corr_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlated(spark, sf_dir, 1)


@query(f"""WITH RECURSIVE {TELE}, a AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY ts, event_id) AS i FROM tele WHERE event_type = 'signup'
), b AS (SELECT usr, list({{'t': epoch_us(ts), 'id': event_id, 'tech': technique_id}} ORDER BY ts, event_id) AS bs FROM tele WHERE event_type = 'purchase' GROUP BY usr
), run(usr, i, used, hit) AS (SELECT DISTINCT usr, 0::BIGINT, []::VARCHAR[], NULL::STRUCT(t BIGINT, id VARCHAR, tech VARCHAR) FROM a
  UNION ALL SELECT usr, i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.id) END, hit FROM (
    SELECT r.usr, r.i + 1 AS i, r.used AS used, list_filter(coalesce(b.bs, []), lambda x: x.t > epoch_us(a.ts) AND x.t <= epoch_us(a.ts) + 43200000000 AND NOT list_contains(r.used, x.id))[1] AS hit
    FROM run r JOIN a ON a.usr = r.usr AND a.i = r.i + 1 LEFT JOIN b ON b.usr = r.usr)
) SELECT 'C-SEQ' AS rule_id, 'sequence:user=' || run.usr AS correlation_type, a.event_id || ',' || hit.id AS chain, coalesce(starts_with(hit.tech, 'T1003') OR starts_with(a.technique_id, 'T1003'), false) AS is_tp,
  round(((hit.tech IS NOT NULL)::INT + (a.technique_id IS NOT NULL)::INT) / 2, 6) AS purity
FROM run JOIN a ON a.usr = run.usr AND a.i = run.i WHERE hit IS NOT NULL""")
def corr_sequence_2stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlated(spark, sf_dir, 2)


# -- streams: a run over all files with a checkpoint, its sink read back


@query(f"WITH {ALERTS} SELECT run_id, scenario_id, alert_id, rule_id, event_id FROM alerts")
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry_stream(spark, sf_dir)
    return settled(detect_stream(t, RULES, FlatFields(t)).select("run_id", "scenario_id", "alert_id", "rule_id", F.col("event.event_id").alias("event_id")))


@query(SQL["corr_threshold"])
def stream_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry_stream(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all")})
    return _chains(settled(correlate_stream(t, CORRELATIONS[0], FlatFields(t), "0 seconds")))


@query(SQL["corr_sequence_2stage"])
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry_stream(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all")})
    return _chains(settled(correlate_stream(t, CORRELATIONS[2], FlatFields(t), "0 seconds")))


# -- ground truth and score


def _cover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, a = telemetry(spark, sf_dir), alerts(spark, sf_dir)
    return t, a, scorecard.merged(scorecard.coverage(t, a, executed(spark, sf_dir)))


@query(f"WITH {COVER} SELECT run_id, technique_id, name, tactic, events_generated, alerts_fired, true_positives, array_to_string(detecting_rules, ',') AS rules, detected, status FROM covered")
def coverage_by_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cover(spark, sf_dir)[2].withColumn("rules", F.array_join("detecting_rules", ",")).drop("detecting_rules")


_SUMMARY = f"""{COVER}, totals AS (SELECT run_id, count(*) AS total_events, count(technique_id) AS malicious_events FROM tele GROUP BY run_id
), al AS (SELECT run_id, count(*) AS total_alerts, count(*) FILTER (is_tp) AS true_positives, count(*) FILTER (NOT is_tp) AS false_positives, count(DISTINCT event_id) FILTER (is_tp) AS hit FROM alerts GROUP BY run_id
), co AS (SELECT run_id, count(*) AS techniques, count(*) FILTER (detected) AS techniques_detected FROM covered GROUP BY run_id
), base AS (SELECT *, coalesce(techniques_detected / nullif(techniques, 0), 0) AS technique_recall, coalesce(true_positives / nullif(total_alerts, 0), 0) AS precision, least(1, coalesce(hit / nullif(malicious_events, 0), 0)) AS event_recall
  FROM totals LEFT JOIN al USING (run_id) LEFT JOIN co USING (run_id)
), score AS (SELECT *, coalesce(2 * precision * technique_recall / nullif(precision + technique_recall, 0), 0) AS f1, CASE WHEN true_positives > 0 THEN total_alerts / true_positives ELSE total_alerts END AS alerts_per_tp FROM base
), graded AS (SELECT *, CASE WHEN f1 >= 0.9 THEN 'A' WHEN f1 >= 0.8 THEN 'B' WHEN f1 >= 0.65 THEN 'C' WHEN f1 >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM score)"""


@query(f"""WITH {_SUMMARY} SELECT run_id, total_events, malicious_events, total_alerts, true_positives, false_positives, techniques, techniques_detected, round(technique_recall, 6) AS technique_recall,
  round(precision, 6) AS precision, round(event_recall, 6) AS event_recall, round(f1, 6) AS f1, round(alerts_per_tp, 6) AS alerts_per_tp, grade FROM graded""")
def scorecard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorecard.summary(*_cover(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("technique_recall", "precision", "event_recall", "f1", "alerts_per_tp")})


@query(f"WITH {COVER} SELECT run_id, tactic, count(*) AS total, count(*) FILTER (detected) AS detected, array_to_string(list_sort(list(DISTINCT technique_id)), ',') AS techniques, round(count(*) FILTER (detected) / count(*), 6) AS coverage FROM covered GROUP BY run_id, tactic")
def coverage_by_tactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.by_tactic(_cover(spark, sf_dir)[2]).withColumns({"techniques": F.array_join("techniques", ","), "coverage": F.round("coverage", 6)})


@query(f"WITH {ALERTS} SELECT rule_id, rule_title, count(*) FILTER (is_tp) AS true_positives, count(*) FILTER (NOT is_tp) AS false_positives, round(count(*) FILTER (NOT is_tp) / count(*), 6) AS fp_rate FROM alerts GROUP BY ALL HAVING count(*) FILTER (NOT is_tp) > 0 ORDER BY false_positives DESC, rule_id LIMIT 3")
def noisiest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.noisiest(alerts(spark, sf_dir), 3).withColumn("fp_rate", F.round("fp_rate", 6))


@query(f"WITH {COVER} SELECT run_id, technique_id, events_generated, status FROM covered WHERE status IN ('none', 'partial')")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = _cover(spark, sf_dir)[2]
    return scorecard.gaps(cover).unionByName(scorecard.gaps(cover, "partial")).select("run_id", "technique_id", "events_generated", "status")


@query(f"""WITH {ALERTS}, {EXECUTED}, e AS (SELECT run_id, scenario_id, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds FROM tele GROUP BY ALL
), a AS (SELECT run_id, scenario_id, count(*) AS alerts, coalesce(list(DISTINCT technique_id) FILTER (is_tp AND technique_id IS NOT NULL), []) AS hit FROM alerts GROUP BY ALL
), x AS (SELECT run_id, scenario_id, list(technique_id) AS ran FROM executed GROUP BY ALL)
SELECT run_id, scenario_id, events, round(duration_seconds, 3) AS duration_seconds, coalesce(alerts, 0) AS alerts, array_to_string(list_sort(coalesce(hit, [])), ',') AS detected, array_to_string(list_sort(list_filter(ran, lambda t: NOT list_contains(coalesce(hit, []), t))), ',') AS missed
FROM e LEFT JOIN a USING (run_id, scenario_id) LEFT JOIN x USING (run_id, scenario_id)""")
def scenario_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorecard.by_scenario(telemetry(spark, sf_dir), alerts(spark, sf_dir), executed(spark, sf_dir))
    return out.withColumns({"detected": F.array_join("detected", ","), "missed": F.array_join("missed", ","), "duration_seconds": F.round("duration_seconds", 3)})


_FLOORS = {"technique_recall": 0.55, "precision": 0.35, "control_coverage": 0.5}


@query(f"""WITH {TELE}, {EXECUTED}, f AS (SELECT scenario_id, tactic, min(ord) AS first FROM executed GROUP BY ALL)
SELECT e.scenario_id, count(*) AS steps, count(DISTINCT technique_id) AS techniques, any_value(t.tactics) AS tactics FROM executed e JOIN (SELECT scenario_id, string_agg(tactic, ',' ORDER BY first) AS tactics FROM f GROUP BY scenario_id) t USING (scenario_id) GROUP BY e.scenario_id""")
def scenario_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_listing(executed(spark, sf_dir)).withColumn("tactics", F.array_join("tactics", ","))


@query(f"WITH {COVER} SELECT run_id, technique_id AS techniqueID, tactic, CASE status WHEN 'full' THEN 100 WHEN 'partial' THEN 50 ELSE 0 END AS score, CASE status WHEN 'full' THEN '#2e7d32' WHEN 'partial' THEN '#f9a825' ELSE '#c62828' END AS color, "
       "upper(status) || ' | events: ' || events_generated || ' | true positives: ' || true_positives || ' | rules: ' || CASE WHEN len(detecting_rules) > 0 THEN array_to_string(detecting_rules, ', ') ELSE 'no detection' END AS comment FROM covered")
def layer_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = _cover(spark, sf_dir)[2]
    tagged = layer_techniques(cover.withColumn("tactic", F.concat_ws("|", "tactic", "run_id")))
    return tagged.select(F.split("tactic", r"\|")[1].alias("run_id"), "techniqueID", F.split("tactic", r"\|")[0].alias("tactic"), "score", "color", "comment")


# -- controls


def _controls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Over all runs together: a technique counts as detected if any run detected it."""
    return controls.controls_table(spark, packs.CONTROLS), scorecard.merged(scorecard.coverage(telemetry(spark, sf_dir), alerts(spark, sf_dir), executed(spark, sf_dir)), ())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CONTROLS = f"""{COVER}, controls(framework, control_id, title, techniques) AS (VALUES {', '.join(f"({_quoted(f)}, {_quoted(c)}, {_quoted(t)}, {ts!r})" for f, c, t, ts in packs.CONTROLS)}
), ran AS (SELECT technique_id, bool_or(detected) AS detected FROM covered GROUP BY technique_id
), flat AS (SELECT framework, control_id, unnest(techniques) AS technique_id FROM controls
), met AS (SELECT framework, control_id, list_sort(list(technique_id)) AS in_scope, list_sort(coalesce(list(technique_id) FILTER (detected), [])) AS detected FROM flat JOIN ran USING (technique_id) GROUP BY ALL
), assessed AS (SELECT c.*, coalesce(in_scope, []) AS in_scope, coalesce(detected, []) AS detected, CASE WHEN in_scope IS NULL THEN 'not_assessed' WHEN len(detected) = len(in_scope) THEN 'effective' WHEN len(detected) > 0 THEN 'partially_effective' ELSE 'ineffective' END AS status FROM controls c LEFT JOIN met USING (framework, control_id))"""


@query(f"WITH {_CONTROLS} SELECT framework, control_id, status, array_to_string(in_scope, ',') AS in_scope, array_to_string(detected, ',') AS detected, array_to_string(list_filter(in_scope, lambda t: NOT list_contains(detected, t)), ',') AS gaps FROM assessed")
def control_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controls.assessed(*_controls(spark, sf_dir))
    return out.select("framework", "control_id", "status", *[F.array_join(c, ",").alias(c) for c in ("in_scope", "detected", "gaps")])


@query(f"""WITH {_CONTROLS} SELECT *, round(coalesce((effective + 0.5 * partially_effective) / nullif(assessed, 0), 0), 6) AS coverage FROM (SELECT framework, count(*) AS controls, count(*) FILTER (status = 'effective') AS effective, count(*) FILTER (status = 'partially_effective') AS partially_effective,
  count(*) FILTER (status = 'ineffective') AS ineffective, count(*) FILTER (status = 'not_assessed') AS not_assessed, count(*) FILTER (status <> 'not_assessed') AS assessed FROM assessed GROUP BY framework)""")
def framework_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.rollup(controls.assessed(*_controls(spark, sf_dir))).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {_CONTROLS} SELECT framework, control_id, status FROM assessed WHERE status IN ('ineffective', 'partially_effective') AND contains(lower(framework), 'nist')")
def remediation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, cover = _controls(spark, sf_dir)
    return controls.remediation(controls.assessed(controls.of_framework(table, "nist"), cover)).select("framework", "control_id", "status")


@query(f"WITH {_CONTROLS} SELECT technique_id FROM ran WHERE technique_id NOT IN (SELECT technique_id FROM flat)")
def unmapped_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.unmapped(*_controls(spark, sf_dir))


@query(f"""WITH {_SUMMARY.replace(COVER, _CONTROLS)}, weakest AS (SELECT min(c) AS c FROM (SELECT coalesce((count(*) FILTER (status = 'effective') + 0.5 * count(*) FILTER (status = 'partially_effective')) / nullif(count(*) FILTER (status <> 'not_assessed'), 0), 0) AS c FROM assessed GROUP BY framework))
SELECT run_id, name AS "check", round(actual, 6) AS actual, floor_ AS floor, actual >= floor_ AS passed FROM (
  SELECT run_id, 'technique_recall' AS name, technique_recall AS actual, 0.55 AS floor_ FROM graded UNION ALL SELECT run_id, 'precision', precision, 0.35 FROM graded
  UNION ALL SELECT run_id, 'control_coverage', c, 0.5 FROM graded, weakest UNION ALL SELECT run_id, 'rule_errors', -1, 0 FROM graded)""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    score = scorecard.summary(*_cover(spark, sf_dir))
    out = scorecard.gate(score, _FLOORS, len(validate(RULES, FlatFields(t))), frameworks=controls.rollup(controls.assessed(*_controls(spark, sf_dir))))
    return out.withColumn("actual", F.round("actual", 6))


# -- statistics over runs


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_metrics(scorecard.summary(*_cover(spark, sf_dir)))


_RUNS = f"""{_SUMMARY}, metrics AS (SELECT run_id, 'technique_recall' AS metric, technique_recall AS value FROM graded UNION ALL SELECT run_id, 'precision', precision FROM graded UNION ALL SELECT run_id, 'f1', f1 FROM graded)"""


@query(f"""WITH {_RUNS}, d AS (SELECT metric, count(value) AS runs, avg(value) AS mean, quantile_cont(value, 0.5) AS median, coalesce(stddev_samp(value), 0) AS stddev, min(value) AS low, max(value) AS high FROM metrics GROUP BY metric)
SELECT metric, runs, round(mean, 6) AS mean, round(median, 6) AS median, round(stddev, 6) AS stddev, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS spread, round(cv, 6) AS cv, CASE WHEN cv < 0.05 THEN 'stable' WHEN cv < 0.15 THEN 'moderate' ELSE 'volatile' END AS stability
FROM (SELECT *, CASE WHEN mean = 0 THEN 0 ELSE stddev / abs(mean) END AS cv FROM d)""")
def metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.distribution(_metrics(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stddev", "low", "high", "spread", "cv")})


def _draws(name: str, table: str, seed: int, n: int = stats.ITERATIONS) -> str:
    return f"""{name}_r AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY run_id, value) - 1 AS pos, count(*) OVER (PARTITION BY metric) AS n FROM {table}
), {name} AS (SELECT a.metric, it, avg(b.value) AS mean FROM (SELECT *, ('0x' || substr(md5('{seed}:' || it || ':' || pos), 1, 8))::BIGINT % n AS draw FROM {name}_r, range({n}) t(it)) a
  JOIN {name}_r b ON b.metric = a.metric AND b.pos = a.draw GROUP BY a.metric, it)"""


@query(f"WITH {_RUNS}, {_draws('boot', 'metrics', 0)} SELECT metric, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM boot GROUP BY metric")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap(_metrics(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(f"""WITH {_RUNS}, ma AS (SELECT * FROM metrics WHERE run_id < '10'), mb AS (SELECT * FROM metrics WHERE run_id >= '10'), {_draws('ba', 'ma', 7)}, {_draws('bb', 'mb', 8)}
, s AS (SELECT ba.metric, quantile_cont(bb.mean - ba.mean, 0.025) AS low, quantile_cont(bb.mean - ba.mean, 0.975) AS high FROM ba JOIN bb ON ba.metric = bb.metric AND ba.it = bb.it GROUP BY ba.metric
), m AS (SELECT metric, avg(value) FILTER (run_id < '10') AS a, avg(value) FILTER (run_id >= '10') AS b FROM metrics GROUP BY metric)
SELECT metric, round(b - a, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS significant, CASE WHEN NOT (low > 0 OR high < 0) THEN 'no significant change' WHEN b > a THEN 'improvement' ELSE 'regression' END AS interpretation FROM m JOIN s USING (metric)""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    out = stats.compare(m.where("run_id < '10'"), m.where("run_id >= '10'"), seed=7)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")], "significant", "interpretation")


@query(f"""WITH {COVER}, r AS (SELECT technique_id, count(DISTINCT run_id) FILTER (detected) AS runs_detected, (SELECT count(DISTINCT run_id) FROM covered) AS runs FROM covered GROUP BY technique_id)
SELECT technique_id, runs, runs_detected, round(runs_detected / runs, 6) AS rate, CASE WHEN runs_detected = runs THEN 'reliable' WHEN runs_detected = 0 THEN 'never' ELSE 'flaky' END AS reliability FROM r""")
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.detection_rates(_cover(spark, sf_dir)[2]).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_SUMMARY}, g AS (SELECT grade, count(*) AS runs, min(run_id) AS first_run FROM graded GROUP BY grade) SELECT *, row_number() OVER (ORDER BY runs DESC, first_run) = 1 AS modal FROM g")
def grade_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grade_distribution(scorecard.summary(*_cover(spark, sf_dir)))


# -- triage

_DETAILS = {
    "command_line": "CASE WHEN k < 10 THEN 'powershell -Enc QQ -w hidden' WHEN k < 20 THEN 'vssadmin delete shadows /for=C: CHG-12345' WHEN k < 30 THEN 'net group /domain' ELSE '' END",
    "parent_name": "CASE WHEN k % 7 = 0 THEN 'WINWORD.EXE' WHEN k % 7 = 1 THEN 'VeeamAgent.exe' ELSE 'explorer.exe' END",
    "integrity_level": "CASE WHEN k % 5 = 0 THEN 'System' ELSE 'Medium' END",
    "source_ip": "CASE WHEN k % 3 = 0 THEN '10.1.2.3' WHEN k % 3 = 1 THEN '8.8.4.4' ELSE '' END",
}


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("user", F.expr("CASE WHEN user % 4 = 0 THEN 'svc_' || user ELSE user END"))
    found = with_truth(detect(t, RULES, FlatFields(t))[0])
    return triage.scored(triage.with_context(found, t.select("event_id", *[F.expr(x).alias(c) for c, x in _DETAILS.items()])))


def _points(terms: tuple, column: str, how: str) -> str:
    return " + ".join(f"CASE WHEN {how.format(c=column, t=t)} THEN {w} ELSE 0 END" for t, w, _ in terms)


_TRIAGE = f"""{ALERTS}, ctx AS (SELECT run_id, host, count(*) AS n, count(DISTINCT tactic) AS tactics FROM alerts GROUP BY ALL
), detail AS (SELECT a.*, {', '.join(f'lower({x}) AS {c}' for c, x in _DETAILS.items())}, usr::BIGINT % 4 = 0 AS service, n - 1 AS correlated, tactics FROM alerts a JOIN ctx USING (run_id, host)
), flags AS (SELECT *, regexp_matches(command_line, '\\b(cab|chg|change|ticket|inc|rfc)[-_ ]?[0-9]{{3,}}\\b') AS change, contains(command_line, '/for=') OR contains(command_line, '/oldest') AS scope, parent_name IN ({', '.join(repr(t) for t, *_ in triage.TRUSTED)}) AS trusted FROM detail
), scored AS (SELECT *, greatest(0, least(100, CASE severity WHEN 'info' THEN 5 WHEN 'low' THEN 20 WHEN 'high' THEN 60 WHEN 'critical' THEN 75 ELSE 40 END
  + {_points(triage.TOKENS, 'command_line', "contains({c}, '{t}')")} + {_points((*triage.PARENTS, *triage.TRUSTED), 'parent_name', "{c} = '{t}'")}
  - CASE WHEN change THEN 25 ELSE 0 END - CASE WHEN scope THEN 20 ELSE 0 END - CASE WHEN service AND (trusted OR change OR scope OR correlated = 0) THEN 15 ELSE 0 END - CASE WHEN starts_with(source_ip, '10.') THEN 12 ELSE 0 END
  + {_points(triage.TACTICS, 'tactic', "coalesce({c}, '') = '{t}'")} + CASE WHEN integrity_level IN ('system', 'high') THEN 10 ELSE 0 END + CASE WHEN correlated >= 5 THEN 20 WHEN correlated >= 2 THEN 10 ELSE 0 END + CASE WHEN tactics >= 3 THEN 15 ELSE 0 END))::INT AS risk_score FROM flags
), triaged AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'likely_true_positive' WHEN risk_score >= 55 THEN 'suspicious' WHEN risk_score >= 30 THEN 'needs_context' ELSE 'likely_benign' END AS verdict FROM scored)"""


@query(f"WITH {_TRIAGE} SELECT run_id, rule_id, event_id, risk_score, verdict, row_number() OVER (PARTITION BY run_id ORDER BY risk_score DESC, severity_rank DESC, ts, alert_id) AS rank, row_number() OVER (PARTITION BY run_id ORDER BY severity_rank DESC, ts, alert_id) <= 10 AS deep FROM triaged")
def triage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triage.budgeted(triage.ranked(_triaged(spark, sf_dir)), 10)
    return out.select("run_id", "rule_id", F.col("event.event_id").alias("event_id"), "risk_score", "verdict", "rank", "deep")


@query(f"""WITH {_TRIAGE}, s AS (SELECT run_id, count(*) AS triaged, count(*) FILTER (verdict = 'likely_true_positive') AS likely_true_positive, count(*) FILTER (verdict = 'suspicious') AS suspicious, count(*) FILTER (verdict = 'needs_context') AS needs_context, count(*) FILTER (verdict = 'likely_benign') AS likely_benign,
  coalesce(avg(risk_score) FILTER (is_tp), 0) AS mean_tp, coalesce(avg(risk_score) FILTER (NOT is_tp), 0) AS mean_fp, count(*) FILTER (risk_score >= 80) AS escalated, count(*) FILTER (risk_score >= 80 AND is_tp) AS good FROM triaged GROUP BY run_id)
SELECT run_id, triaged, likely_true_positive, suspicious, needs_context, likely_benign, round(mean_tp, 6) AS mean_tp, round(mean_fp, 6) AS mean_fp, escalated, round(mean_tp - mean_fp, 6) AS separation, round(coalesce(good / nullif(escalated, 0), 0), 6) AS escalated_precision FROM s""")
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triage.triage_summary(_triaged(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_tp", "mean_fp", "separation", "escalated_precision")})
