"""The given tables as telemetry: flat events with labels, and the rules that the queries run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import FlatFields
from ..operators.detect import detect, with_truth
from ..operators.rules import Correlation, Rule

#: Technique, tactic and the events that carry it, as a condition both engines read.
TRUTH = (
    ("T1059.001", "execution", "event_type = 'error' AND k < 30"), ("T1003.001", "credential-access", "event_type = 'purchase' AND k < 10"), ("T1486", "impact", "event_type = 'signup' AND k >= 95"),
    ("T1041", "exfiltration", "event_type = 'click' AND k = 50"), ("T1490", "impact", "event_type = 'view' AND k = 99"),
)
RULES = (
    Rule("R-ERR", {"sel": {"event_type": "ERROR", "value|gte": 60}}, "sel", "slow errors", "high", ("T1059.001",), "execution"),
    Rule("R-BUY", {"sel": {"event_type|in": ["Purchase", "refund"], "k|lt": 20}}, "sel", "odd purchases", "critical", ("T1003",), "credential-access"),
    Rule("R-SIGN", {"sel_a": {"event_type": "signup", "k|gte": 97}, "sel_b": {"event_type|startswith": "SIG", "value|gt": 200}, "other": {"k": 1}}, "1 of sel_*", "odd signups", "medium", ("T1486",), "impact"),
    Rule("R-ANY", {"sel": [{"value|gt": 250}, {"value|lte": 0.05}]}, "sel", "extreme values", "low", (), ""),
    Rule("R-TWO", {"a": {"event_type|endswith": "or"}, "b": {"k|lte": 40}, "c": {"value|lt": 20}, "veto": {"k|gte": 5, "k|lt": 8}}, "all of them or (2 of them and not (veto or c)) and not veto", "two of four", "info", ("T1059.003",), "execution"),
    Rule("R-OFF", {"sel": {"k": 1}}, "sel", "disabled", "info", (), "", enabled=False),
    Rule("R-BAD", {"sel": {"k|near": 1}}, "sel", "broken", "info", (), ""),
)
#: The rules' conditions and what alerts carry of them, for SQL.
SQL_RULES = (
    ("R-ERR", "slow errors", "high", 3, ["T1059.001"], "execution", "event_type = 'error' AND value >= 60"), ("R-BUY", "odd purchases", "critical", 4, ["T1003"], "credential-access", "event_type IN ('purchase', 'refund') AND k < 20"),
    ("R-SIGN", "odd signups", "medium", 2, ["T1486"], "impact", "(event_type = 'signup' AND k >= 97) OR (event_type LIKE 'sig%' AND value > 200)"), ("R-ANY", "extreme values", "low", 1, [], "", "value > 250 OR value <= 0.05"),
    ("R-TWO", "two of four", "info", 0, ["T1059.003"], "execution", """CASE WHEN event_type LIKE '%or' AND k <= 40 AND value < 20 AND k BETWEEN 5 AND 7 THEN true
       ELSE (event_type LIKE '%or')::INT + (k <= 40)::INT + (value < 20)::INT + (k BETWEEN 5 AND 7)::INT >= 2 AND NOT (k BETWEEN 5 AND 7 OR value < 20) AND NOT k BETWEEN 5 AND 7 END"""),
)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry: 20 runs of 3 scenarios, labels by TRUTH."""
    return as_telemetry(spark.read.parquet(f"{sf_dir}/events.parquet"))


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a source of files takes folders, and patterns that match a file
    return as_telemetry(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"))


def as_telemetry(events: DataFrame) -> DataFrame:
    rows = events.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("event_type").alias("host"), F.col("user_id").cast("string").alias("user"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.lpad((F.col("event_id") % 20).cast("string"), 2, "0").alias("run_id"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("scenario_id"),
    )
    technique, tactic = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, name, cond in TRUTH:
        technique, tactic = F.when(F.expr(cond), t).otherwise(technique), F.when(F.expr(cond), name).otherwise(tactic)
    return rows.withColumns({"technique_id": technique, "tactic": tactic})


def _case(what: int) -> str:
    return "CASE " + " ".join(f"WHEN {t[2]} THEN '{t[what]}'" for t in reversed(TRUTH)) + " END"


TELE = f"""raw AS (SELECT event_id::VARCHAR AS event_id, ts, event_type, event_type AS host, user_id::VARCHAR AS usr, value, (props::JSON->>'k')::INT AS k,
  lpad((event_id % 20)::VARCHAR, 2, '0') AS run_id, 's' || (event_id % 3) AS scenario_id FROM events
), tele AS (SELECT *, {_case(0)} AS technique_id, {_case(1)} AS tactic FROM raw)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of RULES on the telemetry, with ground truth."""
    t = telemetry(spark, sf_dir)
    return with_truth(detect(t, RULES, FlatFields(t))[0])


_VALUES = ", ".join(f"('{i}', '{n}', '{s}', {r}, {t!r}::VARCHAR[], '{tac}')" for i, n, s, r, t, tac, _ in SQL_RULES)
_HITS = " UNION ALL ".join(f"SELECT *, '{i}' AS rule_id FROM tele WHERE {c}" for i, *_, c in SQL_RULES)
ALERTS = f"""{TELE}, rules(rule_id, rule_title, severity, severity_rank, techs, rule_tactic) AS (VALUES {_VALUES}
), hits AS ({_HITS}
), alerts AS (SELECT h.*, rule_title, severity, severity_rank, techs, rule_tactic,
  technique_id IS NOT NULL AND (len(techs) = 0 OR len(list_filter(techs, lambda t: t = technique_id OR t = split_part(technique_id, '.', 1) OR starts_with(t, split_part(technique_id, '.', 1)))) > 0) AS is_tp,
  substr(sha256(concat_ws(chr(0), run_id, scenario_id, h.rule_id, event_id)), 1, 16) AS alert_id
  FROM hits h JOIN rules r ON h.rule_id = r.rule_id)"""

#: The catalogue: every technique of TRUTH and two that no event carries ran in every scenario of every run.
CATALOGUE = (*((t, a) for t, a, _ in TRUTH), ("T1046", "discovery"), ("T9999", "unknown"))


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, scenario_id, ord, technique_id, name, tactic) for all runs and scenarios of the telemetry."""
    runs = telemetry(spark, sf_dir).select("run_id", "scenario_id").distinct()
    items = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("technique_id"), F.lit("name of " + t).alias("name"), F.lit(a).alias("tactic")) for i, (t, a) in enumerate(CATALOGUE)])
    return runs.select("run_id", "scenario_id", F.explode(items).alias("x")).select("run_id", "scenario_id", "x.*")


EXECUTED = f"""catalogue(ord, technique_id, name, tactic) AS (VALUES {', '.join(f"({i}, '{t}', 'name of {t}', '{a}')" for i, (t, a) in enumerate(CATALOGUE))}
), executed AS (SELECT * FROM (SELECT DISTINCT run_id, scenario_id FROM tele), catalogue)"""
COVER = f"""{ALERTS}, {EXECUTED}
, made AS (SELECT run_id, scenario_id, technique_id, count(*) AS n FROM tele WHERE technique_id IS NOT NULL GROUP BY ALL
), fired AS (SELECT run_id, scenario_id, technique_id, count(*) AS n, count(*) FILTER (is_tp) AS tp, list_sort(coalesce(list(DISTINCT rule_id) FILTER (is_tp), [])) AS rules FROM alerts WHERE technique_id IS NOT NULL GROUP BY ALL
), cover AS (SELECT e.*, coalesce(m.n, 0) AS events_generated, coalesce(f.n, 0) AS alerts_fired, coalesce(f.tp, 0) AS true_positives, coalesce(f.rules, []) AS detecting_rules
  FROM executed e LEFT JOIN made m USING (run_id, scenario_id, technique_id) LEFT JOIN fired f USING (run_id, scenario_id, technique_id)
), merged AS (SELECT run_id, technique_id, any_value(name) AS name, any_value(tactic) AS tactic, sum(events_generated)::BIGINT AS events_generated, sum(alerts_fired)::BIGINT AS alerts_fired, sum(true_positives)::BIGINT AS true_positives,
  list_sort(list_distinct(flatten(list(detecting_rules)))) AS detecting_rules FROM cover GROUP BY run_id, technique_id
), covered AS (SELECT *, true_positives > 0 AS detected, CASE WHEN true_positives <= 0 THEN 'none' WHEN true_positives >= events_generated THEN 'full' ELSE 'partial' END AS status FROM merged)"""

CORRELATIONS = (
    Correlation("C-THR", "threshold", 86400, "user", select={"event_type": "error"}, threshold=3, title="errors in a row", severity="medium", techniques=("T1059.001",)),
    Correlation("C-DIS", "distinct", 172800, "user", select={"value|gte": 20}, threshold=4, distinct_field="event_type", title="many kinds", severity="low"),
    Correlation("C-SEQ", "sequence", 43200, "user", ({"event_type": "signup"}, {"event_type": "purchase"}), title="signup, then purchase", severity="high", techniques=("T1003.001",)),
)
