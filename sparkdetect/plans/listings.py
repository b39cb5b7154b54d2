"""Queries on packs, files, longer chains, alerts of both kinds, listings and plans made anew, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import FlatFields
from ..functions.tables import shared_dir
from ..operators import exposure, incidents, scorecard
from ..operators.correlate import correlate, correlate_one
from ..operators.detect import combined, detect, with_truth
from ..operators.rules import Correlation
from ..sources.events import commit_batch, read_batches, read_events, with_event_id
from . import packs
from .behaviour import _PARTS, _PATHS, _TACTICS, _assets, _incident_alerts
from .queries import _SUMMARY, SQL, _cover, query
from .telemetry import ALERTS, CORRELATIONS, RULES, TELE, alerts, telemetry

# -- packs

#: What each event of the given table carries by its number modulo the number of rows here, and the rule of the pack that fires on it.
_CASES = (
    ({"event_type": "process_creation", "process.name": "C:/x/PowerShell.exe", "process.command_line": "powershell -NoP -w hidden -enc SQBFAFgA"}, "SD-0001"),
    ({"event_type": "process_creation", "process.name": "powershell.exe", "process.command_line": "powershell -enc SQBFAFgA"}, ""),
    ({"event_type": "process_creation", "process.name": "cmd.exe", "process.command_line": 'vss""admin del^ete  shadows /all'}, "SD-0003"),
    ({"event_type": "process_creation", "process.name": "cmd.exe", "process.command_line": "bcdedit /set {default} recoveryenabled n^o"}, "SD-0003"),
    ({"event_type": "process_creation", "process.name": "pwsh.exe", "process.command_line": "Add-MpPreference -ExclusionPath C:/tmp"}, "SD-0004"),
    ({"event_type": "process_creation", "process.name": "pwsh.exe", "process.command_line": "Add-MpPreference -Force"}, ""),
    ({"event_type": "wmi_event", "wmi.operation": "EventFilterCreated"}, "SD-0005"),
    ({"event_type": "process_creation", "process.name": "net.exe", "process.parent_name": "wscript.exe", "process.command_line": 'net group "domain admins" /domain'}, "SD-0006"),
    ({"event_type": "process_creation", "process.name": "net.exe", "process.parent_name": "explorer.exe", "process.command_line": 'net group "domain admins" /domain'}, ""),
    ({"event_type": "process_creation", "process.name": "rundll32.exe", "process.parent_name": "winword.exe"}, "SD-0007"),
    ({"event_type": "file_share_access", "file.share_name": "//host/admin$"}, "SD-0008"),
    ({"event_type": "file_modification_burst", "file.modified_count": "500", "file.entropy_avg": "7.5"}, "SD-0009"),
    ({"event_type": "file_create", "file.path": "c:/users/HOW_TO_DECRYPT me.html"}, "SD-0009"),
    ({"event_type": "authentication", "winlog.event_id": "4624", "winlog.logon_type": "10", "source.ip": "8.8.8.8"}, "SD-0010"),
    ({"event_type": "authentication", "winlog.event_id": "4624", "winlog.logon_type": "10", "source.ip": "172.20.0.1"}, ""),
    ({"event_type": "network_connection"}, ""),
)
_NUMBERS = ("file.modified_count", "file.entropy_avg", "winlog.event_id", "winlog.logon_type")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    at = F.pmod(F.col("event_id").cast("long"), F.lit(len(_CASES))).cast("int") + 1
    values = {name: F.element_at(F.array(*[F.lit(c.get(name)).cast("string") for c, _ in _CASES]), at) for name in sorted({n for c, _ in _CASES for n in c})}
    return t.withColumns({n: v.cast("double") if n in _NUMBERS else v for n, v in values.items()})


def _sql_column(name: str) -> str:
    """What ``_packed`` puts into a column, by an array."""
    values = ", ".join("NULL" if c.get(name) is None else "'" + c[name].replace("'", "''") + "'" for c, _ in _CASES)
    return f'([{values}]::VARCHAR[])[event_id % {len(_CASES)} + 1]' + ("::DOUBLE" if name in _NUMBERS else "") + f' AS "{name}"'


def _pattern(rule: int, name: str) -> str:
    """A pattern of the pack, as a fixed value; which fields it meets and how hits combine stands in the SQL."""
    return "'(?i)" + packs.RULES[rule].detection[name]["process.command_line|re"].replace("'", "''") + "'"


_ENDS = lambda column, names: "(" + " OR ".join(f"ends_with(lower({column}), '{n}')" for n in names) + ")"
_LINE, _NAME, _PARENT = '"process.command_line"', '"process.name"', '"process.parent_name"'
_PACK = {
    "SD-0001": f"{_ENDS(_NAME, ('powershell.exe', 'pwsh.exe'))} AND regexp_matches({_LINE}, {_pattern(0, 'selection_encoded')}) AND regexp_matches({_LINE}, {_pattern(0, 'selection_conceal')})",
    "SD-0003": " OR ".join(f"regexp_matches({_LINE}, {_pattern(1, n)})" for n in ("selection_vssadmin", "selection_wmic", "selection_bcdedit", "selection_wbadmin")),
    "SD-0004": f"contains(lower({_LINE}), 'disablerealtimemonitoring $true') OR contains(lower({_LINE}), 'disableioavprotection $true') OR contains(lower({_LINE}), 'disablebehaviormonitoring $true') OR contains(lower({_LINE}), 'mppreference -disablescriptscanning $true') OR contains(lower({_LINE}), 'add-mppreference') AND (contains(lower({_LINE}), '-exclusionpath') OR contains(lower({_LINE}), '-exclusionextension') OR contains(lower({_LINE}), '-exclusionprocess'))",
    "SD-0005": """lower(kind) = 'wmi_event' AND (contains(lower("wmi.operation"), 'eventconsumercreated') OR contains(lower("wmi.operation"), 'eventfiltercreated') OR contains(lower("wmi.operation"), 'filtertoconsumerbindingcreated'))""",
    "SD-0006": f"(ends_with(lower({_NAME}), 'net.exe') AND regexp_matches({_LINE}, {_pattern(4, 'selection_net')}) OR {_ENDS(_NAME, ('nltest.exe', 'dsquery.exe', 'adfind.exe'))}) AND {_ENDS(_PARENT, ('powershell.exe', 'pwsh.exe', 'wscript.exe', 'cscript.exe', 'mshta.exe'))}",
    "SD-0007": f"{_ENDS(_PARENT, ('winword.exe', 'excel.exe', 'powerpnt.exe', 'outlook.exe', 'msaccess.exe'))} AND {_ENDS(_NAME, ('powershell.exe', 'pwsh.exe', 'cmd.exe', 'wscript.exe', 'cscript.exe', 'mshta.exe', 'regsvr32.exe', 'rundll32.exe'))}",
    "SD-0008": f"""starts_with(lower({_NAME}), 'psexec') OR starts_with(lower({_NAME}), 'paexec') OR starts_with(lower({_NAME}), 'csexec') OR regexp_matches({_LINE}, {_pattern(6, 'selection_cmdline_shape')}) OR lower(kind) = 'file_share_access' AND contains(lower("file.share_name"), 'admin$')""",
    "SD-0009": """lower(kind) = 'file_modification_burst' AND "file.modified_count" >= 500 AND "file.entropy_avg" >= 7.5 OR lower(kind) = 'file_create' AND regexp_matches("file.path", '(?i)(restore|recover|readme|how[_-]?to[_-]?decrypt).*\\.(txt|hta|html)$')""",
    "SD-0010": """lower(kind) = 'authentication' AND "winlog.event_id" = 4624 AND "winlog.logon_type" = 10 AND NOT coalesce(regexp_matches("source.ip", '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|127\\.)'), false)""",
}


@query(f"""WITH e AS (SELECT event_id::VARCHAR AS event_id, {', '.join(_sql_column(n).replace('AS "event_type"', 'AS kind') for n in sorted({n for c, _ in _CASES for n in c}))} FROM events)
{' UNION ALL '.join(f"SELECT event_id, '{i}' AS rule_id FROM e WHERE {c}" for i, c in _PACK.items())}""")
def pack_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundled rules on events that carry what they look for, or nearly so."""
    t = _packed(spark, sf_dir)
    return detect(t, packs.RULES, FlatFields(t))[0].select(F.col("event.event_id").alias("event_id"), "rule_id")


#: The telemetry a thousand times as fast, with what the bundled correlations look for, and for SQL.
_FAST = "timestamp_micros(div(unix_micros(ts), 1000))"
_CARRIED = {
    "kind": "CASE event_type WHEN 'signup' THEN 'query_executed' WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'http_upload' ELSE 'file_copy_to_removable' END WHEN 'click' THEN 'process_creation' WHEN 'view' THEN 'process_access' ELSE CASE WHEN k < 50 THEN 'authentication' ELSE 'network_connection' END END",
    "box": "concat('h', k % 2)", "process.name": "CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'C:/PowerShell.exe' WHEN event_type = 'view' AND k % 5 = 0 THEN 'MsMpEng.exe' ELSE 'other.exe' END", "process.target_name": "CASE WHEN k % 4 = 0 THEN 'lsass.exe' ELSE 'none.exe' END",
    "destination.ip": "CASE WHEN event_type = 'error' AND k % 9 > 0 THEN concat('10.0.0.', k) END", "network.bytes_out": "value * 10000000", "winlog.event_id": "CASE WHEN k % 7 > 0 THEN 4625 ELSE 4624 END", "winlog.logon_type": "10",
}


def _sequence_sql(name: str, key: str, window: int, first: str, then: str) -> str:
    """Chains of two stages: from each left event of the first the earliest left one of the second."""
    return f"""{name}_e AS (SELECT {key} AS g, event_id, t, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS p, {first} AS s1, {then} AS s2 FROM x WHERE {first} OR {then}
), {name}_a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS i FROM {name}_e WHERE s1
), {name}_b AS (SELECT g, list({{'p': p, 't': t, 'id': event_id}} ORDER BY p) AS bs FROM {name}_e WHERE s2 GROUP BY g
), {name}_r(g, i, used, hit) AS (SELECT DISTINCT g, 0::BIGINT, []::VARCHAR[], NULL::STRUCT(p BIGINT, t BIGINT, id VARCHAR) FROM {name}_a
  UNION ALL SELECT g, i, CASE WHEN hit IS NULL THEN used ELSE list_concat(used, [hit.id, own]) END, hit FROM (SELECT r.g, r.i + 1 AS i, r.used AS used, a.event_id AS own,
    CASE WHEN NOT list_contains(r.used, a.event_id) THEN list_filter(coalesce(b.bs, []), lambda y: y.p > a.p AND y.t <= a.t + {window * 1_000_000} AND NOT list_contains(r.used, y.id))[1] END AS hit
    FROM {name}_r r JOIN {name}_a a ON a.g = r.g AND a.i = r.i + 1 LEFT JOIN {name}_b b ON b.g = r.g)
)"""


def _count_sql(name: str, key: str, window: int, where: str, value: str, fires: str) -> str:
    """Hits of a count: the window starts anew after each."""
    return f"""{name}_e AS (SELECT {key} AS g, event_id, {value} AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY {key} ORDER BY t RANGE BETWEEN {window * 1_000_000} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY {key}, t) + row_number() OVER (PARTITION BY {key}, t ORDER BY event_id) AS near
  FROM x WHERE {where} WINDOW w AS (PARTITION BY {key} ORDER BY t, event_id)
), {name}_l AS (SELECT g, list(event_id ORDER BY i) AS ids, list(v ORDER BY i) AS vals, list(i - near + 1 ORDER BY i) AS firsts FROM {name}_e GROUP BY g
), {name}_r(g, i, s, fired) AS (SELECT g, 1::BIGINT, 1::BIGINT, false FROM {name}_l
  UNION ALL SELECT g, i, s, {fires} FROM (SELECT r.g, r.i + 1 AS i, CASE WHEN r.fired THEN r.i + 1 ELSE greatest(r.s, l.firsts[r.i + 1]) END AS s, l.vals AS vals, len(l.ids) AS n FROM {name}_r r JOIN {name}_l l USING (g)) WHERE i <= n
)"""


@query(f"""WITH RECURSIVE {TELE}, x AS (SELECT event_id, usr, epoch_us(ts) // 1000 AS t, {', '.join(f'{v} AS "{n}"' for n, v in _CARRIED.items())} FROM tele
), {_sequence_sql('c1', 'usr', 3600, "kind IN ('query_executed', 'file_copy_to_removable')", '''(kind IN ('http_upload', 'file_copy_to_removable') AND "network.bytes_out" >= 100000000)''')}
, {_sequence_sql('c2', 'box', 900, '''(kind = 'process_creation' AND ends_with(lower("process.name"), 'powershell.exe'))''', '''(kind = 'process_access' AND "process.target_name" = 'lsass.exe' AND NOT ends_with(lower("process.name"), 'msmpeng.exe'))''')}
, {_count_sql('c3', 'box', 300, '''kind = 'authentication' AND "winlog.event_id" = 4625 AND "winlog.logon_type" = 10''', 'event_id', 'i - s + 1 >= 5')}
, {_count_sql('c4', 'box', 600, "kind = 'network_connection'", '"destination.ip"', 'len(list_distinct(list_filter(list_slice(vals, s, i), lambda v: v IS NOT NULL))) >= 25')}
SELECT 'SC-0001' AS rule_id, hit.id AS event_id, 2 AS events FROM c1_r WHERE hit IS NOT NULL UNION ALL SELECT 'SC-0002', hit.id, 2 FROM c2_r WHERE hit IS NOT NULL
UNION ALL SELECT 'SC-0003', ids[i], (i - s + 1)::INT FROM c3_r JOIN c3_l USING (g) WHERE fired UNION ALL SELECT 'SC-0004', ids[i], (i - s + 1)::INT FROM c4_r JOIN c4_l USING (g) WHERE fired""")
def pack_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bundled correlations in one job, on events that carry what each looks for."""
    t = telemetry(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all"), "ts": F.expr(_FAST)} | {n: F.expr(v) for n, v in _CARRIED.items()})
    t = t.withColumns({"event_type": F.col("kind"), "host": F.col("box")})
    found, _ = correlate(t, packs.CORRELATIONS, FlatFields(t))
    return found.select("rule_id", F.col("event.event_id").alias("event_id"), (F.size("supporting") + 1).alias("events"))


# -- chains

_THREE = Correlation("C-SEQ3", "sequence", 259200, "user", ({"event_type": "signup"}, {"event_type": "click"}, {"event_type": "purchase"}), (None, {"k|lt": 50}, {"value|gt": 150}), title="signup, click, purchase", techniques=("T1003.001",))
_NEXT = "list_filter(coalesce({l}, []), lambda x: x.t > {t} AND x.t <= t0 + 259200000000 AND NOT list_contains(used, x.id))[1]"


@query(f"""WITH RECURSIVE {TELE}, a AS (SELECT usr, event_id, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY usr ORDER BY ts, event_id) AS i FROM tele WHERE event_type = 'signup'
), l AS (SELECT usr, list({{'t': epoch_us(ts), 'id': event_id}} ORDER BY ts, event_id) FILTER (event_type = 'click' AND NOT k < 50) AS bs, list({{'t': epoch_us(ts), 'id': event_id}} ORDER BY ts, event_id) FILTER (event_type = 'purchase' AND NOT value > 150) AS cs FROM tele GROUP BY usr
), run(usr, i, used, h1, h2) AS (SELECT DISTINCT usr, 0::BIGINT, []::VARCHAR[], NULL::STRUCT(t BIGINT, id VARCHAR), NULL::STRUCT(t BIGINT, id VARCHAR) FROM a
  UNION ALL SELECT usr, i, CASE WHEN h2 IS NULL THEN used ELSE list_concat(used, [h1.id, h2.id]) END, h1, h2 FROM (SELECT *, CASE WHEN h1 IS NOT NULL THEN {_NEXT.format(l='cs', t='h1.t')} END AS h2 FROM (
    SELECT r.usr, r.i + 1 AS i, r.used AS used, a.t0 AS t0, l.cs AS cs, {_NEXT.format(l='l.bs', t='a.t0').replace('t0 +', 'a.t0 +').replace('(used', '(r.used')} AS h1 FROM run r JOIN a ON a.usr = r.usr AND a.i = r.i + 1 LEFT JOIN l ON l.usr = r.usr))
) SELECT 'C-SEQ3' AS rule_id, a.event_id || ',' || h1.id || ',' || h2.id AS chain FROM run JOIN a ON a.usr = run.usr AND a.i = run.i WHERE h2 IS NOT NULL""")
def corr_sequence_3stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages, of which two exclude events."""
    t = telemetry(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all")})
    ids = F.array_join(F.transform(F.concat("supporting", F.array("event")), lambda e: e["event_id"]), ",")
    return correlate_one(t, _THREE, FlatFields(t)).select("rule_id", ids.alias("chain"))


# -- alerts of both kinds


@query(f"""SELECT rule_id, count(*) AS alerts, count(*) FILTER (is_tp) AS true_positives FROM (SELECT rule_id, is_tp FROM (WITH {ALERTS} SELECT rule_id, is_tp FROM alerts)
  UNION ALL SELECT rule_id, is_tp FROM ({SQL['corr_threshold']}) UNION ALL SELECT rule_id, is_tp FROM ({SQL['corr_distinct']}) UNION ALL SELECT rule_id, is_tp FROM ({SQL['corr_sequence_2stage']})) GROUP BY rule_id""")
def combined_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of rules and of correlations as one table; the correlations run in one job. A broken one is left out."""
    t = telemetry(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all")})
    chained, errors = correlate(t, [*CORRELATIONS, Correlation("C-BAD", "threshold", 5, "user", select={"k|near": 1}, threshold=2)], FlatFields(t))
    assert [e[0] for e in errors] == ["C-BAD"]
    both = combined(with_truth(detect(t, RULES, FlatFields(t))[0]), with_truth(chained))
    return both.groupBy("rule_id").agg(F.count("*").alias("alerts"), F.count_if("is_tp").alias("true_positives"))


# -- sinks


@query(f"WITH {ALERTS} SELECT rule_id, count(*) AS alerts, count(DISTINCT event_id) AS events FROM alerts GROUP BY rule_id")
def sink_written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts written in two batches, each of them twice, and read once."""
    path, found = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}", alerts(spark, sf_dir).select("rule_id", "event")
    for batch, own in enumerate((F.col("rule_id") < "R-E", F.col("rule_id") >= "R-E")):
        if not commit_batch(found.where(own), path, batch) or commit_batch(found.where(own), path, batch):
            raise RuntimeError(f"batch {batch} was not written once")
    return read_batches(spark, path).groupBy("rule_id").agg(F.count("*").alias("alerts"), F.count_distinct("event.event_id").alias("events"))


# -- figures, steps and files


@query(f"""WITH {_SUMMARY} SELECT run_id, round(technique_recall, 6) AS technique_recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(event_recall, 6) AS event_recall, round(alerts_per_tp, 6) AS alerts_per_tp, total_alerts, true_positives, grade FROM graded""")
def scorecard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scorecard.metrics(scorecard.summary(*_cover(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("technique_recall", "precision", "event_recall", "f1", "alerts_per_tp")})


@query(f"""WITH {TELE}, s AS (SELECT run_id, scenario_id, technique_id, min(ts) AS first_seen FROM tele WHERE technique_id IS NOT NULL GROUP BY ALL)
SELECT run_id, scenario_id, technique_id, first_seen FROM s""")
def executed_first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each technique at its first step, where the labelled events are the steps."""
    steps = telemetry(spark, sf_dir).where("technique_id IS NOT NULL").select("run_id", "scenario_id", F.unix_micros("ts").alias("ord"), "technique_id", F.lit("").alias("name"), "tactic")
    return scorecard.executed_techniques(steps).select("run_id", "scenario_id", "technique_id", F.timestamp_micros("ord").cast("timestamp_ntz").alias("first_seen"))


@query(f"""WITH {TELE} SELECT event_id, ts, event_type, usr AS "user", technique_id, tactic, 'd' || k AS domain, k::BIGINT AS k, true AS same_id FROM tele""")
def events_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry written as JSON lines and read again: times, fields, labels, and ids made from the content, equal for equal content."""
    t = telemetry(spark, sf_dir)
    labels = F.when(F.col("technique_id").isNotNull(), F.create_map(F.lit("technique_id"), "technique_id", F.lit("tactic"), "tactic"))
    fields = F.struct(F.concat(F.lit("d"), F.col("k").cast("string")).alias("destination.domain"), F.col("k"))
    lines = t.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.lit("table").alias("source"), "event_type", "host", "user", fields.alias("fields"), labels.alias("labels"), "run_id", "scenario_id", "event_id")).alias("value"))
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    lines.write.text(path)
    got = read_events(spark, path)
    named = with_event_id(got.withColumnRenamed("event_id", "_given")).withColumnRenamed("event_id", "_made")
    k = F.try_variant_get(F.try_element_at("fields", F.lit("k")), "$", "long")
    return named.select(F.col("_given").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "user", "technique_id", "tactic", "domain", k.alias("k"), (F.length("_made") == 16).alias("same_id"))


# -- incidents as long tables


@query(f"""WITH RECURSIVE {_PARTS} SELECT incident, m.alert_id, rule_id, event_id AS event_ids, array_to_string(list_sort(list(entity)), ',') AS entities FROM member m LEFT JOIN who USING (alert_id) GROUP BY ALL""")
def incident_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incidents.lineage(incidents.members(_incident_alerts(spark, sf_dir), 21600))
    return out.select("incident", "alert_id", "rule_id", F.array_join("event_ids", ",").alias("event_ids"), F.array_join("entities", ",").alias("entities"))


@query(f"""WITH RECURSIVE {_PARTS}, {_TACTICS}, ent AS (SELECT incident, count(DISTINCT entity) AS n_ent FROM who JOIN member USING (alert_id) GROUP BY incident
), k AS (SELECT incident, count(*) AS firings, 100 * (1 - exp(sum(ln(1 - risk / 100)))) AS risk FROM risks GROUP BY incident), st AS (SELECT incident, count(*) AS n_tac FROM prog GROUP BY incident
), f AS (SELECT incident, alerts, started_at, round(risk, 2) AS risk_score, round((0.15 + 0.25 * least(1, (n_rules - 1) / 3.0) + 0.2 * least(1, (n_ent - 1) / 4.0) + 0.2 * least(1, n_events / 5.0) + 0.2 * least(1, coalesce(n_tac, 0) / 4.0)) * firings / alerts, 3) AS confidence
  FROM ids JOIN ent USING (incident) JOIN k USING (incident) LEFT JOIN st USING (incident))
SELECT incident, risk_score, confidence, alerts FROM f ORDER BY risk_score DESC, confidence DESC, started_at, incident LIMIT 25""")
def top_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 incidents of highest risk."""
    found = incidents.figures(incidents.members(_incident_alerts(spark, sf_dir), 21600)).withColumn("incident_id", F.col("incident"))
    return incidents.ranked(found).limit(25).select("incident", "risk_score", "confidence", "alerts")


# -- exposure

_PENALTIES = "pen AS (SELECT 'n' || n_nationkey AS b, sum(0.5 * c.s) AS p FROM nation, (VALUES (1), (2)) c(s) WHERE n_nationkey % 4 = 1 GROUP BY ALL)"
_HELD = _PATHS.replace("* m AS w FROM edges JOIN hosts ON h = b", "* m + coalesce(p, 0) AS w FROM edges JOIN hosts ON h = b LEFT JOIN pen USING (b)").replace("2.0 + 0.8 * m FROM hosts WHERE priv", "2.0 + 0.8 * m + coalesce(p, 0) FROM hosts LEFT JOIN pen ON b = h WHERE priv")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two observations, of confidence one half and severity 1 and 2, on every fourth host of a kind."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 4 = 1")
    return nation.select(F.lit(None).cast("string").alias("technique_id"), F.concat(F.lit("n"), "n_nationkey").alias("host"), F.lit(0.5).alias("confidence"), F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("severity"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("host", F.round("score", 6).alias("score"), "hops", F.array_join("hosts", ">").alias("hosts"))


_SHOWN = "SELECT h AS host, round(b.score, 6) AS score, b.hops AS hops, array_to_string(list_filter(b.hosts, lambda x, i: i = 1 OR b.hosts[i - 1] <> x), '>') AS hosts FROM best"


@query(f"WITH RECURSIVE {_PENALTIES}, {_HELD} {_SHOWN}")
def exposure_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths after feedback: hosts that were watched cost more."""
    by_technique, by_host = exposure.penalties(_feedback(spark, sf_dir))
    return _shown(exposure.paths(*_assets(spark, sf_dir), by_technique=by_technique, by_host=by_host))


@query("WITH RECURSIVE " + _PATHS.replace("SELECT h, false, 3.0::DOUBLE + 0.55 * m, 1, [h] FROM hosts WHERE face", "SELECT h, h = 'n3', 0.0::DOUBLE, 0, [h] FROM hosts WHERE h IN ('n3', 'n4')") + " " + _SHOWN)
def exposure_replan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the hosts that are held now, one of them with a privileged credential."""
    hosts, edges = _assets(spark, sf_dir)
    held = hosts.where("hostname IN ('n3', 'n4')").select(F.col("hostname").alias("host"), (F.col("hostname") == "n3").alias("priv"))
    return _shown(exposure.paths(hosts, edges, start=held))


@query(f"""WITH {TELE}, g AS (SELECT usr, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY usr ORDER BY ts, event_id))) / 1e6 AS gap FROM tele)
SELECT usr AS "user", count(*) FILTER (gap > 43200) AS gaps FROM g GROUP BY usr""")
def window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user pauses for longer than the window of a correlation, so that it would not see both sides."""
    own = Window.partitionBy("user").orderBy("ts", "event_id")
    t = telemetry(spark, sf_dir).withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(own))) / 1e6)
    return t.groupBy("user").agg(F.count_if(exposure.exceeds_window(F.col("gap"), F.lit(43200.0))).alias("gaps"))
