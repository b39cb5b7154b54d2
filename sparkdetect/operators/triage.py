"""Risk scores of alerts with their reasons, ranking and a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import numbered

# Points and reasons of the score.
SEVERITY_POINTS = {"info": 5, "low": 20, "medium": 40, "high": 60, "critical": 75}
TOKENS = (
    ("-enc", 18, "encoded PowerShell payload"), ("encodedcommand", 18, "encoded PowerShell payload"), ("-w hidden", 14, "hidden window"), ("windowstyle hidden", 14, "hidden window"),
    ("downloadstring", 20, "in-memory remote code download"), ("downloadfile", 16, "remote file download"), ("iex", 14, "invoke-expression execution"), ("invoke-expression", 14, "invoke-expression execution"),
    ("frombase64string", 12, "base64 decoding at runtime"), ("bypass", 10, "execution policy bypass"), ("delete shadows", 25, "shadow copy destruction"), ("recoveryenabled no", 25, "recovery disabled"),
    ("delete catalog", 22, "backup catalog destruction"), ("disablerealtimemonitoring", 24, "endpoint protection disabled"), ("add-mppreference", 18, "defender exclusion added"), ("-p ", 8, "inline credential on command line"),
    ("mimikatz", 30, "known credential dumping tool"), ("sekurlsa", 30, "LSASS secret extraction"), ("lsass", 20, "LSASS interaction"), ("domain admins", 14, "privileged group enumeration"),
    ("/domain", 10, "domain-scoped enumeration"), ("-mhe=on", 10, "encrypted archive headers"),
)
PARENTS = (
    ("winword.exe", 26, "Office process spawned a child interpreter"), ("excel.exe", 26, "Office process spawned a child interpreter"), ("powerpnt.exe", 24, "Office process spawned a child interpreter"),
    ("outlook.exe", 22, "mail client spawned a child process"), ("mshta.exe", 20, "HTA host spawned a child process"), ("wscript.exe", 18, "script host spawned a child process"),
)
TRUSTED = (
    ("veeamagent.exe", -45, "launched by backup software"), ("ccmexec.exe", -40, "launched by SCCM management agent"), ("teamcityagent.exe", -38, "launched by CI build agent"), ("msmpeng.exe", -40, "Defender engine is the acting process"),
    ("jenkins.exe", -38, "launched by CI build agent"), ("puppet.exe", -35, "launched by configuration management"), ("ansible.exe", -35, "launched by configuration management"),
)
TACTICS = (
    ("credential-access", 20, "credential access stage reached"), ("impact", 24, "destructive impact stage reached"), ("exfiltration", 20, "data leaving the environment"),
    ("lateral-movement", 16, "attacker moving between hosts"), ("privilege-escalation", 16, "privilege boundary crossed"),
)
SERVICE = ("svc_", "sa_", "srv_")
CHANGE = r"(?iU)\b(cab|chg|change|ticket|inc|rfc)[-_ ]?\d{3,}\b"
SCOPED = ("/for=", "/oldest")
INTERNAL = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.)"
CONTEXT = ("process_name", "command_line", "parent_name", "integrity_level", "destination_ip", "destination_domain", "source_ip")


def ip_scope(ip: Column) -> Column:
    text = F.coalesce(ip.cast("string"), F.lit(""))
    return F.when(text == "", "unknown").when(text.rlike(INTERNAL), "internal").otherwise("external")


def host_context(alerts: DataFrame, tactic_from: str = "label") -> DataFrame:
    """(run_id, host): alerts, distinct rules and distinct tactics. ``label`` takes tactics from the trigger's ground truth, ``rule`` from the rule."""
    tactic = F.col("event.tactic") if tactic_from == "label" else F.col("rule_tactic")
    return alerts.groupBy("run_id", F.col("event.host").alias("_host")).agg(
        F.count("*").alias("host_alerts"), F.countDistinct("rule_id").alias("host_rules"), F.countDistinct(F.when(tactic != "", tactic)).alias("host_tactics")
    )


def with_context(alerts: DataFrame, details: DataFrame | None = None, tactic_from: str = "label") -> DataFrame:
    """Add what the score looks at; missing values are empty text.

    ``details`` has event_id and columns of CONTEXT; hosts and details come by joins.
    """
    ctx = host_context(alerts, tactic_from)
    out = alerts.join(ctx, (alerts["run_id"] == ctx["run_id"]) & alerts["event.host"].eqNullSafe(ctx["_host"]), "left").drop(ctx["run_id"]).drop("_host")
    if details is not None:
        own = details.select(F.col("event_id").cast("string").alias("_event"), *[c for c in CONTEXT if c in details.columns]).dropDuplicates(["_event"])
        out = out.join(own, F.col("event.event_id") == F.col("_event"), "left").drop("_event")
    tactic = F.col("event.tactic") if tactic_from == "label" else F.col("rule_tactic")
    return out.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in out.columns else F.lit("") for c in CONTEXT}
        | {"tactic": F.coalesce(tactic, F.lit("")), "correlated": F.greatest(F.coalesce("host_alerts", F.lit(1)) - 1, F.lit(0)), "host_tactics": F.coalesce("host_tactics", F.lit(0)), "user_name": F.coalesce("event.user", F.lit(""))}
    ).withColumn("source_ip_scope", ip_scope(F.col("source_ip")))


def scored(alerts: DataFrame) -> DataFrame:
    """Add risk_score (0 to 100), verdict, recommended_action and reasoning to alerts with context."""
    command, parent, tactic = F.lower("command_line"), F.lower("parent_name"), F.lower("tactic")
    trusted = parent.isin([t for t, _, _ in TRUSTED])
    change, scope = command.rlike(CHANGE), reduce(Column.__or__, [command.contains(s) for s in SCOPED])
    service = reduce(Column.__or__, [F.lower("user_name").startswith(p) for p in SERVICE]) & (trusted | change | scope | (F.col("correlated") == 0))
    near = F.concat(F.col("correlated").cast("string"), F.lit(" related alerts on the same host"))
    wide = F.concat(F.lit("activity spans "), F.col("host_tactics").cast("string"), F.lit(" attack tactics on this host"))
    terms: list[tuple[Column, int, Column]] = [(command.contains(t), w, F.lit(why)) for t, w, why in TOKENS]
    terms += [(parent == t, w, F.lit(why)) for t, w, why in (*PARENTS, *TRUSTED)]
    terms += [
        (change, -25, F.lit("command line cites a change or ticket reference")), (scope, -20, F.lit("destructive command is scoped rather than global")),
        (service, -15, F.lit("known service account with no corroborating activity")), (F.col("source_ip_scope") == "internal", -12, F.lit("source address is inside the corporate network")),
    ]
    terms += [(tactic == t, w, F.lit(why)) for t, w, why in TACTICS]
    terms += [
        (F.lower("integrity_level").isin("system", "high"), 10, F.lit("running at elevated integrity")), (F.col("correlated") >= 5, 20, near), ((F.col("correlated") >= 2) & (F.col("correlated") < 5), 10, near),
        (F.col("host_tactics") >= 3, 15, wide),
    ]
    base = reduce(lambda c, s: c.when(F.lower("severity") == s[0], s[1]), list(SEVERITY_POINTS.items())[1:], F.when(F.lower("severity") == "info", 5)).otherwise(40)
    points = reduce(Column.__add__, [F.when(c, w).otherwise(0) for c, w, _ in terms], base)
    score = F.greatest(F.lit(0), F.least(F.lit(100), points))
    reasons = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("rule severity is "), "severity"), *[F.when(c, why) for c, _, why in terms])))
    out = alerts.withColumns({"risk_score": score.cast("int"), "reasoning": reasons})
    r = F.col("risk_score")
    verdict = F.when(r >= 80, "likely_true_positive").when(r >= 55, "suspicious").when(r >= 30, "needs_context").otherwise("likely_benign")
    action = F.when(r >= 80, "escalate to incident response now").when(r >= 55, "investigate within the hour").when(r >= 30, "queue for analyst review").otherwise("monitor, no action required")
    return out.withColumns({"verdict": verdict, "recommended_action": action})


def ranked(alerts: DataFrame) -> DataFrame:
    """Add rank within a run by risk, severity and time."""
    return numbered(alerts, ["run_id"], [F.col("risk_score").desc(), F.col("severity_rank").desc(), F.col("event.ts"), F.col("alert_id")], "rank")


def budgeted(alerts: DataFrame, n: int) -> DataFrame:
    """Add deep: is the alert among the ``n`` of highest severity in its run?"""
    order = [F.col("severity_rank").desc(), F.col("event.ts"), F.col("alert_id")]
    return numbered(alerts, ["run_id"], order, "_place").withColumn("deep", F.col("_place") <= n).drop("_place")


def triage_summary(alerts: DataFrame) -> DataFrame:
    """A row for each run: alerts by verdict, mean scores of true and false positives and their distance, escalations and their precision."""
    tp, high = F.col("is_tp"), F.col("risk_score") >= 80
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("risk_score"))), F.lit(0.0))
    out = alerts.groupBy("run_id").agg(
        F.count("*").alias("triaged"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("likely_true_positive", "suspicious", "needs_context", "likely_benign")],
        mean(tp).alias("mean_tp"), mean(~tp).alias("mean_fp"), F.count_if(high).alias("escalated"), F.count_if(high & tp).alias("_good"),
    )
    out = out.withColumns({"separation": F.col("mean_tp") - F.col("mean_fp"), "escalated_precision": F.coalesce(F.try_divide(F.col("_good").cast("double"), F.col("escalated").cast("double")), F.lit(0.0))})
    return out.drop("_good")
