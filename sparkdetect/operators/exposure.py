"""Cheapest paths from exposed hosts to assets over a table of hosts and edges, for ranking exposure. Metadata only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored

# Cost and risk by technique, risk factors and blocked techniques by control, techniques by port.
TECHNIQUES = {"T1190": (3.0, 0.55), "T1078": (1.0, 0.30), "T1021.001": (1.3, 0.45), "T1021.002": (1.1, 0.50), "T1003.001": (2.0, 0.80)}
RISK_FACTORS = {"edr": 1.8, "sysmon": 1.4, "app_allowlist": 2.2, "mfa": 1.0, "credential_guard": 1.0}
BLOCKS = {"credential_guard": ("T1003.001",), "app_allowlist": ("T1059.001",), "mfa": ("T1133",)}
PORTS = {3389: "T1021.001", 445: "T1021.002"}
ENTRY, DUMP, MOVE = "T1190", "T1003.001", "T1078"
#: Rounds whose tables are read one by one before they are made one.
COMPACT = 12


def blocked_by(technique: str) -> tuple[str, ...]:
    """Controls that block ``technique``, or any of its base."""
    base = technique.split(".")[0]
    return tuple(c for c, ts in BLOCKS.items() if any(t == technique or t.split(".")[0] == base for t in ts))


def risk_multiplier(defences: Column) -> Column:
    factor = F.create_map(*[x for kv in RISK_FACTORS.items() for x in map(F.lit, kv)])
    return F.aggregate(defences, F.lit(1.0), lambda a, d: a * F.coalesce(F.try_element_at(factor, d), F.lit(1.0)))


def _blocks(defences: Column, technique: str) -> Column:
    return F.arrays_overlap(defences, F.array(*map(F.lit, blocked_by(technique))).cast("array<string>"))


def edge_technique(port: Column) -> Column:
    out = F.lit(MOVE)
    for p, t in PORTS.items():
        out = F.when(port == p, t).otherwise(out)
    return out


def penalties(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by technique, by host): confidence times severity, summed over all observations so far of (technique_id, host, confidence, severity)."""
    weight = F.sum(F.col("confidence") * F.col("severity")).alias("penalty")
    technique = feedback.where("technique_id IS NOT NULL").groupBy("technique_id").agg(weight)
    return technique, feedback.where("host IS NOT NULL").groupBy("host").agg(weight)


def _steps(hosts: DataFrame, edges: DataFrame, cost_weight: float, risk_weight: float, by_technique: DataFrame | None, by_host: DataFrame | None) -> DataFrame:
    """All transitions: (source, target, technique_id, cost, risk, score, needs_priv, gains_priv, rationale); a null source enters."""
    h = hosts.select("hostname", F.coalesce("defences", F.array().cast("array<string>")).alias("d"), risk_multiplier(F.coalesce("defences", F.array().cast("array<string>"))).alias("m"), "is_internet_facing", F.coalesce(F.exists("credentials", lambda c: c["is_privileged"]), F.lit(False)).alias("priv"))
    cost = F.create_map(*[F.lit(x) for t, (c, _) in TECHNIQUES.items() for x in (t, c)])
    risk = F.create_map(*[F.lit(x) for t, (_, r) in TECHNIQUES.items() for x in (t, r)])
    text = F.lit(None).cast("string")
    no, yes = F.lit(False), F.lit(True)
    enter = h.where(F.col("is_internet_facing") & ~_blocks(F.col("d"), ENTRY)).select(text.alias("source"), F.col("hostname").alias("target"), F.lit(ENTRY).alias("technique_id"), "m", no.alias("needs_priv"), no.alias("gains_priv"), F.lit("entry at an exposed host").alias("rationale"))
    gain = h.where(F.col("priv") & ~_blocks(F.col("d"), DUMP)).select(F.col("hostname").alias("source"), F.col("hostname").alias("target"), F.lit(DUMP).alias("technique_id"), "m", no.alias("needs_priv"), yes.alias("gains_priv"), F.lit("privileged credential on the host").alias("rationale"))
    move = edges.join(h.withColumnRenamed("hostname", "target"), "target").withColumn("technique_id", edge_technique(F.col("port")))
    for t in (MOVE, *PORTS.values()):
        move = move.where((F.col("technique_id") != t) | ~_blocks(F.col("d"), t))
    gated = F.when(F.col("requires_privileged"), "privileged credential held").otherwise("no credential needed")
    move = move.select("source", "target", "technique_id", "m", F.col("requires_privileged").alias("needs_priv"), no.alias("gains_priv"), F.concat(F.lit("edge on port "), F.col("port").cast("string"), F.lit(", "), gated).alias("rationale"))
    out = enter.union(gain).union(move).withColumns({"cost": F.element_at(cost, F.col("technique_id")), "risk": F.element_at(risk, F.col("technique_id")) * F.col("m")})
    zero = F.lit(0.0)
    for table, key, own in ((by_technique, "technique_id", "technique_id"), (by_host, "host", "target")):
        if table is None:
            out = out.withColumn(f"_{key}", zero)
        else:
            out = out.join(table.select(F.col(key).alias(own), F.col("penalty").alias(f"_{key}")), own, "left").na.fill(0.0, [f"_{key}"])
    return out.withColumn("score", cost_weight * F.col("cost") + risk_weight * F.col("risk") + F.col("_technique_id") + F.col("_host")).select("source", "target", "technique_id", "cost", "risk", "score", "needs_priv", "gains_priv", "rationale")


def paths(hosts: DataFrame, edges: DataFrame, cost_weight: float = 1.0, risk_weight: float = 1.0, by_technique: DataFrame | None = None, by_host: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(host, score, cost, risk, hops, path, hosts): the path of least weighted score to every host that can be reached.

    hosts: hostname, defences, credentials, is_internet_facing; edges: source, target, port, requires_privileged. A state is a
    host and whether a privileged credential is held. Each round extends the states that got better by all
    steps and writes those that are better than before, until none is; scores are not negative, so it ends. Equal scores: fewest steps, then the hosts' names. With ``start`` (host, priv) paths go on
    from there, at no score, instead of from exposed hosts: a plan made anew from the present state.
    """
    if cost_weight < 0 or risk_weight < 0 or cost_weight == risk_weight == 0:
        raise ValueError("weights must not be negative, nor both 0")
    steps = stored(_steps(hosts, edges, cost_weight, risk_weight, by_technique, by_host))
    step = F.struct("technique_id", "source", "target", "cost", "risk", "rationale")
    rank = lambda: F.struct(F.round("score", 9).alias("score"), "hops", "hosts")
    entry = steps.where("source IS NULL").select(F.col("target").alias("host"), F.lit(False).alias("priv"), "score", "cost", "risk", F.lit(1).alias("hops"), F.array(step).alias("path"), F.array("target").alias("hosts"))
    if start is not None:
        none = entry.schema["path"].dataType
        zero = F.lit(0.0)
        entry = start.groupBy("host").agg(F.bool_or("priv").alias("priv")).select("host", "priv", zero.alias("score"), zero.alias("cost"), zero.alias("risk"), F.lit(0).alias("hops"), F.array().cast(none).alias("path"), F.array("host").alias("hosts"))
    names = entry.columns
    inner = steps.where("source IS NOT NULL").select(*[F.col(c).alias(f"s_{c}") for c in steps.columns])
    # what each round made better, and so the last of a state is its best
    fresh = stored(entry)
    written = [fresh]
    while True:
        out = fresh.join(inner, F.col("host") == F.col("s_source")).where((~F.col("s_needs_priv") | F.col("priv")) & (~F.col("s_gains_priv") | ~F.col("priv")))
        more = out.select(
            F.col("s_target").alias("host"), (F.col("priv") | F.col("s_gains_priv")).alias("priv"), (F.col("score") + F.col("s_score")).alias("score"), (F.col("cost") + F.col("s_cost")).alias("cost"), (F.col("risk") + F.col("s_risk")).alias("risk"), (F.col("hops") + 1).alias("hops"),
            F.concat("path", F.array(F.struct(*[F.col(f"s_{c}").alias(c) for c in ("technique_id", "source", "target", "cost", "risk", "rationale")]))).alias("path"), F.concat("hosts", F.array("s_target")).alias("hosts"),
        )
        best = more.groupBy("host", "priv").agg(F.min_by(F.struct(*names), rank()).alias("b")).select("b.*")
        known = reduce(DataFrame.unionByName, written).groupBy("host", "priv").agg(F.min(rank()).alias("_known"))
        fresh = stored(best.join(known, ["host", "priv"], "left").where(F.col("_known").isNull() | (rank() < F.col("_known"))).select(*names))
        if fresh.limit(1).count() == 0:
            break
        written.append(fresh)
        if len(written) > COMPACT:
            written = [stored(reduce(DataFrame.unionByName, written).groupBy("host", "priv").agg(F.min_by(F.struct(*names), rank()).alias("b")).select("b.*"))]
    return reduce(DataFrame.unionByName, written).groupBy("host").agg(F.min_by(F.struct("score", "cost", "risk", "hops", "path", F.array_distinct("hosts").alias("hosts")), rank()).alias("b")).select("host", "b.*")


def explained(found: DataFrame) -> DataFrame:
    """A row for each step of each path."""
    return found.select("host", F.posexplode("path").alias("i", "s")).select("host", (F.col("i") + 1).alias("step"), "s.*")


def unreachable(hosts: DataFrame, found: DataFrame) -> DataFrame:
    return hosts.select(F.col("hostname").alias("host")).join(found.select("host"), "host", "left_anti")


def exposure(hosts: DataFrame, found: DataFrame) -> DataFrame:
    """Reachable hosts by value and ease: (host, value, score, hops)."""
    return found.join(hosts.select(F.col("hostname").alias("host"), "value"), "host").select("host", "value", "score", "hops").orderBy(F.col("value").desc(), "score", "host")


def exceeds_window(interval: Column, window: Column) -> Column:
    """Would events this far apart fall outside a correlation window? An annotation for judging rules."""
    return F.coalesce((window > 0) & (interval >= 0) & (interval > window), F.lit(False))
