"""Roll-up of technique coverage to the controls of frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scorecard import ratio

SCHEMA = "framework string, control_id string, title string, techniques array<string>"


def controls_table(spark: SparkSession, rows: list[tuple[str, str, str, list[str]]]) -> DataFrame:
    for framework, control, _, techniques in rows:
        if not techniques:
            raise ValueError(f"{framework} {control}: a control needs a technique")
    return spark.createDataFrame(rows, SCHEMA)


def of_framework(controls: DataFrame, part: str) -> DataFrame:
    """Controls of frameworks whose name holds ``part``, whatever the case."""
    return controls.where(F.lower("framework").contains(part.lower()))


def assessed(controls: DataFrame, cover: DataFrame) -> DataFrame:
    """Each control with its executed and detected techniques, gaps, status and coverage; ``cover`` has technique_id and detected.

    effective: all executed techniques detected; partially_effective: some; ineffective: none; not_assessed: none executed.
    """
    flat = controls.select("framework", "control_id", F.explode("techniques").alias("technique_id"))
    met = flat.join(cover.groupBy("technique_id").agg(F.max("detected").alias("detected")), "technique_id").groupBy("framework", "control_id").agg(
        F.array_sort(F.collect_set("technique_id")).alias("in_scope"), F.array_sort(F.collect_set(F.when(F.col("detected"), F.col("technique_id")))).alias("detected")
    )
    none = F.array().cast("array<string>")
    out = controls.join(met, ["framework", "control_id"], "left").withColumns({"in_scope": F.coalesce("in_scope", none), "detected": F.coalesce("detected", none)})
    n, hit = F.size("in_scope"), F.size("detected")
    status = F.when(n == 0, "not_assessed").when(hit == n, "effective").when(hit > 0, "partially_effective").otherwise("ineffective")
    return out.withColumns({"status": status, "gaps": F.array_except("in_scope", "detected"), "coverage": ratio(hit, n)})


def rollup(controls: DataFrame) -> DataFrame:
    """For each framework: controls by status, how many are assessed, and coverage: a partly effective control is worth half."""
    out = controls.groupBy("framework").agg(F.count("*").alias("controls"), *[F.count_if(F.col("status") == s).alias(s) for s in ("effective", "partially_effective", "ineffective", "not_assessed")])
    out = out.withColumn("assessed", F.col("controls") - F.col("not_assessed"))
    return out.withColumn("coverage", ratio(F.col("effective") + 0.5 * F.col("partially_effective"), F.col("assessed")))


def remediation(controls: DataFrame) -> DataFrame:
    """Controls with gaps, ineffective ones first."""
    return controls.where("status IN ('ineffective', 'partially_effective')").orderBy("status", "framework", "control_id")


def unmapped(controls: DataFrame, cover: DataFrame) -> DataFrame:
    """Executed techniques of no control."""
    return cover.select("technique_id").distinct().join(controls.select(F.explode("techniques").alias("technique_id")), "technique_id", "left_anti")
