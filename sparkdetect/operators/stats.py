"""Distributions, bootstrap intervals and comparisons over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITERATIONS = 2000


def distribution(metrics: DataFrame) -> DataFrame:
    """For each metric of (run_id, metric, value): mean, median, sample deviation (0 for one run), extremes, spread, variation and a class."""
    out = metrics.groupBy("metric").agg(
        F.count("value").alias("runs"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    out = out.withColumn("spread", F.col("high") - F.col("low")).withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("stddev") / F.abs("mean")))
    return out.withColumn("stability", F.when(F.col("cv") < 0.05, "stable").when(F.col("cv") < 0.15, "moderate").otherwise("volatile"))


def slot(seed: int, *parts: Column, n: Column) -> Column:
    """A repeatable number below ``n`` from the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


#: Resamples that one task makes of a group at a time.
BLOCK = 50


def _resampled(metrics: DataFrame, iterations: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys, iteration, mean) of samples with replacement.

    A group is one array of its values, a number for each run, which goes to a row for every ``BLOCK`` iterations; each
    row folds its resamples over the array, so neither draws nor values are joined or shuffled.
    """
    if iterations < 1:
        raise ValueError("iterations must be positive")
    values = F.transform(F.array_sort(F.collect_list(F.struct("run_id", "value"))), lambda x: x["value"].cast("double"))
    groups = metrics.where("value IS NOT NULL").groupBy(*keys).agg(values.alias("values")).withColumn("n", F.size("values"))
    first = F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(BLOCK))).alias("first")
    blocks = groups.select(*keys, "values", "n", first).repartition(*keys, "first")
    draw = lambda it, at: F.get("values", slot(seed, it, at, n=F.col("n")).cast("int"))
    total = lambda it: F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, at: acc + draw(it, at))
    each = F.transform(F.sequence(F.col("first"), F.least(F.col("first") + BLOCK, F.lit(iterations)) - 1), lambda it: F.struct(it.alias("iteration"), (total(it) / F.col("n")).alias("mean")))
    return blocks.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def bootstrap(metrics: DataFrame, confidence: float = 0.95, iterations: int = ITERATIONS, seed: int = 0, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(metric, low, high): percentiles of the means of resamples. One value, or equal values, give a point."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    tail = (1 - confidence) / 2
    return _resampled(metrics, iterations, seed, list(keys)).groupBy(*keys).agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def compare(baseline: DataFrame, candidate: DataFrame, confidence: float = 0.95, iterations: int = ITERATIONS, seed: int = 0) -> DataFrame:
    """For each metric: difference of means, its interval, whether that excludes 0, and what it says."""
    a = _resampled(baseline, iterations, seed, ["metric"]).withColumnRenamed("mean", "a")
    b = _resampled(candidate, iterations, seed + 1, ["metric"]).withColumnRenamed("mean", "b")
    tail, diff = (1 - confidence) / 2, F.col("b") - F.col("a")
    span = a.join(b, ["metric", "iteration"]).groupBy("metric").agg(F.percentile(diff, F.lit(tail)).alias("low"), F.percentile(diff, F.lit(1 - tail)).alias("high"))
    means = baseline.groupBy("metric").agg(F.avg("value").alias("baseline_mean")).join(candidate.groupBy("metric").agg(F.avg("value").alias("candidate_mean")), "metric")
    out = means.join(span, "metric").withColumn("difference", F.col("candidate_mean") - F.col("baseline_mean"))
    out = out.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))
    says = F.when(~F.col("significant"), "no significant change").when(F.col("difference") > 0, "improvement").otherwise("regression")
    return out.withColumn("interpretation", says)


def detection_rates(cover: DataFrame) -> DataFrame:
    """(technique_id, runs, runs_detected, rate, reliability): reliable in all runs, never in none, else flaky.

    The denominator is the number of runs that executed anything.
    """
    runs = cover.agg(F.countDistinct("run_id").alias("runs"))
    by = cover.groupBy("technique_id", "run_id").agg(F.max("detected").alias("hit")).groupBy("technique_id").agg(F.count_if("hit").alias("runs_detected"))
    out = by.crossJoin(F.broadcast(runs)).withColumn("rate", F.col("runs_detected") / F.col("runs"))
    return out.withColumn("reliability", F.when(F.col("rate") >= 1, "reliable").when(F.col("rate") <= 0, "never").otherwise("flaky"))


def grade_distribution(scores: DataFrame) -> DataFrame:
    """(grade, runs, modal): how often each grade came; of the most frequent ones the first seen is modal."""
    out = scores.groupBy("grade").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run"))
    # the window sees a row for each grade
    rank = F.row_number().over(Window.orderBy(F.col("runs").desc(), "first_run"))
    return out.withColumn("modal", rank == 1)


def run_metrics(scores: DataFrame, names: tuple[str, ...] = ("technique_recall", "precision", "f1")) -> DataFrame:
    """(run_id, metric, value) of the scores of all runs."""
    return scores.select("run_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("run_id", "m.*")
