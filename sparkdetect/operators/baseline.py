"""Behavioural baselines: features by entity, robust centres and scales, anomaly scores."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Mapping
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import numbered

MAD_SCALE, EPSILON = 1.4826, 1e-12
RECENT = 101
TEXTS = ("process.command_line", "process.name", "destination.domain")


def check(min_samples: int, threshold: float, recent: int) -> None:
    if min_samples < 2 or threshold <= 0 or recent < max(min_samples, 3):
        raise ValueError("min_samples must be 2 or more, threshold positive, and the recent window no smaller than min_samples or 3")


def default_entity() -> Column:
    return F.concat(F.lit("host:"), F.coalesce("host", F.lit("")), F.lit("|user:"), F.coalesce("user", F.lit("")))


def _long(events: DataFrame, entity: Column | None, features: Column) -> DataFrame:
    keep = [c for c in ("run_id", "technique_id") if c in events.columns]
    entity = default_entity() if entity is None else entity
    rows = events.select(*keep, F.col("event_id").cast("string").alias("event_id"), "ts", entity.alias("entity"), F.explode(features).alias("feature", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(math.inf)))


def features_of_columns(events: DataFrame, numbers: Mapping[str, Column], texts: Mapping[str, Column] | None = None, entity: Column | None = None) -> DataFrame:
    """(event_id, ts, entity, feature, value) of a flat table: hour of day, number of present columns, numbers (booleans as 0 and 1), lengths of texts. Other values drop out."""
    texts = dict(texts or {})
    present = [F.when(c.isNotNull(), 1).otherwise(0) for c in [*numbers.values(), *texts.values()]]
    count = sum(present[1:], present[0]) if present else F.lit(0)
    parts = {"time.hour": F.hour("ts") + F.minute("ts") / 60.0, "event.field_count": count, **numbers, **{f"{n}.length": F.length(c) for n, c in texts.items()}}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), c.cast("double").alias("v")) for n, c in parts.items()])
    return _long(events, entity, F.map_from_entries(pairs))


def features_of_map(events: DataFrame, entity: Column | None = None, fields: str = "fields") -> DataFrame:
    """As ``features_of_columns`` for a MAP<STRING, VARIANT>: every number, booleans as 0 and 1, and the lengths of three texts."""
    kind = lambda v: F.schema_of_variant(v)
    entries = F.map_entries(fields)
    number = lambda v: F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(kind(v).isin("VOID", "STRING"), None).otherwise(F.try_variant_get(v, "$", "double"))
    pair = lambda k, v: F.struct(k.alias("k"), v.cast("double").alias("v"))
    numbers = F.transform(entries, lambda e: pair(e["key"], number(e["value"])))
    lengths = F.transform(
        F.filter(entries, lambda e: e["key"].isin(list(TEXTS)) & (kind(e["value"]) == "STRING")), lambda e: pair(F.concat(e["key"], F.lit(".length")), F.length(F.try_variant_get(e["value"], "$", "string")))
    )
    fixed = F.array(pair(F.lit("time.hour"), F.hour("ts") + F.minute("ts") / 60.0), pair(F.lit("event.field_count"), F.size(fields)))
    return _long(events, entity, F.map_from_entries(F.filter(F.concat(fixed, numbers, lengths), lambda x: x["v"].isNotNull())))


def fit(features: DataFrame, recent: int = RECENT) -> DataFrame:
    """(entity, feature, n, mean, stddev, recent, median, mad, entity_events): moments of all values, centre and spread of the last ``recent``.

    Also the snapshot of the model: a table to store. ``entity_events`` counts the entity's events.
    """
    moments = features.groupBy("entity", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"))
    last = Window.partitionBy("entity", "feature").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    lately = features.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= recent)
    lists = lately.groupBy("entity", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_n"), "value"))), lambda x: x["value"]).alias("recent"), F.median("value").alias("median"))
    lists = lists.withColumn("mad", _mad(F.col("recent"), F.col("median")))
    counts = features.groupBy("entity").agg(F.countDistinct("event_id").alias("entity_events"))
    return moments.join(lists, ["entity", "feature"]).join(counts, "entity")


def _middle(values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(values)
    high = F.get(values, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, high).otherwise((F.get(values, F.floor(n / 2).cast("int") - 1) + high) / 2)


def _mad(values: Column, centre: Column) -> Column:
    return _middle(F.array_sort(F.transform(values, lambda v: F.abs(v - centre))))


def _scored(rows: DataFrame, min_samples: int) -> DataFrame:
    """Add score, method, centre and scale from n, mean, stddev, median and mad."""
    n, scale = F.coalesce("n", F.lit(0)), F.lit(MAD_SCALE) * F.col("mad")
    off = F.abs(F.col("value") - F.col("mean"))
    few, robust, spread = n < min_samples, scale > EPSILON, F.col("stddev") > EPSILON
    pick = lambda a, b, c, d: F.when(few, a).when(robust, b).when(spread, c).otherwise(d)
    return rows.withColumns({
        "score": pick(F.lit(0.0), F.abs(F.col("value") - F.col("median")) / scale, off / F.col("stddev"), F.when(off <= EPSILON, 0.0).otherwise(F.lit(math.inf))),
        "method": pick(F.lit("insufficient_samples"), F.lit("median_mad"), F.lit("welford_zscore"), F.lit("zero_variance")),
        "centre": pick(F.coalesce("median", F.lit(0.0)), F.col("median"), F.col("mean"), F.col("mean")),
        "scale": pick(F.lit(0.0), scale, F.col("stddev"), F.lit(0.0)),
    })


def _found(rows: DataFrame, threshold: float) -> DataFrame:
    """Findings: rows at or above the threshold, with an explanation."""
    value, centre = F.format_string("%s=%s", "feature", F.col("value").cast("string")), F.col("centre").cast("string")
    detail = F.when(F.col("method") == "feature_novelty", F.format_string("%s appeared for the first time after %d baseline events", F.col("feature"), F.col("sample_count"))).when(
        F.col("method") == "zero_variance", F.concat(value, F.lit(" changed from constant baseline "), centre, F.format_string(" across %d prior samples", "sample_count"))
    ).otherwise(F.concat(value, F.format_string(" is %.2f robust deviations from ", "score"), centre, F.lit(" (scale "), F.col("scale").cast("string"), F.format_string(") across %d prior samples", "sample_count")))
    keep = [c for c in ("run_id", "technique_id") if c in rows.columns]
    return rows.where(F.col("score") >= threshold).withColumns({"threshold": F.lit(float(threshold)), "explanation": detail}).select(
        *keep, "event_id", "ts", "entity", "feature", "value", "score", "threshold", "sample_count", "method", "centre", "scale", "explanation"
    )


def score(features: DataFrame, model: DataFrame, min_samples: int = 5, threshold: float = 3.5) -> DataFrame:
    """Findings of events against a fitted model, which stays as it is.

    A feature that a mature entity never had is a finding of infinite score, on its first event alone.
    """
    check(min_samples, threshold, RECENT)
    counts = model.select("entity", F.col("entity_events").alias("_events")).distinct()
    own = model.drop("recent", "entity_events")
    rows = features.join(own, ["entity", "feature"], "left").join(counts, "entity", "left")
    known = rows.where("n IS NOT NULL")
    first = Window.partitionBy("entity", "feature").orderBy("ts", "event_id")
    new = rows.where("n IS NULL").withColumn("_r", F.row_number().over(first)).where((F.col("_r") == 1) & (F.col("_events") >= min_samples)).drop("_r")
    known = _scored(known, min_samples).withColumn("sample_count", F.col("n"))
    new = new.withColumns({"score": F.lit(math.inf), "method": F.lit("feature_novelty"), "centre": F.lit(0.0), "scale": F.lit(0.0), "sample_count": F.col("_events")})
    return _found(known.unionByName(new), threshold)


class Known:
    """What is known of a feature of an entity: moments of all values, and the last ``recent`` in order of time and of size."""

    def __init__(self, recent: int):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0
        self.lately: deque[float] = deque(maxlen=recent)
        self.ordered: list[float] = []

    def learn(self, value: float) -> None:
        if len(self.lately) == self.lately.maxlen:
            del self.ordered[bisect_left(self.ordered, self.lately[0])]
        self.lately.append(value)
        insort(self.ordered, value)
        self.n += 1
        off = value - self.mean
        self.mean += off / self.n
        self.m2 += off * (value - self.mean)

    def figures(self) -> tuple[int, float, float, float, float]:
        """n, mean, stddev, median and mad."""
        near = np.array(self.ordered)
        half, odd = divmod(len(near), 2)
        centre = near[half] if odd else (near[half - 1] + near[half]) / 2
        off = np.sort(np.abs(near - centre))
        return self.n, self.mean, math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0, float(centre), float(off[half] if odd else (off[half - 1] + off[half]) / 2)


def observe(features: DataFrame, min_samples: int = 5, threshold: float = 3.5, recent: int = RECENT) -> DataFrame:
    """Findings of each event against the events of its entity before it: score, then learn.

    An entity's rows come in order of time and are folded one by one; what is held of it are a few numbers and ``recent`` values for each feature.
    """
    check(min_samples, threshold, recent)
    dealt = features.repartition("entity").sortWithinPartitions("entity", "ts", "event_id", "feature", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity = last = None
        known: dict[str, Known] = {}
        events = 0
        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            out = []
            for who, ts, event, feature, value in zip(*map(column, ("entity", "ts", "event_id", "feature", "value")), strict=True):
                if who != entity:
                    entity, last, known, events = who, None, {}, -1
                if last != (ts, event):
                    last, events = (ts, event), events + 1
                own = known.get(feature)
                if own is None:
                    own = known[feature] = Known(recent)
                    out.append((0, None, None, None, None, events))
                else:
                    out.append((*(own.figures() if own.n >= min_samples else (own.n, own.mean, 0.0, None, None)), events))
                own.learn(value)
            more = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), *[pa.float64()] * 4, pa.int64()), strict=True)] if out else []
            if more:
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "n", "mean", "stddev", "median", "mad", "_events"])

    kinds = {"n": "long", "mean": "double", "stddev": "double", "median": "double", "mad": "double", "_events": "long"}
    rows = dealt.mapInArrow(run, T.StructType([*features.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items())]))
    new = (F.col("n") == 0) & (F.col("_events") >= min_samples)
    rows = _scored(rows, min_samples).withColumn("sample_count", F.when(new, F.col("_events")).otherwise(F.col("n")))
    return _found(rows.withColumns({"score": F.when(new, F.lit(math.inf)).otherwise(F.col("score")), "method": F.when(new, "feature_novelty").otherwise(F.col("method"))}), threshold)


def calibration_split(events: DataFrame, by: str = "user", share: float = 0.7, least: int = 5) -> DataFrame:
    """Add split: the first max(``least``, ``share`` * n, rounded down) benign rows of each ``by`` calibrate; the others and all malicious rows evaluate.

    The share is taken as it is written: 0.7 of 360 rows are 252, where binary fractions give 251.99999999999997.
    """
    rows = numbered(events.withColumn("_benign", F.col("technique_id").isNull()), [by, "_benign"], [F.col("ts"), F.col("event_id")], "_at", "_of")
    cut = F.greatest(F.lit(least), F.floor(F.col("_of") * F.lit(Decimal(str(share)))).cast("long"))
    return rows.withColumn("split", F.when(F.col("_benign") & (F.col("_at") <= cut), "calibrate").otherwise("evaluate")).drop("_benign", "_at", "_of")


def evaluate(findings: DataFrame, events: DataFrame) -> DataFrame:
    """One row: findings, distinct anomalous events, true and false positives, precision and recall against the labels of ``events``."""
    ids = findings.select("event_id").distinct()
    truth = events.select(F.col("event_id").cast("string").alias("event_id"), F.col("technique_id").isNotNull().alias("bad"))
    met = truth.join(ids.withColumn("_found", F.lit(True)), "event_id", "left")
    hit, bad = F.coalesce("_found", F.lit(False)), F.col("bad")
    out = met.agg(F.count("*").alias("evaluation_events"), F.count_if("bad").alias("malicious_events"), F.count_if(hit).alias("anomalous_events"), F.count_if(hit & bad).alias("true_positive_events"), F.count_if(hit & ~bad).alias("false_positive_events"))
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.withColumns({"precision": div("true_positive_events", "anomalous_events"), "event_recall": div("true_positive_events", "malicious_events")})


def top_findings(findings: DataFrame, n: int = 20) -> DataFrame:
    """Attack events first, then by score."""
    return findings.orderBy(F.col("technique_id").isNull(), F.col("score").desc(), "event_id", "feature").limit(n)
