"""Continuous detection, correlation and baselines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Field
from ..functions.tables import shared_dir
from ..operators.baseline import RECENT, check
from ..operators.correlate import correlate_one
from ..operators.detect import detect
from ..operators.rules import Correlation, Rule
from .processors import BaselineProcessor, typed_state


def detect_stream(events: DataFrame, rules: Iterable[Rule], fields: Callable[[str], Field | None]) -> DataFrame:
    """Alerts of single-event rules; stateless, the plan of a batch."""
    return detect(events, rules, fields)[0]


def correlate_stream(events: DataFrame, rule: Correlation, fields: Callable[[str], Field | None], lateness: str = "10 minutes") -> DataFrame:
    """Alerts of a correlation in append mode.

    A chain is told when the watermark, ``lateness`` behind the latest row that the rule selects, has passed the event
    that completes it; this gives what a batch gives. Later rows are dropped. Spark filters before it takes the time, so
    other rows do not move the watermark.
    """
    return correlate_one(events.withWatermark("ts", lateness), rule, fields)


FOUND = "event_id string, ts timestamp, entity string, feature string, value double, score double, sample_count long, method string"


def baseline_stream(features: DataFrame, min_samples: int = 5, threshold: float = 3.5, recent: int = RECENT, forget_after: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Findings of (event_id, ts, entity, feature, value), each event judged by those of its entity before it, then learnt.

    State of an entity: an entry for each feature with a count, a mean, a sum of squares and the last ``recent`` values;
    a micro-batch writes those of the features that it brings. Its rows are taken in order of time. With ``forget_after``
    (as "30 days") rows later than ``lateness`` are dropped and an entity without events for so long, in event time, is
    forgotten; without, entities are kept for ever.
    """
    check(min_samples, threshold, recent)
    pause = int(pd.Timedelta(forget_after).total_seconds() * 1000) if forget_after else 0
    typed_state(features.sparkSession)
    if pause:
        features = features.withWatermark("ts", lateness)
    rows = features.select("event_id", "ts", "entity", "feature", F.col("value").cast("double"))
    return rows.groupBy("entity").transformWithState(BaselineProcessor(min_samples, threshold, recent, pause), FOUND, "Append", "EventTime" if pause else "None")


def settled(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All that ``stream`` gives for what its source has now, written with a checkpoint to a file sink and read back.

    Run again with the same ``folder`` it goes on from its checkpoint: what was read is not read again, and what was
    written stays.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
