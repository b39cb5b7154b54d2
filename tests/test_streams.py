"""Streams that stop and go on from their checkpoints give what a batch gives, each alert as soon as it is certain."""

import random

import pytest
from pyspark.sql import functions as F

from sparkdetect.functions.fields import FlatFields
from sparkdetect.operators import baseline
from sparkdetect.operators.correlate import correlate_one
from sparkdetect.operators.rules import Correlation
from sparkdetect.streaming.jobs import baseline_stream, correlate_stream, settled
from test_rules import events

A, B, C = ({"event_type": t} for t in "abc")
RULES = {
    "sequence": Correlation("s", "sequence", 60, "host", (A, B, C)), "threshold": Correlation("t", "threshold", 40, "host", select=A, threshold=3), "distinct": Correlation("d", "distinct", 60, "host", select={"event_type|in": ["a", "b"]}, threshold=3, distinct_field="user"),
}


@pytest.mark.parametrize("name", RULES)
def test_chains_go_on_from_a_checkpoint(spark, tmp_path, name):
    rule, rng = RULES[name], random.Random(3)
    rows = [(t, f"h{t % 3}", f"u{rng.randrange(5)}", rng.choice("abc"), {}, None) for t in sorted(rng.sample(range(2400), 300))]
    flat = events(spark, [*rows, (9000, "h0", "u", "a", {}, None)]).drop("fields", "labels")
    want, found = sorted(r["alert_id"] for r in correlate_one(flat, rule, FlatFields(flat)).collect()), []
    for part in range(3):
        own = (F.unix_timestamp("ts") - F.lit(1704067200)).between(800 * part, 800 * part + 799) if part < 2 else F.col("ts") >= F.timestamp_seconds(F.lit(1704067200 + 1600))
        flat.where(own).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        stream = spark.readStream.schema(flat.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found.append([r["alert_id"] for r in settled(correlate_stream(stream, rule, FlatFields(flat), "5 seconds"), str(tmp_path / "out")).collect()])
    assert sorted(found[-1]) == want and len(want) > 5
    # those that were certain at the end of the first and second run had come by then
    assert 0 < len(found[0]) <= len(found[1]) <= len(want) and len(found[0]) < len(want) and set(found[0]) <= set(found[1])


def test_baselines_go_on_from_a_checkpoint(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"e{i:03}", 1_700_000_000 + i, f"u{i % 3}", f"f{rng.randrange(4)}", rng.gauss(5, 1) if i % 40 else 50.0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id string, s long, entity string, feature string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = sorted((r.event_id, r.feature, round(min(r.score, 1e9), 6), r.method) for r in baseline.observe(df).collect())
    for part in range(2):
        df.where((F.col("event_id") < "e150") == (part == 0)).write.parquet(str(tmp_path / "in" / f"p{part}"))
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = settled(baseline_stream(stream), str(tmp_path / "out")).collect()
    assert sorted((r.event_id, r.feature, round(min(r.score, 1e9), 6), r.method) for r in got) == want and len(want) > 3
