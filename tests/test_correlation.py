"""Sequences, thresholds and distinct counts: known cases, random ones against plain loops, and streams."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from sparkdetect.functions.fields import MapFields
from sparkdetect.operators import correlate as correlate_module
from sparkdetect.operators.correlate import correlate, correlate_one
from sparkdetect.operators.detect import scoped, with_truth
from sparkdetect.operators.rules import Correlation
from test_rules import events

A, B, C = ({"event_type": t} for t in "abc")


def chains(spark, rule, rows):
    """rows: (seconds, type, host, user, fields)."""
    df = events(spark, [(s, h, u, k, f, None) for s, k, h, u, f in rows])
    out = correlate_one(df, rule, MapFields())
    return sorted([e["event_id"] for e in r["supporting"]] + [r["event"]["event_id"]] for r in out.collect())


def at(*pairs, host="H1", user="u", fields=None):
    return [(s, k, host, user, fields or {}) for s, k in pairs]


SEQ = Correlation("s", "sequence", 600, "host", (A, B))
THR = Correlation("t", "threshold", 300, "host", select=A, threshold=3)


@pytest.mark.parametrize(("rows", "want"), [
    (at((0, "a"), (60, "b")), [["e0", "e1"]]), (at((0, "b"), (60, "a")), []), (at((0, "a"), (9999, "b")), []), (at((0, "a")) + at((60, "b"), host="H2"), []), (at((0, "a"), (10, "b"), (20, "a"), (30, "b")), [["e0", "e1"], ["e2", "e3"]]),
    (at((0, "a"), (600, "b")), [["e0", "e1"]]), (at((0, "a"), (601, "b")), []), (at((0, "a"), (60, "b"), host=None), []),
])
def test_sequences(spark, rows, want):
    assert chains(spark, SEQ, rows) == want


def test_sequence_by_user_and_exclude(spark):
    rule = Correlation("s", "sequence", 600, "user", (A, B), (None, {"p.name": "trusted"}))
    assert chains(spark, rule, at((0, "a")) + at((60, "b"), host="H2")) == [["e0", "e1"]]
    assert chains(spark, rule, at((0, "a")) + at((60, "b"), fields={"p.name": "trusted"})) == []


def test_a_failed_chain_releases_its_events(spark):
    rule = Correlation("s", "sequence", 600, "host", (A, B, C))
    assert chains(spark, rule, at((0, "a"), (100, "a"), (150, "b"), (650, "c"))) == [["e1", "e2", "e3"]]


@pytest.mark.parametrize(("offsets", "hits"), [((0, 10, 20), 1), ((0, 10), 0), ((0, 1000, 2000), 0), (range(0, 30, 5), 2), ((0, 150, 300), 1), ((0, 150, 301), 0)])
def test_thresholds(spark, offsets, hits):
    assert len(chains(spark, THR, at(*[(s, "a") for s in offsets]))) == hits


def test_distinct(spark):
    rule = Correlation("d", "distinct", 600, "host", select=A, threshold=3, distinct_field="destination.ip")
    rows = lambda ips: [(i, "a", "h", "u", {"destination.ip": ip}) for i, ip in enumerate(ips)]
    assert len(chains(spark, rule, rows(["1", "2", "3"]))) == 1
    assert chains(spark, rule, rows(["1"] * 20)) == []
    assert chains(spark, rule, rows(["1", None, "2"])) == []


def loop(rule, rows):
    """A plain pass over one key's rows (second, type, id)."""
    if rule.kind == "threshold":
        live, out = [], []
        for s, k, i in rows:
            if k == "a":
                live = [x for x in live if s - x[0] <= rule.window] + [(s, i)]
                if len(live) >= rule.threshold:
                    out.append([i for _, i in live])
                    live = []
        return out
    used, out, n = set(), [], len(rule.stages)
    for p, (s, k, i) in enumerate(rows):
        if k != "a" or i in used:
            continue
        chain, q = [i], p + 1
        for want in "bc"[: n - 1]:
            while q < len(rows) and not (rows[q][1] == want and rows[q][2] not in used):
                q += 1
            if q == len(rows) or rows[q][0] - s > rule.window:
                break
            chain.append(rows[q][2])
            q += 1
        if len(chain) == n:
            used |= set(chain)
            out.append(chain)
    return out


def test_random_against_loops(spark):
    rng = random.Random(5)
    rows, want = [], {"seq": [], "thr": []}
    seq, thr = Correlation("s", "sequence", 40, "host", (A, B, C)), Correlation("t", "threshold", 25, "host", select=A, threshold=3)
    for h in range(60):
        times = sorted(rng.sample(range(400), 25))
        own = [(t, rng.choice("abc"), f"e{len(rows) + j}") for j, t in enumerate(times)]
        rows += [(t, k, f"h{h}", "u", {}) for t, k, _ in own]
        want["seq"] += loop(seq, own)
        want["thr"] += loop(thr, own)
    assert chains(spark, seq, rows) == sorted(want["seq"])
    assert chains(spark, thr, rows) == sorted(want["thr"])


@pytest.mark.parametrize("rule", [Correlation("s", "sequence", 40, "host", (A, B, C)), Correlation("t", "threshold", 25, "host", select=A, threshold=3), Correlation("d", "distinct", 60, "host", select={"event_type|in": ["a", "b"]}, threshold=4, distinct_field="user")])
@pytest.mark.parametrize("hot_rows", [0, 200])
def test_hot_keys_are_cut_along_time(spark, monkeypatch, rule, hot_rows):
    """A key that never pauses for long and has most events, one with pauses, small ones: the same chains in pieces."""
    rng = random.Random(12)
    rows = [(t, rng.choice("abc"), "hot", f"u{rng.randrange(7)}", {}) for t in sorted(rng.choices(range(4000), k=900))]
    rows += [(t + 700 * (t // 100), rng.choice("abc"), "pausing", rng.choice(["x", "y", "z", "v", None]), {}) for t in sorted(rng.choices(range(1000), k=250))]
    rows += [(t, rng.choice("abc"), f"h{t % 9}", "u", {}) for t in rng.choices(range(500), k=60)]
    want = chains(spark, rule, rows)
    monkeypatch.setattr(correlate_module, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(correlate_module, "PIECE_ROWS", 40)
    assert chains(spark, rule, rows) == want and len(want) > 30


def test_hot_sequences_are_dealt_apart(spark, monkeypatch):
    rows = [(1000 * i + j, "ab"[j], "hot", "u", {}) for i in range(300) for j in range(2)]
    monkeypatch.setattr(correlate_module, "HOT_ROWS", 10)
    df = events(spark, [(s, h, u, k, f, None) for s, k, h, u, f in rows])
    base = scoped(df)
    cut = correlate_module._relevant(base, [correlate_module._entry(0, SEQ, MapFields())])
    cut = cut.withColumns({"length": F.lit(20_000_000_000), "piece": F.expr("t div 20000000000")})
    assert correlate_module._parted(cut, [SEQ]).select("part").distinct().count() == 300


def test_time_grows_with_the_events():
    """All in one window: starts that never come to an end, values that are all live, and rows of few ids."""
    from sparkdetect.operators.correlate import Seen, counted_chains, sequence_chains

    def took(n):
        began = time.perf_counter()
        assert list(sequence_chains((Seen(i, f"e{i}", 1, i) for i in range(n)), 3, 10**12)) == []
        assert list(sequence_chains((Seen(i, f"e{i}", 1 + 2 * (i > n // 2), i) for i in range(n)), 3, 10**12)) == []
        assert len(list(counted_chains((Seen(i, f"e{i}", i % 997, i) for i in range(n)), Correlation("d", "distinct", 10**6, select=A, threshold=998, distinct_field="x")))) == 0
        return time.perf_counter() - began

    took(10_000)
    assert took(200_000) < 12 * took(50_000) and took(200_000) < 20


def test_time_grows_with_the_chains():
    """Very many chains that are complete within one window: the events that they used are not all looked through at each."""
    from sparkdetect.operators.correlate import Seen, sequence_chains

    def took(n):
        began = time.perf_counter()
        found = [(a.at, b.at) for a, b in sequence_chains((Seen(i, f"e{i}", 1 + i % 2, i) for i in range(n)), 2, 10**12)]
        assert found == [(i, i + 1) for i in range(0, n, 2)]
        return time.perf_counter() - began

    took(8_000)
    assert took(24_000) < 15 * took(8_000)


def test_used_events_are_forgotten_after_a_window():
    """Chains of a plain pass where a window holds more used events than are kept without a look, and where far more come in all."""
    from sparkdetect.operators.correlate import Seen, sequence_chains

    rng = random.Random(8)
    rows = [(i // 4, rng.choice("abc"), f"e{i}") for i in range(60_000)]
    window, want = 5000, []
    # one kind is one stage, so the first second event ahead that is left is the first of a queue
    seconds = deque(i for i, r in enumerate(rows) if r[1] == "b")
    for i, (t, kind, name) in enumerate(rows):
        while seconds and seconds[0] < i:
            seconds.popleft()
        if kind == "a" and seconds and rows[seconds[0]][0] - t <= window:
            want.append([name, rows[seconds.popleft()][2]])
    got = [[e.id for e in c] for c in sequence_chains((Seen(s, i, "ab".find(k) + 1, i) for s, k, i in rows), 2, window)]
    assert got == want and len(want) > 15_000


def test_errors_are_isolated_and_text_is_built(spark):
    df = events(spark, [(0, "h", "u", "a", {}, "T1059"), (5, "h", "u", "b", {}, None)])
    out, errors = correlate(df, [SEQ, Correlation("bad", "threshold", 5, select=A)], MapFields())
    row = with_truth(out).first()
    assert errors[0][0] == "bad" and row["correlation_type"] == "sequence:host=h" and row["is_tp"] and row["purity"] == 0.5


def test_stream_equals_batch(spark, tmp_path):
    from sparkdetect.streaming.jobs import correlate_stream, detect_stream
    from sparkdetect.operators.rules import Rule

    rng = random.Random(9)
    rows = [(t, f"h{t % 3}", "u", rng.choice("abc"), {}, None) for t in sorted(rng.sample(range(3000), 300))]
    df = events(spark, [*rows, (500_000, "last", "u", "a", {}, None), (900_000, "last", "u", "a", {}, None)])
    flat = df.drop("fields", "labels")
    rng.shuffle(rows)
    for part in range(3):
        # out of order between files, and the closing rows last: the first moves the watermark, the second starts a batch
        flat.where(~F.col("event_id").isin("e300", "e301") & (F.pmod(F.hash("event_id"), F.lit(3)) == part)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    for e in ("e300", "e301"):
        flat.where(F.col("event_id") == e).coalesce(1).write.parquet(str(tmp_path / "in" / e))
    from sparkdetect.functions.fields import FlatFields

    stream = spark.readStream.schema(flat.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, rule in (("q1", Correlation("s", "sequence", 30, "host", (A, B))), ("q2", Correlation("t", "threshold", 30, "host", select=A, threshold=2))):
        q = correlate_stream(stream, rule, FlatFields(flat), "2 hours").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        want = sorted(r["alert_id"] for r in correlate_one(flat, rule, FlatFields(flat)).collect())
        assert sorted(r["alert_id"] for r in spark.table(name).collect()) == want and want
    q = detect_stream(stream, [Rule("r", {"s": A}, "s")], FlatFields(flat)).writeStream.format("memory").queryName("q3").option("checkpointLocation", str(tmp_path / "q3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("q3").count() == flat.where("event_type = 'a'").count()
