"""Baselines, incidents, exposure, sources, and streams of baselines: known cases."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkdetect.functions import order
from sparkdetect.operators import baseline, exposure, incidents
from sparkdetect.operators.graph import components
from sparkdetect.operators.rules import errors_table, rule_listing, rules_table
from sparkdetect.plans import behaviour
from sparkdetect.sources import events as sources
from sparkdetect.sources import rule_files
from test_rules import T0, events


def feats(spark, values, entity="e", feature="metric", start=0):
    return spark.createDataFrame([(f"x{start + i:04}", T0 + dt.timedelta(seconds=start + i), entity, feature, float(v)) for i, v in enumerate(values)], "event_id string, ts timestamp, entity string, feature string, value double")


def test_fit_and_score(spark):
    row = baseline.fit(feats(spark, [2, 4, 4, 4, 5, 5, 7, 9])).first()
    assert (row["n"], row["mean"], round(row["stddev"] ** 2, 9)) == (8, 5.0, round(32 / 7, 9))
    model = baseline.fit(feats(spark, [10, 10, 11, 9, 10, 1000]))
    found = baseline.score(feats(spark, [13], start=50), model, 5, 3.5).first()
    assert (found["method"], found["centre"], round(found["scale"], 4), round(found["score"], 3)) == ("median_mad", 10.0, 0.7413, round(3 / 0.7413, 3))
    flat = baseline.fit(feats(spark, [7] * 5))
    assert baseline.score(feats(spark, [7], start=50), flat).count() == 0
    assert baseline.score(feats(spark, [8], start=50), flat).first()["score"] == math.inf
    with pytest.raises(ValueError):
        baseline.score(feats(spark, [1]), flat, 1)


def test_not_finite_values_drop_out(spark):
    df = events(spark, [(i, "h", "u", "t", {"m": v}, None) for i, v in enumerate([1e12 + 1, 1e12 + 2, 1e12 + 3])])
    row = baseline.fit(baseline.features_of_map(df)).where("feature = 'm'").first()
    assert (row["n"], row["mean"], round(row["stddev"], 6)) == (3, 1e12 + 2, 1.0)


def test_observe_learns_after_scoring(spark):
    out = baseline.observe(feats(spark, [10, 10, 10, 999]), 3, 3.5).collect()
    assert [(r["event_id"], r["score"], r["sample_count"]) for r in out] == [("x0003", math.inf, 3)]


@pytest.mark.parametrize(("rows", "calibrate"), [(5, 5), (6, 5), (10, 7), (90, 63), (170, 119), (180, 126), (360, 252)])
def test_the_share_of_a_split_is_exact(spark, rows, calibrate):
    """0.7 of 90, 170, 180 or 360 rows is a whole number, which binary fractions miss."""
    df = spark.range(rows + 3).select(F.format_string("e%04d", "id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit("u").alias("user"), F.when(F.col("id") >= rows, "T1").alias("technique_id"))
    got = {r["event_id"] for r in baseline.calibration_split(df).where("split = 'calibrate'").collect()}
    assert got == {f"e{i:04}" for i in range(calibrate)}


def split_tables(spark, path):
    """A user with 90 benign events, of which the last is far off, and one attack."""
    kinds = [("view", 10.0 + i % 5, i % 3 + 1) for i in range(89)] + [("view", 900.0, 1), ("error", 12.0, 2)]
    rows = [(i, T0.replace(tzinfo=None) + dt.timedelta(seconds=i), 7, k, v, json.dumps({"k": n})) for i, (k, v, n) in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_evaluated_events_of_a_split(spark, tmp_path):
    row = behaviour.baseline_eval(spark, split_tables(spark, tmp_path)).first()
    # 63 of 90 calibrate; 27 and the attack are left
    assert (row["evaluation_events"], row["malicious_events"]) == (28, 1)


def test_scores_of_a_split(spark, tmp_path):
    found = {(r["event_id"], r["feature"]): (r["method"], r["sample_count"]) for r in behaviour.baseline_score(spark, split_tables(spark, tmp_path)).collect()}
    assert found["89", "value"] == ("median_mad", 63)


def test_new_feature_counts_once_and_when_mature(spark):
    old = baseline.fit(feats(spark, [1, 2, 3]))
    new = feats(spark, [5, 6], feature="other", start=50)
    out = baseline.score(new, old, 3).collect()
    assert [(r["event_id"], r["method"], r["sample_count"], r["score"]) for r in out] == [("x0050", "feature_novelty", 3, math.inf)]
    assert baseline.score(new, baseline.fit(feats(spark, [1, 2])), 3).count() == 0


def test_baseline_stream_equals_observe(spark, tmp_path):
    from sparkdetect.streaming.jobs import baseline_stream

    rows = feats(spark, [10, 10, 11, 9, 10, 60, 10, 11, 9, 80] * 3).union(feats(spark, [5] * 4 + [6], "f", start=100)).union(feats(spark, [1], "e", "fresh", start=20).withColumn("event_id", F.lit("x0020")))
    for i, (a, b) in enumerate(((0, 9), (10, 19), (20, 999))):
        rows.where(F.substring("event_id", 2, 4).cast("int").between(a, b)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = baseline_stream(stream).writeStream.format("memory").queryName("b1").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["event_id"], r["feature"], r["method"], round(min(r["score"], 1e9), 6), r["sample_count"])
    assert sorted(map(key, spark.table("b1").collect())) == sorted(map(key, baseline.observe(rows).collect()))


def test_a_baseline_stream_may_forget(spark, tmp_path):
    from sparkdetect.streaming.jobs import baseline_stream

    feats(spark, [10, 10, 11, 9, 10, 60]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feats(spark, [1]).schema).parquet(str(tmp_path / "in"))
    q = baseline_stream(stream, forget_after="30 days").writeStream.format("memory").queryName("b2").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["event_id"] for r in spark.table("b2").collect()] == ["x0005"]


def alerts(spark, rows):
    """(id, seconds, host, user, risk, rule, event)."""
    data = [("r", "s", i, rule, "t", "medium", 2, ["T1059"], "execution", (ev, T0 + dt.timedelta(seconds=s), "k", h, u, None, None, *(to or (None, None))), [], "", risk) for i, s, h, u, risk, rule, ev, *to in rows]
    event = "struct<event_id:string,ts:timestamp,event_type:string,host:string,user:string,technique_id:string,tactic:string,destination:string,domain:string>"
    return spark.createDataFrame(data, f"run_id string, scenario_id string, alert_id string, rule_id string, rule_title string, severity string, severity_rank int, techniques array<string>, rule_tactic string, event {event}, supporting array<{event}>, correlation_type string, risk_score int")


def test_incidents(spark):
    df = alerts(spark, [("a", 0, "H1", "x", 10, "r1", "1"), ("b", 120, "h1", "y", 20, "r2", "2"), ("c", 1000, "h1", "z", 30, "r1", "3"), ("d", 1, "H2", "bob", 80, "r1", "4"), ("e", 1, "H2", "bob", 80, "r1", "4"), ("f", 2, "H2", "bob", 50, "r2", "5")])
    out = incidents.reconstruct(df, 300).collect()
    assert sorted(r["alert_ids"] for r in out) == [["a", "b"], ["c"], ["d", "e", "f"]]
    one = next(r for r in out if r["alerts"] == 3)
    assert one["risk_score"] == 90.0 and one["entities"] == ["host:h2", "user:bob"] and [s["tactic"] for s in one["tactic_progression"]] == ["execution"]
    again = incidents.reconstruct(df.orderBy(F.col("alert_id").desc()).withColumn("is_tp", F.lit(True)), 300).collect()
    assert sorted((r["incident_id"], r["risk_score"], r["confidence"]) for r in again) == sorted((r["incident_id"], r["risk_score"], r["confidence"]) for r in out)


def test_destinations_link_by_address_and_by_domain(spark):
    df = alerts(spark, [("a", 0, "h1", "x", 10, "r1", "1", "10.0.0.9", "Evil.Example"), ("b", 10, "h2", "y", 20, "r2", "2", None, "evil.example"), ("c", 20, "h3", "z", 30, "r1", "3", "10.0.0.9", "other.example"), ("d", 30, "h4", "w", 30, "r1", "4", "", "")])
    out = incidents.reconstruct(df, 300, {"T1059": "impact", "T9": "collection"}).collect()
    assert sorted(r["alert_ids"] for r in out) == [["a", "b", "c"], ["d"]]
    one = next(r for r in out if r["alerts"] == 3)
    assert "destination:evil.example" in one["entities"] and "destination:10.0.0.9" in one["entities"]
    assert [s["tactic"] for s in one["tactic_progression"]] == ["impact"]  # the given table adds to the known one
    assert {r["alert_id"]: r["entities"] for r in one["evidence_lineage"]}["b"] == ["destination:evil.example", "host:h2", "user:y"]
    with pytest.raises(ValueError, match="negative"):
        incidents.reconstruct(df, -1)
    assert [r["incident_id"] for r in incidents.ranked(incidents.reconstruct(df, 300)).collect()][0] == one["incident_id"]
    text = spark.createDataFrame([("STRASSE",), ("Straße",), ("ΣΑΣ",), ("σας",)], "t string").select(incidents.folded(F.col("t"))).collect()
    assert text[0] == text[1] and text[2] == text[3]


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(200)] + [("x", "y"), ("z", None)], "src string, dst string")
    out = {r["node"]: r["label"] for r in components(edges).collect()}
    assert len(out) == 203 and {v for k, v in out.items() if k not in "xy"} == {"000"} and out["y"] == "x"
    assert components(edges.where("false")).count() == 0


HOSTS = "hostname string, value int, defences array<string>, credentials array<struct<username:string,domain:string,is_privileged:boolean>>, is_internet_facing boolean"
EDGES = "source string, target string, port int, requires_privileged boolean"


def test_paths(spark):
    hosts = spark.createDataFrame([("ENTRY", 1, [], [], True), ("MON", 1, ["edr", "sysmon", "app_allowlist"], [], False), ("Q1", 1, [], [], False), ("Q2", 1, [], [], False), ("GOAL", 9, [], [], False)], HOSTS)
    edges = spark.createDataFrame([("ENTRY", "MON", 22, False), ("MON", "GOAL", 22, False), ("ENTRY", "Q1", 22, False), ("Q1", "Q2", 22, False), ("Q2", "GOAL", 22, False)], EDGES)
    goal = lambda **w: exposure.paths(hosts, edges, **w).where("host = 'GOAL'").first()["hosts"]
    assert goal(cost_weight=1.0, risk_weight=0.0) == ["ENTRY", "MON", "GOAL"]
    assert goal(cost_weight=1.0, risk_weight=10.0) == ["ENTRY", "Q1", "Q2", "GOAL"]
    feedback = spark.createDataFrame([(None, "MON", 1.0, 5.0)], "technique_id string, host string, confidence double, severity double")
    t, h = exposure.penalties(feedback)
    assert exposure.paths(hosts, edges, 1.0, 0.0, t, h).where("host = 'GOAL'").first()["hosts"] == ["ENTRY", "Q1", "Q2", "GOAL"]
    assert exposure.unreachable(hosts, exposure.paths(hosts, edges.where("false"))).count() == 4
    assert exposure.explained(exposure.paths(hosts, edges)).where("host = 'GOAL'").count() == 4


@pytest.mark.parametrize(("creds", "defences", "reached"), [([], [], False), ([("a", "d", True)], [], True), ([("a", "d", True)], ["credential_guard"], False)])
def test_gated_edges(spark, creds, defences, reached):
    hosts = spark.createDataFrame([("ENTRY", 1, defences, creds, True), ("GOAL", 9, [], [], False)], HOSTS)
    edges = spark.createDataFrame([("ENTRY", "GOAL", 445, True)], EDGES)
    assert (exposure.paths(hosts, edges).where("host = 'GOAL'").count() == 1) is reached


def test_events_in_and_out(spark, tmp_path):
    row = {"timestamp": "2024-01-01T00:00:05+00:00", "source": "s", "event_type": "t", "host": "h", "user": "u", "fields": {"b.n": 1, "a.t": "x", "c": True, "d": None}, "labels": {"technique_id": "T1"}}
    other = row | {"fields": dict(reversed(row["fields"].items()))}
    (tmp_path / "e.json").write_text("\n".join(json.dumps(r) for r in (row, other, row | {"host": "z", "labels": {}})))
    df = sources.read_events(spark, str(tmp_path / "e.json"))
    ids = [r["event_id"] for r in df.collect()]
    assert len(ids[0]) == 16 and ids[0] == ids[1] != ids[2]
    assert [r["technique_id"] for r in df.collect()] == ["T1", "T1", None]
    sources.write_table(df, str(tmp_path / "out"))
    assert sources.read_event_table(spark, str(tmp_path / "out")).count() == 3
    sources.write_table(df, str(tmp_path / "json"), "json")
    techniques = sources.technique_columns(spark.createDataFrame([("T1059.001",), ("X1",)], "technique_id string"), "u").collect()
    assert [(r["base_technique"], r["url"]) for r in techniques] == [("T1059", "u/T1059/001")]


def test_rule_files(spark, tmp_path):
    good = {"id": "A", "level": "high", "tags": ["attack.credential_access", "attack.t1003.001"], "detection": {"s": {"x": 1}, "condition": "s"}}
    files = {
        "1.json": good, "2.json": good, "3.json": {"id": "B", "detection": {}}, "4.json": [1], "5.json": good | {"id": "C", "level": "odd"}, "6.json": {"id": "D", "detection": {"s": {"x": 1}}},
        "7.json": {"id": "E", "correlation": {"type": "sequence", "window_seconds": 5, "stages": [{"a": {"x": 1}}, {"b": {"selection": {"x": 2}, "exclude": {"y": 1}}}]}}, "8.json": {"id": "F", "correlation": {"type": "sequence"}}, "9.json": {"id": "G", "correlation": {"type": "threshold", "window_seconds": 5, "selection": {"x": 1}}},
    }
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    rules, errors = rule_files.load_rules(spark, tmp_path)
    assert [r.rule_id for r in rules] == ["A", "E"] and [e["file"] for e in errors.collect()] == [f"{n}.json" for n in (2, 3, 4, 5, 6, 8, 9)]
    assert rules[0].techniques == ("T1003.001",) and rules[0].tactic == "credential-access" and rules[1].excludes == (None, {"y": 1})
    (tmp_path / "m").mkdir()
    told = good | {"id": "M", "description": " What it means. ", "falsepositives": ["admins"], "references": ["r1", "r2"], "techniques": [{"technique_id": "T1486", "name": "Encryption", "tactic": "impact"}, {"technique_id": "T1490"}]}
    (tmp_path / "m" / "m.json").write_text(json.dumps(told))
    (m,), _ = rule_files.load_rules(spark, tmp_path / "m")
    assert (m.description, m.false_positives, m.references, m.techniques, m.technique_names, m.tactic) == ("What it means.", ("admins",), ("r1", "r2"), ("T1486", "T1490"), ("Encryption", "T1490"), "impact")
    row = rule_listing(rules_table(spark, [m]), errors_table(spark, [])).first()
    assert row["description"] == m.description and row["references"] == ["r1", "r2"] and row["false_positives"] == ["admins"] and row["technique_names"] == ["Encryption", "T1490"]
    again, _ = rule_files.load_rules(spark, rule_files.write_drafts([m], tmp_path / "n")[0].parent)
    assert again[0].description == m.description and again[0].references == m.references
    back, _ = rule_files.load_rules(spark, rule_files.write_drafts([rules[0]], tmp_path / "d")[0].parent)
    assert back[0].fingerprint == rules[0].fingerprint and not back[0].enabled


def test_a_batch_is_committed_once(spark, tmp_path):
    df, path = spark.range(5).withColumn("x", F.lit("a")), str(tmp_path / "t")
    assert sources.commit_batch(df, path, 0) and not sources.commit_batch(df, path, 0) and sources.commit_batch(df, path, 1)
    (tmp_path / "t" / "_aside-broken").mkdir()
    (tmp_path / "t" / "_aside-broken" / "part-0.parquet").write_text("half")
    assert sources.read_batches(spark, path).count() == 10 and not [p for p in (tmp_path / "t" / "batch=0").iterdir() if p.name.startswith("_aside")]
    # as the sink of a stream: the first batch is written, then the stream begins anew from nothing
    df.write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda b, i: sources.commit_batch(b, str(tmp_path / "s"), i)).option("checkpointLocation", str(tmp_path / f"c{run}")).trigger(availableNow=True).start().awaitTermination()
    assert sources.read_batches(spark, str(tmp_path / "s")).count() == 5


@pytest.mark.parametrize("most", [order.HOT_ROWS, 20])
def test_order_of_hot_keys(spark, monkeypatch, most):
    """A key with half of all rows, null keys and ties: places and predecessors as in one window, dealt over ranges or not."""
    monkeypatch.setattr(order, "HOT_ROWS", most)
    rows = [("hot" if i % 2 else [None, "a", "b", "c"][i % 4 + i % 3 - i % 2 if i % 4 + i % 3 < 4 else 1], (i * 37) % 101, f"i{i:03}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, id string")
    groups = {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(k, []).append((t, i))
    got = order.with_previous(df, ["k"], ["t", "id"], {"src": "id", "_t": "t"})
    assert {r.id: (r.src, r._t) for r in got.collect()} == {i: (own[n - 1][::-1] if n else (None, None)) for own in groups.values() for n, (t, i) in enumerate(own)}
    got = order.numbered(df, ["k"], [F.col("t").desc(), F.col("id")], "place", "of")
    want = {i: (n, len(own)) for own in groups.values() for n, (t, i) in enumerate(sorted(own, key=lambda r: (-r[0], r[1])), 1)}
    assert {r.id: (r.place, r.of) for r in got.collect()} == want


def test_long_paths(spark, monkeypatch):
    """A chain of hosts with a dear short cut, over several compactions of the rounds."""
    monkeypatch.setattr(exposure, "COMPACT", 3)
    names = [f"h{i:02}" for i in range(14)]
    hosts = spark.createDataFrame([(n, [] if n != "h09" else ["edr"] * 9, [], i == 0) for i, n in enumerate(names)], "hostname string, defences array<string>, credentials array<struct<is_privileged:boolean>>, is_internet_facing boolean")
    edges = spark.createDataFrame([(a, b, 22, False) for a, b in zip(names, names[1:], strict=False)] + [("h02", "h09", 22, False)], "source string, target string, port int, requires_privileged boolean")
    found = {r["host"]: r for r in exposure.paths(hosts, edges).collect()}
    assert len(found) == 14 and found["h08"]["hosts"] == names[:9] and found["h13"]["hosts"] == [*names[:3], *names[9:]] and found["h13"]["hops"] == 8
