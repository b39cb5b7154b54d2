"""Predicates, conditions and detection on events with typed columns and with maps of variants."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkdetect.functions.fields import FlatFields, MapFields
from sparkdetect.functions.predicates import RuleError
from sparkdetect.operators.detect import all_events, claims, detect, ordered, with_truth
from sparkdetect.operators.rules import Correlation, Rule, compiled, errors_table, rule_listing, rules_table, validate
from sparkdetect.plans import packs
from sparkdetect.sources.events import labelled

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def events(spark, rows):
    """(seconds, host, user, event_type, fields, technique) as a map table."""
    data = [(f"e{i}", T0 + dt.timedelta(seconds=s), "src", kind, host, user, json.dumps(fields), {"technique_id": tech} if tech else {}) for i, (s, host, user, kind, fields, tech) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id string, ts timestamp, source string, event_type string, host string, user string, fields string, labels map<string,string>")
    return labelled(df.withColumn("fields", F.parse_json("fields").cast("map<string,variant>")))


CASES = [
    ({"process.name": "PowerShell.EXE"}, {"process.name": "powershell.exe"}, True),
    ({"name": "powershell.exe"}, {"process.name": "powershell.exe"}, True),
    ({"process.command_line|contains": "-enc"}, {"process.command_line": "powershell -Enc AAA"}, True),
    ({"process.name|endswith": "shell.exe"}, {"process.name": "powershell.exe"}, True),
    ({"process.name|endswith": "shell.exe"}, {"process.name": "shell.exe.bak"}, False),
    ({"process.command_line|re": r"-w\s+hidden"}, {"process.command_line": "pwsh -W  Hidden"}, True),
    ({"file.modified_count|gte": 500}, {"file.modified_count": 500}, True),
    ({"file.modified_count|gte": 500}, {"file.modified_count": 499}, False),
    ({"file.modified_count|gte": 500}, {"file.modified_count": "many"}, False),
    ({"file.modified_count|gte": 500}, {"file.modified_count": "9000"}, True),
    ({"file.modified_count|gt": 1}, {"file.modified_count": "1d"}, False),
    ({"granted_access|in": ["0x1FFFFF", "0x1410"]}, {"process.granted_access": "0x1410"}, True),
    ({"granted_access|in": ["0x1FFFFF", "0x1410"]}, {"process.granted_access": "0x1000"}, False),
    ({"device.serial|exists": True}, {"device.serial": "x"}, True),
    ({"device.serial|exists": True}, {}, False),
    ({"device.serial|exists": "false"}, {}, True),
    ({"device.serial|exists": True}, {"device.serial": None}, True),
    ({"device.serial": ""}, {"device.serial": None}, True),
    ({"device.serial": ""}, {}, False),
    ({"name|endswith": ["cmd.exe", "wscript.exe"]}, {"process.name": "wscript.exe"}, True),
    ({"a": 1, "b": 2}, {"a": 1, "b": 2}, True),
    ({"a": 1, "b": 2}, {"a": 1}, False),
    ({"device.first_seen": True}, {"device.first_seen": True}, True),
    ({"device.first_seen": True}, {"device.first_seen": False}, False),
    ({"device.first_seen": "TRUE"}, {"device.first_seen": True}, True),
    ({"n": 1}, {"n": "1.0"}, True),
    ({"n": 18874368}, {"n": 18874368.0}, True),
    ({"user": "bob"}, {"x.user": "bob"}, True),
    ({"user": "alice"}, {"x.user": "bob"}, False),
    ({"user": "alice"}, {}, True),
    ({"name": "b"}, {"x.name": "a", "y.name": "b"}, True),
    ({"name": "a"}, {"x.name": "a", "y.name": "b"}, False),
]


def test_predicates_on_maps(spark):
    df = events(spark, [(0, "h", "alice", "t", fields, None) for _, fields, _ in CASES])
    got = [df.where(F.col("event_id") == f"e{i}").select(compiled(Rule("r", {"s": spec}, "s"), MapFields()).alias(f"c{i}")) for i, (spec, _, _) in enumerate(CASES)]
    out = got[0]
    for g in got[1:]:
        out = out.union(g)
    assert [r[0] for r in out.collect()] == [want for *_, want in CASES]


@pytest.mark.parametrize(("text", "want"), [
    ("a and b", True), ("a and c", False), ("c or b", True), ("a and not c", True), ("c and (a or b)", False), ("c and a or b", True), ("NOT c AND a", True), ("all of them", False), ("any of them", True), ("2 of them", True), ("3 of them", False), ("1 of a*", True), ("all of a", True),
])
def test_conditions(spark, text, want):
    df = spark.createDataFrame([(1, 1, 0)], "a int, b int, c int")
    rule = Rule("r", {n: {n: 1} for n in "abc"}, text)
    assert df.select(compiled(rule, FlatFields(df))).first()[0] is want


@pytest.mark.parametrize("text", ["missing", "(a", "a)", "", "a b", "__import__('os')", "1 of", "1 of z*", "a and", "not", "a; b"])
def test_broken_conditions(spark, text):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(RuleError):
        compiled(Rule("r", {"a": {"a": 1}}, text), FlatFields(df))


def test_unknown_modifier_is_an_error_even_without_the_field(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(RuleError, match="bogus"):
        compiled(Rule("r", {"s": {"absent": 1, "x|bogus": 1}}, "s"), FlatFields(df))


def test_detect_isolates_broken_rules_and_orders(spark):
    df = events(spark, [(10, "h", "u", "a", {"n": 5}, "T1059.001"), (0, "h", "u", "b", {"n": 1}, None), (20, "h", "u", "a", {"n": 9}, None)])
    rules = [Rule("low", {"s": {"n|gte": 1}}, "s", severity="low"), Rule("high", {"s": {"event_type": "a"}}, "s", severity="high", techniques=("T1059",)), Rule("bad", {"s": {"n|x": 1}}, "s"), Rule("off", {"s": {"n|gte": 0}}, "s", enabled=False)]
    found, errors = detect(df, rules, MapFields())
    rows = [(r["rule_id"], r["event"]["event_id"]) for r in ordered(found).collect()]
    assert rows == [("low", "e1"), ("high", "e0"), ("low", "e0"), ("high", "e2"), ("low", "e2")]
    assert [e[0] for e in errors] == ["bad"] and [e[0] for e in validate(rules, MapFields())] == ["bad"]
    truth = {(r["rule_id"], r["event"]["event_id"]): r["is_tp"] for r in with_truth(found).collect()}
    assert truth == {("low", "e1"): False, ("high", "e0"): True, ("low", "e0"): True, ("high", "e2"): False, ("low", "e2"): False}
    listing = {r["rule_id"]: r["status"] for r in rule_listing(rules_table(spark, rules), errors_table(spark, errors)).collect()}
    assert listing == {"low": "ok", "high": "ok", "bad": "invalid", "off": "disabled"}


def test_more_rules_than_one_array_holds(spark):
    df = events(spark, [(i, "h", "u", "a", {"n": i}, None) for i in range(3)])
    rules = [Rule(f"r{i:03}", {"s": {"n|gte": i % 3}}, "s") for i in range(450)]
    got = detect(df, rules, MapFields())[0]
    assert got.count() == 150 * (3 + 2 + 1) and got.where("rule_id = 'r449'").count() == 1


def test_no_rules_and_no_events(spark):
    df = events(spark, [(0, "h", "u", "a", {}, None)])
    assert detect(df, [], MapFields())[0].count() == 0
    assert detect(df.where("false"), packs.RULES, MapFields())[0].count() == 0


@pytest.mark.parametrize(("actual", "rule", "want"), [("T1059.001", ["T1059.001"], True), (None, ["T1059.001"], False), ("T1059.001", ["T1059"], True), ("T1003.001", ["T1486"], False), ("T1003.001", [], True), ("T1059.001", ["T1059.003"], True)])
def test_claims(spark, actual, rule, want):
    df = spark.createDataFrame([(actual, rule)], "a string, t array<string>")
    assert df.select(claims(F.col("t"), F.col("a"))).first()[0] is want


def test_bundled_pack_compiles_and_fires(spark):
    rows = [
        (0, "h", "u", "process_creation", {"process.name": "powershell.exe", "process.command_line": "powershell -nop -w hidden -enc AAAA"}, "T1059.001"),
        (1, "h", "u", "process_creation", {"process.name": "cmd.exe", "process.command_line": 'vss""admin del^ete  shadows /all'}, "T1490"),
        (2, "h", "u", "authentication", {"winlog.event_id": 4624, "winlog.logon_type": 10, "source.ip": "8.8.8.8"}, "T1133"),
        (3, "h", "u", "authentication", {"winlog.event_id": 4624, "winlog.logon_type": 10, "source.ip": "10.0.0.8"}, None),
        (4, "h", "u", "file_modification_burst", {"file.modified_count": 900, "file.entropy_avg": 7.9}, "T1486"),
        (6, "h", "u", "process_creation", {"process.name": "cmd.exe", "process.command_line": 'bcdedit /set {default} recovery^enabled n^o'}, "T1490"),
        (5, "h", "u", "file_share_access", {"file.share_name": r"\\x\ADMIN$"}, "T1021.002"),
    ]
    found, errors = detect(events(spark, rows), packs.RULES, MapFields())
    assert not errors
    assert sorted((r["rule_id"], r["event"]["event_id"]) for r in found.collect()) == [("SD-0001", "e0"), ("SD-0003", "e1"), ("SD-0003", "e5"), ("SD-0008", "e6"), ("SD-0009", "e4"), ("SD-0010", "e2")]
    assert not validate(packs.CORRELATIONS, MapFields())


def test_fingerprint_is_of_the_logic():
    a, b = Rule("a", {"s": {"x": 1}}, "s", "one"), Rule("b", {"s": {"x": 1}}, "s", "two")
    assert a.fingerprint == b.fingerprint != Rule("a", {"s": {"x": 2}}, "s").fingerprint


@pytest.mark.parametrize("bad", [
    Correlation("c", "other", 1), Correlation("c", "sequence", 0, stages=({"a": 1}, {"a": 2})), Correlation("c", "sequence", 5, stages=({"a": 1},)), Correlation("c", "threshold", 5, select={"a": 1}, threshold=1),
    Correlation("c", "threshold", 5, threshold=3), Correlation("c", "distinct", 5, select={"a": 1}, threshold=3),
])
def test_broken_correlations(bad):
    with pytest.raises(RuleError):
        bad.check()


def test_all_events_are_distinct_by_id(spark):
    df = spark.sql("SELECT named_struct('event_id', 'a') AS event, array(named_struct('event_id', 'b'), named_struct('event_id', 'a')) AS supporting")
    assert [e["event_id"] for e in df.select(all_events()).first()[0]] == ["a", "b"]


def _random_rules(n, names, rng):
    words = ["a", "alpha", "ALP", "beta.exe", "1", "01", "2.5", "", "true", "nan", "x", 1, 0, 2.5, True, False, None, -3]
    hows = ["", "", "", "|contains", "|startswith", "|endswith", "|gt", "|gte", "|lt", "|lte", "|in", "|exists", "|re"]
    conditions = ["p", "not p", "p and q", "p or not q", "all of them", "2 of them", "any of p*", "0 of them", "(p or q) and not r", "not (p and r) or q"]

    def spec():
        out = {}
        for _ in range(rng.randrange(1, 3)):
            how = rng.choice(hows)
            value = rng.choice(["al.ha", "^1", "e$", "[xy]"]) if how == "|re" else [rng.choice(words) for _ in range(rng.randrange(3))] if rng.random() < 0.3 else rng.choice(words)
            out[rng.choice(names) + how] = value
        return out

    made = [Rule(f"r{i}", {k: [spec(), spec()] if rng.random() < 0.2 else spec() for k in "pqr"}, rng.choice(conditions)) for i in range(n)]
    return [*made, Rule("bad", {"p": {"host|near": 1}}, "p"), Rule("empty", {}, "p"), Rule("off", {"p": {"host": "a"}}, "p", enabled=False), Rule("text", {"p": "x"}, "p")]


def test_index_equals_columns(spark):
    """Random rules over values of every kind: the index of terms and one Column each give the same alerts and errors."""
    import random

    from sparkdetect.operators.detect import detect_indexed

    rng = random.Random(8)
    values = ["a", "Alpha", "alpha beta.EXE", "1", "01", "1.0", "2.5", "", "TRUE", "false", "nan", "inf", "x", None, "-3", " 1 ", "1e0"]
    kinds = [rng.choice([v, v, 1, 0, 2.5, True, False, -3, None, 10**15]) for v in values for _ in range(4)]
    df = events(spark, [(i, rng.choice(values), rng.choice(values), rng.choice("ab"), {k: rng.choice(kinds) for k in ("p.name", "q.size", "flag") if rng.random() < 0.7}, None) for i in range(150)])
    flat = df.select("event_id", "ts", "host", "user", "event_type", F.expr("try_cast(host AS double)").alias("num"), (F.col("user") == "a").alias("yes"), F.expr("try_cast(host AS int)").alias("whole"))
    for table, fields, names in ((df, MapFields(), ["name", "p.name", "size", "flag", "host", "user", "gone"]), (flat, FlatFields(flat), ["num", "yes", "whole", "host", "user", "gone"])):
        rules = _random_rules(60, names, rng)
        both = [detect(table, rules, fields), detect_indexed(table, rules, fields)]
        assert sorted(both[0][1]) == sorted(both[1][1]) and len(both[0][1]) == 3
        got = [sorted(map(str, out.collect())) for out, _ in both]
        assert got[0] == got[1] and len(got[0]) > 300 and both[0][0].schema == both[1][0].schema


def test_many_rules_in_one_scan(spark):
    """Twenty times the rules take less than half of twenty times as long."""
    import time

    df = spark.range(20_000).select(F.col("id").cast("string").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("h"), F.col("id") % 500).alias("host"), (F.col("id") % 97).alias("size"), F.concat(F.lit("cmd "), F.col("id") % 5000, F.lit(" --run")).alias("line"))

    def took(n):
        rules = [Rule(f"r{i}", {"a": {"host": f"h{i % 600}"}, "b": {"line|contains": f" {i} --"}, "c": {"size|gte": i % 90}}, "(a or b) and c") for i in range(n)]
        began = time.perf_counter()
        out, _ = detect(df, rules, FlatFields(df))
        assert out.count() > n
        return time.perf_counter() - began

    took(500)
    few, many = took(500), took(10_000)
    assert many < 10 * few, (few, many)
