"""Coverage, figures, controls, statistics, triage, drafts and robustness: known cases."""

import pytest
from pyspark.sql import functions as F

from sparkdetect.functions.fields import FlatFields, MapFields
from sparkdetect.operators import controls, drafting, robustness, scorecard, stats, triage
from sparkdetect.operators.detect import detect, with_truth
from sparkdetect.operators.rules import Rule
from test_rules import events


@pytest.mark.parametrize(("made", "fired", "tp", "want"), [(2, 2, 2, "full"), (3, 1, 1, "partial"), (2, 0, 0, "none"), (2, 5, 0, "none")])
def test_status(spark, made, fired, tp, want):
    df = spark.createDataFrame([(made, fired, tp)], "events_generated long, alerts_fired long, true_positives long")
    assert scorecard.with_status(df).first()["status"] == want


def test_summary_of_a_small_run(spark):
    df = events(spark, [(0, "h", "u", "a", {}, "T1059.001"), (1, "h", "u", "a", {}, None), (2, "h", "u", "b", {}, "T1486"), (3, "h", "u", "c", {}, None)])
    df = df.withColumns({"run_id": F.lit("r"), "scenario_id": F.lit("s")})
    found = with_truth(detect(df, [Rule("r1", {"s": {"event_type": "a"}}, "s", techniques=("T1059",))], MapFields())[0])
    ran = spark.createDataFrame([("r", "s", 0, "T1059.001", "n", "execution"), ("r", "s", 1, "T1486", "m", "impact")], "run_id string, scenario_id string, ord int, technique_id string, name string, tactic string")
    cover = scorecard.merged(scorecard.coverage(df, found, ran))
    row = scorecard.summary(df, found, cover).first()
    assert (row["total_alerts"], row["true_positives"], row["false_positives"]) == (2, 1, 1)
    assert (row["technique_recall"], row["precision"], row["event_recall"], row["alerts_per_tp"]) == (0.5, 0.5, 0.5, 2.0)
    assert row["grade"] == "D" and [r["technique_id"] for r in scorecard.gaps(cover).collect()] == ["T1486"]
    nothing = scorecard.summary(df, found.where("false"), cover.withColumn("detected", F.lit(False))).first()
    assert (nothing["precision"], nothing["technique_recall"], nothing["f1"], nothing["grade"]) == (0.0, 0.0, 0.0, "F")


def test_executed_keeps_first_steps(spark):
    steps = spark.createDataFrame([("r", "s", 0, "T1", "a", "x"), ("r", "s", 1, "T2", "b", "y"), ("r", "s", 2, "T1", "a", "x")], "run_id string, scenario_id string, ord int, technique_id string, name string, tactic string")
    assert [(r["ord"], r["technique_id"]) for r in scorecard.executed_techniques(steps).orderBy("ord").collect()] == [(0, "T1"), (1, "T2")]


@pytest.mark.parametrize(("techniques", "ran", "hit", "want"), [
    (["T1490"], ["T1490"], ["T1490"], "effective"), (["T1490"], ["T1490"], [], "ineffective"), (["T1052.001"], ["T1490"], [], "not_assessed"), (["T1490", "T1486"], ["T1490", "T1486"], ["T1490"], "partially_effective"),
])
def test_controls(spark, techniques, ran, hit, want):
    cover = spark.createDataFrame([(t, t in hit) for t in ran], "technique_id string, detected boolean")
    out = controls.assessed(controls.controls_table(spark, [("F", "C", "t", techniques)]), cover)
    assert out.first()["status"] == want
    roll = controls.rollup(out).first()
    assert roll["coverage"] == {"effective": 1.0, "ineffective": 0.0, "not_assessed": 0.0, "partially_effective": 0.5}[want]


def test_controls_need_techniques(spark):
    with pytest.raises(ValueError):
        controls.controls_table(spark, [("F", "C", "t", [])])


def metrics(spark, values, name="m"):
    return spark.createDataFrame([(f"{i:03}", name, float(v)) for i, v in enumerate(values)], "run_id string, metric string, value double")


def test_bootstrap_and_compare(spark):
    row = stats.bootstrap(metrics(spark, [0.5] * 10), iterations=50).first()
    assert (row["low"], row["high"]) == (0.5, 0.5)
    row = stats.bootstrap(metrics(spark, [0.42]), iterations=50).first()
    assert (row["low"], row["high"]) == (0.42, 0.42)
    row = stats.bootstrap(metrics(spark, [0.98, 0.99, 1, 1, 1]), iterations=200).first()
    assert 0 <= row["low"] <= row["high"] <= 1
    up = stats.compare(metrics(spark, [0.3, 0.31, 0.29, 0.3, 0.32, 0.28]), metrics(spark, [0.7, 0.71, 0.69, 0.7, 0.72, 0.68]), iterations=200).first()
    assert up["significant"] and up["interpretation"] == "improvement"
    assert stats.compare(metrics(spark, [0.8] * 6), metrics(spark, [0.2] * 6), iterations=50).first()["interpretation"] == "regression"
    with pytest.raises(ValueError):
        stats.bootstrap(metrics(spark, [1]), confidence=1.5)


@pytest.mark.parametrize(("values", "want"), [([0.5, 0.501, 0.499], "stable"), ([0.1, 0.9, 0.5, 0.3], "volatile"), ([0.42], "stable"), ([0, 0], "stable")])
def test_stability(spark, values, want):
    assert stats.distribution(metrics(spark, values)).first()["stability"] == want


def test_grade_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([("1", "F"), ("2", "D"), ("3", "D"), ("4", "F")], "run_id string, grade string")
    assert {r["grade"]: r["modal"] for r in stats.grade_distribution(df).collect()} == {"F": True, "D": False}


def test_triage_bands_and_discounts(spark):
    base = dict(run_id="r", severity="high", severity_rank=3, rule_id="x", correlated=0, host_tactics=0, user_name="bob", source_ip_scope="unknown", tactic="", command_line="", parent_name="", integrity_level="", alert_id="a")
    rows = [base, base | {"command_line": "mimikatz", "parent_name": "WINWORD.exe"}, base | {"severity": "low", "parent_name": "veeamagent.exe", "user_name": "svc_x", "correlated": 9}, base | {"user_name": "svc_x", "correlated": 3}, base | {"tactic": "impact", "correlated": 5, "host_tactics": 3, "integrity_level": "System"}]
    out = triage.scored(spark.createDataFrame(rows)).select("risk_score", "verdict", "reasoning").collect()
    assert [r["risk_score"] for r in out] == [60, 100, 0, 70, 100]
    assert [r["verdict"] for r in out] == ["suspicious", "likely_true_positive", "likely_benign", "suspicious", "likely_true_positive"]
    assert out[0]["reasoning"] == ["rule severity is high"] and "known service account with no corroborating activity" in out[2]["reasoning"] and len(out[3]["reasoning"]) == 2


def test_drafts_from_samples(spark):
    df = events(spark, [(0, "h", "u", "http_upload", {"network.bytes_out": 1000, "destination.domain": "files.cloudstore.example"}, "T1041"), (1, "h", "u", "http_upload", {"network.bytes_out": 5}, None), (2, "h", "u", "x", {"device.first_seen": True, "file.size": 1}, "T1052.001")])
    missed = spark.createDataFrame([("T1041",), ("T1052.001",), ("T9999",)], "technique_id string")
    rules = drafting.drafts(df, missed, MapFields())
    assert [r.detection["selection"] for r in rules] == [{"event_type": "http_upload", "network.bytes_out|gte": 600, "destination.domain|contains": "files.cloudstore.example"}, {"event_type": "x", "file.size|gte": 1, "device.first_seen": True}]
    assert not any(r.enabled for r in rules)
    out = {r["rule_id"]: r["reason"] for r in drafting.validated(df, [*rules, Rule("wide", {"s": {"event_type": "http_upload"}}, "s", techniques=("T1041",))], MapFields()).collect()}
    assert out == {"DRAFT-T1041": "accepted", "DRAFT-T1052-001": "accepted", "wide": "matches 1 of 1 benign events"}


def test_correlations_are_held_fixed_when_drafts_are_scored(spark):
    df = events(spark, [(0, "h", "u", "a", {}, "T1041"), (1, "h", "u", "b", {}, "T1490"), (2, "h", "u", "c", {}, "T1486")])
    ran = spark.createDataFrame([("", "", i, t, t, "x") for i, t in enumerate(("T1041", "T1490", "T1486"))], "run_id string, scenario_id string, ord int, technique_id string, name string, tactic string")
    rule, draft, chain = (Rule(n, {"s": {"event_type": k}}, "s", techniques=(t,)) for n, k, t in (("R", "a", "T1041"), ("D", "b", "T1490"), ("C", "c", "T1486")))
    fixed = with_truth(detect(df, [chain], MapFields())[0])
    out = drafting.rescored(df, ran, [rule], [draft], MapFields(), fixed).select("variant", "technique_id", F.array_join("detecting_rules", ",").alias("by")).collect()
    assert {(r["variant"], r["technique_id"]): r["by"] for r in out} == {(v, t): {"T1041": "R", "T1486": "C", "T1490": "D" if v == "candidate" else ""}[t] for v in ("baseline", "candidate") for t in ("T1041", "T1490", "T1486")}


@pytest.mark.parametrize(("text", "want"), [("a bb ccccc dddddd", "dddddd"), ("abc", None), ("abcd", "abcd"), (r'C:\Users\"longest(name)"', 'longest(name'), ("equal firsts other", "equal") if False else ("alpha gamma", "alpha")])
def test_distinctive(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(drafting.distinctive(F.col("t"))).first()[0] == want


def test_rewrites_can_be_undone(spark):
    texts = ["powershell -EncodedCommand AAA  BBB", "", "one", "two words", r"C:\Windows\System32\cmd.exe /c C:\Windows\x", "PSEXEC64.exe -x", "ÄÖ straße lang"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", *[f(F.col("t"), F.lit(f"k{n}")).alias(n) for n, f in robustness.MUTATIONS.items()]).collect()
    for r in out:
        spaced = " ".join(r["t"].split())
        assert r["case_flip"].lower() == r["t"].lower() or "ß" in r["t"]
        assert r["quote_insertion"].replace('""', "") in (spaced, r["t"]) and r["caret_escape"].replace("^", "") in (spaced, r["t"])
        assert " ".join(r["whitespace_padding"].split()) == spaced
    by = {r["t"]: r for r in out}
    assert by[texts[0]]["flag_abbreviation"] == "powershell -ec AAA  BBB"
    assert by[texts[4]]["path_padding"] == r"C:\Windows\System32\..\System32\cmd.exe /c C:\Windows\x"
    assert by[texts[5]]["binary_rename"] == "remote_admin.exe -x"


def test_rewrites_inside_maps(spark):
    df = events(spark, [(0, "h", "u", "t", {"process.command_line": "vssadmin delete shadows", "n": 3}, "T1490"), (1, "h", "u", "t", {"process.command_line": 5}, "T1490")])
    rules = [Rule("loose", {"s": {"process.command_line|contains": "shadows"}}, "s"), Rule("exact", {"s": {"process.command_line": "vssadmin delete shadows", "n": 3}}, "s")]
    got = robustness.evaluate(df, rules, ("process.command_line", "process.name"), MapFields(), within="fields")
    out = {(r["rule_id"], r["mutation"]): r["detected_mutated"] for r in got.collect()}
    assert out["exact", "case_flip"] and not out["exact", "whitespace_padding"] and not out["exact", "caret_escape"] and out["loose", "binary_rename"] and len(out) == 14


def test_unknown_rewrite(spark):
    df = spark.createDataFrame([("1", "x", "T1")], "event_id string, text string, technique_id string")
    with pytest.raises(ValueError):
        robustness.evaluate(df, [Rule("r", {"s": {"text": "x"}}, "s")], ("text",), FlatFields(df), ["nothing"])
    out = robustness.evaluate(df, [Rule("r", {"s": {"text|contains": "x"}}, "s")], ("text",), FlatFields(df))
    assert out.count() == len(robustness.MUTATIONS) and robustness.score(out).first()["score"] == 1.0
