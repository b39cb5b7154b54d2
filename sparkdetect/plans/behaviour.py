"""Queries on drafts, robustness, baselines, incidents and exposure, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import FlatFields
from ..operators import baseline, drafting, exposure, incidents, robustness
from ..operators.detect import detect, with_truth
from ..operators.drafting import Strategy
from ..operators.rules import Rule
from ..streaming.jobs import baseline_stream, settled
from .queries import SQL, query
from .telemetry import ALERTS, CATALOGUE, RULES, TELE, TRUTH, executed, telemetry, telemetry_stream

# -- drafts

_STRATEGIES = {t: Strategy("medium", ("k", "value")) for t, *_ in TRUTH} | {"T1041": Strategy("low", ("event_type",))}
_EXTRA = (
    Rule("X-WIDE", {"s": {"event_type": "error"}}, "s", techniques=("T1059.001",)), Rule("X-NONE", {"s": {"event_type": "absent"}}, "s", techniques=("T1486",)),
    Rule("X-CROSS", {"s": [{"event_type": "error", "k|lt": 30}, {"event_type": "purchase", "k|lt": 10}]}, "s", techniques=("T1003.001",)), Rule("X-TWIN", {"s": {"event_type": "absent"}}, "s", techniques=("T1486",)),
    Rule("X-GOOD", {"s": {"event_type": "signup", "k|gte": 95}}, "s", techniques=("T1486",)), Rule("X-SAME", {"s": {"event_type": "signup", "k|gte": 95}}, "s", techniques=("T1486",)), Rule("X-BAD", {"s": {"k": 1}}, "s and", techniques=("T1041",)),
)


def _draft_fields(t: DataFrame) -> FlatFields:
    return FlatFields(t.drop("host", "user"))


_SAMPLES = f"""{TELE}, first AS (SELECT technique_id, arg_min({{'e': event_type, 'k': k, 'v': value}}, {{'t': ts, 'i': event_id}}) AS s FROM tele WHERE technique_id IS NOT NULL GROUP BY technique_id
), own AS (SELECT technique_id, 'DRAFT-' || replace(technique_id, '.', '-') AS rule_id, s.e AS e, CASE WHEN technique_id <> 'T1041' THEN CASE WHEN trunc(s.k * 0.6) = 0 THEN 1 ELSE trunc(s.k * 0.6) END END AS min_k,
  CASE WHEN technique_id <> 'T1041' THEN CASE WHEN trunc(s.v * 0.6) = 0 THEN 1 ELSE trunc(s.v * 0.6) END END AS min_v, CASE WHEN technique_id = 'T1041' AND length(s.e) >= 5 THEN s.e END AS token FROM first)"""


@query(f"WITH {_SAMPLES} SELECT technique_id, rule_id, e AS event_type, min_k::BIGINT AS min_k, min_v::BIGINT AS min_v, token FROM own")
def draft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    rules = drafting.drafts(t, executed(spark, sf_dir), _draft_fields(t), _STRATEGIES)
    rows = [(r.techniques[0], r.rule_id, s["event_type"], s.get("k|gte"), s.get("value|gte"), s.get("event_type|contains")) for r in rules for s in [r.detection["selection"]]]
    return spark.createDataFrame(rows, "technique_id string, rule_id string, event_type string, min_k long, min_v long, token string")


@query(f"""WITH {_SAMPLES}, drafted AS (SELECT rule_id, o.technique_id, t.technique_id AS actual FROM own o JOIN tele t ON t.event_type = o.e AND (o.min_k IS NULL OR t.k >= o.min_k) AND (o.min_v IS NULL OR t.value >= o.min_v) AND (o.token IS NULL OR contains(t.event_type, o.token))
), fixed(rule_id, technique_id) AS (VALUES ('X-WIDE', 'T1059.001'), ('X-NONE', 'T1486'), ('X-CROSS', 'T1003.001'), ('X-TWIN', 'T1486'), ('X-GOOD', 'T1486'), ('X-SAME', 'T1486')
), matched AS (SELECT * FROM drafted UNION ALL SELECT f.rule_id, f.technique_id, t.technique_id FROM fixed f JOIN tele t ON (f.rule_id = 'X-WIDE' AND event_type = 'error') OR (f.rule_id = 'X-CROSS' AND (event_type = 'error' AND k < 30 OR event_type = 'purchase' AND k < 10))
  OR (f.rule_id IN ('X-GOOD', 'X-SAME') AND event_type = 'signup' AND k >= 95)
), ids AS (SELECT rule_id, technique_id FROM own UNION SELECT * FROM fixed
), n AS (SELECT i.rule_id, i.technique_id, count(*) FILTER (m.rule_id IS NOT NULL AND actual = i.technique_id) AS hits, count(*) FILTER (m.rule_id IS NOT NULL AND actual IS NULL) AS false_positives, count(*) FILTER (m.rule_id IS NOT NULL AND actual <> i.technique_id) AS "cross"
  FROM ids i LEFT JOIN matched m ON m.rule_id = i.rule_id GROUP BY ALL
), k AS (SELECT n.*, (SELECT count(*) FROM tele WHERE technique_id IS NULL) AS benign, (SELECT count(*) FROM tele t WHERE t.technique_id <> n.technique_id) AS other FROM n
), r AS (SELECT rule_id, hits, false_positives, "cross", CASE WHEN hits = 0 THEN 'no event of its own technique matched' WHEN false_positives / benign > 0.01 THEN format('matches {{}} of {{}} benign events', false_positives, benign)
  WHEN "cross" / other > 0.25 THEN format('matches {{}} events of other techniques', "cross") WHEN rule_id = 'X-SAME' THEN 'same logic as another rule' ELSE 'accepted' END AS reason FROM k)
SELECT *, reason = 'accepted' AS accepted FROM r UNION ALL SELECT 'X-BAD', 0, 0, 0, 'does not compile: condition ended unexpectedly', false""")
def draft_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    rules = [*drafting.drafts(t, executed(spark, sf_dir), _draft_fields(t), _STRATEGIES), *_EXTRA]
    return drafting.validated(t, rules, FlatFields(t)).select("rule_id", "hits", "false_positives", "cross", "reason", "accepted")


_ACCEPTED = (Rule("N-1", {"s": {"event_type": "click", "k": 50}}, "s", techniques=("T1041",)), Rule("N-2", {"s": {"event_type": "view", "k": 99, "value|gte": 150}}, "s", techniques=("T1490",)))


@query(f"""WITH {ALERTS}, split AS (SELECT *, CASE WHEN event_id::BIGINT % 2 = 0 THEN 'train' ELSE 'holdout' END AS split FROM tele
), base AS (SELECT DISTINCT CASE WHEN event_id::BIGINT % 2 = 0 THEN 'train' ELSE 'holdout' END AS split, technique_id FROM alerts WHERE is_tp
), new AS (SELECT * FROM base UNION SELECT split, technique_id FROM split WHERE (technique_id = 'T1041' AND event_type = 'click' AND k = 50) OR (technique_id = 'T1490' AND event_type = 'view' AND k = 99 AND value >= 150)
), t(technique_id) AS (VALUES {', '.join(f"('{t}')" for t, _ in CATALOGUE)}
), h AS (SELECT technique_id, (technique_id, 'train') IN (SELECT technique_id, split FROM base) AS train_before, (technique_id, 'train') IN (SELECT technique_id, split FROM new) AS train_after, (technique_id, 'holdout') IN (SELECT technique_id, split FROM base) AS holdout_before,
  (technique_id, 'holdout') IN (SELECT technique_id, split FROM new) AS holdout_after FROM t)
SELECT *, CASE WHEN NOT train_before AND train_after AND NOT holdout_before AND holdout_after THEN 'generalised' WHEN NOT train_before AND train_after THEN 'in_sample_only' WHEN NOT holdout_after THEN 'remaining_gap' ELSE 'unchanged' END AS outcome FROM h""")
def holdout_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one scan; the variants are filters on the alerts."""
    t = telemetry(spark, sf_dir).withColumn("run_id", F.when(F.col("event_id").cast("long") % 2 == 0, "train").otherwise("holdout"))
    ran = executed(spark, sf_dir).select(F.explode(F.array(F.lit("train"), F.lit("holdout"))).alias("run_id"), "scenario_id", "ord", "technique_id", "name", "tactic").distinct()
    return drafting.holdout(drafting.rescored(t, ran, RULES, _ACCEPTED, FlatFields(t)).withColumnRenamed("run_id", "split"))


# -- robustness

_URL_RULES = (
    Rule("U-EN", {"s": {"url|contains": "example.com/en/"}}, "s", "one folder"), Rule("U-TOP", {"s": {"url|endswith": "#top"}}, "s", "an anchor"),
    Rule("U-RE", {"s": {"url|re": "^https?://[a-z.]+/fr/"}}, "s", "a folder by pattern"), Rule("U-HTTP", {"s": {"url|startswith": "http://m."}, "t": {"url|contains": "page=2"}}, "s and not t", "a start"),
)
_URL_SQL = {
    "U-EN": "contains(lower(u), 'example.com/en/')", "U-TOP": "ends_with(lower(u), '#top')", "U-RE": "regexp_matches(lower(u), '^https?://[a-z.]+/fr/')", "U-HTTP": "starts_with(lower(u), 'http://m.') AND NOT contains(lower(u), 'page=2')",
}


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as events, all of them malicious: the url as command line, slashes followed by a space so that it has several words."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").cast("string").alias("event_id"), "url", F.concat(F.lit("powershell.exe C:\\Windows\\x -NoProfile "), "url").alias("text"), F.lit("T1566").alias("technique_id"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir).withColumn("url", F.concat("url", F.lit(" -NoProfile net.exe")))
    rules = [Rule(r.rule_id, {k: {f.replace("endswith", "contains"): v for f, v in s.items()} for k, s in r.detection.items()}, r.condition, r.title) for r in _URL_RULES]
    return robustness.evaluate(shown, rules, ("url",), FlatFields(shown))


def _draw_sql(what: str, n: str) -> str:
    return f"(('0x' || substr(md5(key || ':' || {what}), 1, 8))::BIGINT % ({n}))"


def _insert_sql(mark: str, above: int, first: int) -> str:
    at = _draw_sql(f"'{mark}:token'", "greatest(len(p), 1)")
    cut = f"(('0x' || substr(md5(key || ':{mark}:cut'), 1, 8))::BIGINT % greatest(length(w) - 1 - {first}, 1) + {first})"
    return f"array_to_string(list_transform(p, lambda w, i: CASE WHEN i - 1 = {at} AND length(w) > {above} THEN substr(w, 1, {cut}) || '{mark}' || substr(w, {cut} + 1) ELSE w END), ' ')"


def _pad_sql(k: int) -> str:
    return f"repeat(' ', ({_draw_sql(f"'pad:{k}'", '3')} + 2)::BIGINT)"


_FLAG_SQL = "url"
for _long, _short in robustness.FLAGS:
    _FLAG_SQL = f"replace({_FLAG_SQL}, '{_long}', '{_short}')"
_RENAME_SQL = "CASE " + " ".join(f"WHEN contains(lower(url), '{o.lower()}') THEN regexp_replace(url, '{o.replace('.', '[.]')}', '{n}', 'gi')" for o, n in robustness.RENAMES) + " ELSE url END"
_MUTATED = {
    "case_flip": f"array_to_string(list_transform(string_split(url, ''), lambda c, i: CASE WHEN ('0x' || substr(md5(key || ':case:' || (i - 1)), 1, 8))::BIGINT % 2 = 0 THEN upper(c) ELSE lower(c) END), '')",
    "quote_insertion": _insert_sql('""', 4, 2), "flag_abbreviation": _FLAG_SQL, "path_padding": "url", "caret_escape": _insert_sql("^", 3, 1), "binary_rename": _RENAME_SQL,
    "whitespace_padding": f"split_part(url, ' ', 1) || {_pad_sql(0)} || split_part(url, ' ', 2) || {_pad_sql(1)} || array_to_string(string_split(url, ' ')[3:], ' ')",
}
_ROBUST = (
    "base AS (SELECT page_id::VARCHAR AS event_id, url || ' -NoProfile net.exe' AS url FROM pages WHERE url IS NOT NULL), keyed AS ("
    + " UNION ALL ".join(f"SELECT event_id, url, '{m}' AS mutation, '0:' || event_id || ':url:{m}' AS key, list_filter(regexp_split_to_array(url, '\\s+'), lambda w: w <> '') AS p FROM base" for m in _MUTATED)
    + "), mutated AS (SELECT *, CASE mutation " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in _MUTATED.items()) + " END AS new FROM keyed), results AS ("
    + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, '{r.title}' AS rule_title, event_id, mutation, {_URL_SQL[r.rule_id].replace('ends_with', 'contains').replace('lower(u)', 'lower(new)')} AS again FROM mutated WHERE {_URL_SQL[r.rule_id].replace('ends_with', 'contains').replace('lower(u)', 'lower(url)')}" for r in _URL_RULES)
    + ")"
)


@query(f"""WITH {_ROBUST}, r AS (SELECT rule_id, rule_title, count(*) FILTER (mutation <> 'binary_rename') AS tested, count(*) FILTER (mutation <> 'binary_rename' AND NOT again) AS evaded, array_to_string(list_sort(coalesce(list(DISTINCT mutation) FILTER (mutation <> 'binary_rename' AND NOT again), [])), ',') AS defeated_by,
  count(*) FILTER (mutation = 'binary_rename' AND NOT again) AS renames_evaded FROM results GROUP BY ALL) SELECT *, round(1 - evaded / tested, 6) AS survival, evaded > 0 AS fragile FROM r""")
def robustness_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.by_rule(_results(spark, sf_dir)).withColumns({"survival": F.round("survival", 6), "defeated_by": F.array_join("defeated_by", ",")})


@query(f"WITH {_ROBUST} SELECT mutation, count(*) AS tested, count(*) FILTER (NOT again) AS evaded, count(DISTINCT rule_id) FILTER (NOT again) AS rules_defeated FROM results GROUP BY mutation")
def mutation_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.by_mutation(_results(spark, sf_dir))


@query(f"WITH {_ROBUST} SELECT count(*) AS cases, count(*) FILTER (NOT again) AS evasions, round(1 - count(*) FILTER (NOT again) / count(*), 6) AS score FROM results WHERE mutation <> 'binary_rename'")
def robustness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.score(_results(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""SELECT page_id, regexp_replace(t, '([A-Za-z]:\\\\)(Windows\\\\)', '\\1Windows\\\\System32\\\\..\\\\') AS padded FROM (SELECT page_id, 'powershell.exe C:\\Windows\\x c:\\Windows\\y ' || url AS t FROM pages)""")
def path_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.concat(F.lit("powershell.exe C:\\Windows\\x c:\\Windows\\y "), "url")
    return pages.select("page_id", robustness.path_padding(text, F.lit("")).alias("padded"))


# -- baselines


def _features(t: DataFrame) -> DataFrame:
    return baseline.features_of_columns(t, {"k": F.col("k"), "value": F.when(F.col("k") != 7, F.col("value"))}, {"event_type": F.col("event_type")}, F.concat(F.lit("user:"), "user"))


_FEATURES = f"""{TELE}, wide AS (SELECT *, 'user:' || usr AS entity, CASE WHEN k <> 7 THEN value END AS v FROM tele
), feat AS (SELECT run_id, technique_id, event_id, ts, entity, f.n AS feature, f.x AS value FROM (SELECT *, unnest([{{'n': 'time.hour', 'x': hour(ts) + minute(ts) / 60.0}}, {{'n': 'event.field_count', 'x': 2 + (v IS NOT NULL)::INT}}, {{'n': 'k', 'x': k}}, {{'n': 'value', 'x': v}}, {{'n': 'event_type.length', 'x': length(event_type)}}]) AS f FROM wide) WHERE f.x IS NOT NULL)"""


def _fit_sql(source: str, name: str) -> str:
    return f"""{name}_last AS (SELECT *, row_number() OVER (PARTITION BY entity, feature ORDER BY ts DESC, event_id DESC) AS n FROM {source}
), {name}_mid AS (SELECT entity, feature, median(value) AS median, list(value) AS recent FROM {name}_last WHERE n <= 101 GROUP BY ALL
), {name}_ent AS (SELECT entity, count(DISTINCT event_id) AS entity_events FROM {source} GROUP BY entity
), {name} AS (SELECT entity, feature, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stddev, any_value(median) AS median, any_value(list_median(list_transform(recent, lambda x: abs(x - median)))) AS mad, any_value(entity_events) AS entity_events
  FROM {source} JOIN {name}_mid USING (entity, feature) JOIN {name}_ent USING (entity) GROUP BY entity, feature)"""


# a little is added before rounding, since means of cents fall on ties
_ROUNDED = "round(mean + 1e-9, 6) AS mean, round(stddev, 6) AS stddev, round(median, 6) AS median, round(mad, 6) AS mad"


@query(f"WITH {_FEATURES}, {_fit_sql('feat', 'model')} SELECT entity, feature, n, {_ROUNDED}, entity_events FROM model".replace("list_median(", "list_aggregate(").replace("abs(x - median)))", "abs(x - median)), 'median')"))
def baseline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.fit(_features(telemetry(spark, sf_dir))).drop("recent").withColumns({"mean": F.round(F.col("mean") + 1e-9, 6)} | {c: F.round(c, 6) for c in ("stddev", "median", "mad")})


_SPLIT = f"""{_FEATURES}, marked AS (SELECT event_id, CASE WHEN technique_id IS NULL AND row_number() OVER (PARTITION BY usr, technique_id IS NULL ORDER BY ts, event_id) <= greatest(5, floor(count(*) OVER (PARTITION BY usr, technique_id IS NULL) * 0.7)) THEN 'calibrate' ELSE 'evaluate' END AS split FROM tele
), cal AS (SELECT f.* FROM feat f JOIN marked USING (event_id) WHERE split = 'calibrate'), ev AS (SELECT f.* FROM feat f JOIN marked USING (event_id) WHERE split = 'evaluate'), {_fit_sql('cal', 'model')}
, judged AS (SELECT e.*, m.n, m.mean, m.stddev, m.median, m.mad, x.entity_events, row_number() OVER (PARTITION BY e.entity, e.feature ORDER BY ts, event_id) AS nth FROM ev e LEFT JOIN model m USING (entity, feature) LEFT JOIN model_ent x ON x.entity = e.entity
), scored AS (SELECT *, CASE WHEN n IS NULL THEN 'feature_novelty' WHEN n < 5 THEN 'insufficient_samples' WHEN mad * 1.4826 > 1e-12 THEN 'median_mad' WHEN stddev > 1e-12 THEN 'welford_zscore' ELSE 'zero_variance' END AS method FROM judged WHERE n IS NOT NULL OR (nth = 1 AND entity_events >= 5)
), found AS (SELECT *, CASE method WHEN 'feature_novelty' THEN 'inf'::DOUBLE WHEN 'insufficient_samples' THEN 0 WHEN 'median_mad' THEN abs(value - median) / (mad * 1.4826) WHEN 'welford_zscore' THEN abs(value - mean) / stddev ELSE CASE WHEN abs(value - mean) <= 1e-12 THEN 0 ELSE 'inf'::DOUBLE END END AS score FROM scored)""".replace("list_median(", "list_aggregate(").replace("abs(x - median)))", "abs(x - median)), 'median')")


def _split_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = baseline.calibration_split(telemetry(spark, sf_dir))
    model = baseline.fit(_features(t.where("split = 'calibrate'")))
    rest = t.where("split = 'evaluate'")
    return baseline.score(_features(rest), model, 5, 4.5), rest


@query(f"WITH {_SPLIT} SELECT event_id, entity, feature, round(value, 6) AS value, CASE WHEN isinf(score) THEN -1 ELSE round(score, 5) END AS score, method, coalesce(n, entity_events) AS sample_count FROM found WHERE score >= 4.5")
def baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _split_findings(spark, sf_dir)[0]
    return out.select("event_id", "entity", "feature", F.round("value", 6).alias("value"), F.when(F.col("score") == float("inf"), -1.0).otherwise(F.round("score", 5)).alias("score"), "method", "sample_count")


@query(f"""WITH {_SPLIT}, t AS (SELECT m.event_id, technique_id IS NOT NULL AS bad, m.event_id IN (SELECT event_id FROM found WHERE score >= 4.5) AS hit FROM marked m JOIN tele USING (event_id) WHERE split = 'evaluate'
), c AS (SELECT count(*) AS evaluation_events, count(*) FILTER (bad) AS malicious_events, count(*) FILTER (hit) AS anomalous_events, count(*) FILTER (hit AND bad) AS true_positive_events, count(*) FILTER (hit AND NOT bad) AS false_positive_events FROM t)
SELECT *, round(coalesce(true_positive_events / nullif(anomalous_events, 0), 0), 6) AS precision, round(coalesce(true_positive_events / nullif(malicious_events, 0), 0), 6) AS event_recall FROM c""")
def baseline_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rest = _split_findings(spark, sf_dir)
    return baseline.evaluate(found, rest).withColumns({c: F.round(c, 6) for c in ("precision", "event_recall")})


@query(f"""WITH {_FEATURES}, seen AS (SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - 1 AS before FROM (SELECT DISTINCT entity, event_id, ts FROM feat)
), w AS (SELECT *, count(*) OVER p AS n, avg(value) OVER p AS mean, coalesce(stddev_samp(value) OVER p, 0) AS stddev, list(value) OVER (PARTITION BY entity, feature ORDER BY ts, event_id ROWS BETWEEN 101 PRECEDING AND 1 PRECEDING) AS recent FROM feat WINDOW p AS (PARTITION BY entity, feature ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (SELECT *, list_aggregate(recent, 'median') AS median FROM w JOIN seen USING (entity, event_id)
), d AS (SELECT *, list_aggregate(list_transform(recent, lambda x: abs(x - median)), 'median') AS mad FROM m
), s AS (SELECT *, CASE WHEN n = 0 AND before >= 5 THEN 'feature_novelty' WHEN n < 5 THEN 'insufficient_samples' WHEN mad * 1.4826 > 1e-12 THEN 'median_mad' WHEN stddev > 1e-12 THEN 'welford_zscore' ELSE 'zero_variance' END AS method FROM d
), f AS (SELECT *, CASE method WHEN 'feature_novelty' THEN 'inf'::DOUBLE WHEN 'insufficient_samples' THEN 0 WHEN 'median_mad' THEN abs(value - median) / (mad * 1.4826) WHEN 'welford_zscore' THEN abs(value - mean) / stddev ELSE CASE WHEN abs(value - mean) <= 1e-12 THEN 0 ELSE 'inf'::DOUBLE END END AS score FROM s)
SELECT event_id, feature, method, CASE WHEN isinf(score) THEN -1 ELSE round(score, 5) END AS score, CASE WHEN method = 'feature_novelty' THEN before ELSE n END AS sample_count FROM f WHERE score >= 6.0003""")
def baseline_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = baseline.observe(_features(telemetry(spark, sf_dir)), 5, 6.0003)
    return out.select("event_id", "feature", "method", F.when(F.col("score") == float("inf"), -1.0).otherwise(F.round("score", 5)).alias("score"), "sample_count")


@query(SQL["baseline_observe"])
def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same findings from a stream, by state of each entity."""
    out = settled(baseline_stream(_features(telemetry_stream(spark, sf_dir)), 5, 6.0003))
    return out.select("event_id", "feature", "method", F.when(F.col("score") == float("inf"), -1.0).otherwise(F.round("score", 5)).alias("score"), "sample_count")


# -- incidents


def _incident_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with a user and a destination, all runs as one."""
    t = telemetry(spark, sf_dir).withColumns({"run_id": F.lit("all"), "scenario_id": F.lit("all"), "host": F.lit(None).cast("string"), "destination": F.when(F.col("k") < 3, F.concat(F.lit("D"), F.col("k").cast("string"), F.lit("-"), "user"))})
    return with_truth(detect(t, RULES, FlatFields(t))[0])


_EDGES = f"""{ALERTS.replace("lpad((event_id % 20)::VARCHAR, 2, '0') AS run_id, 's' || (event_id % 3) AS scenario_id", "'all' AS run_id, 'all' AS scenario_id")}
, who AS (SELECT DISTINCT alert_id, ts, unnest(list_filter(['user:' || lower(usr), CASE WHEN k < 3 THEN 'destination:d' || k || '-' || usr END], lambda e: e IS NOT NULL)) AS entity FROM alerts
), lagged AS (SELECT alert_id AS dst, lag(alert_id) OVER w AS src, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM who WINDOW w AS (PARTITION BY entity ORDER BY ts, alert_id)
), edges AS (SELECT DISTINCT src, dst FROM lagged WHERE src IS NOT NULL AND gap <= 21600000000)"""


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.edges(incidents.entities(incidents.distinct_firings(_incident_alerts(spark, sf_dir))), 21600)


_PARTS = f"""{_EDGES}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), reach(node, label) AS (SELECT alert_id, alert_id FROM alerts UNION SELECT b.dst, r.label FROM reach r JOIN both_ b ON b.src = r.node
), member AS (SELECT a.*, m.label AS incident FROM alerts a JOIN (SELECT node, min(label) AS label FROM reach GROUP BY node) m ON a.alert_id = m.node
), risks AS (SELECT incident, rule_id, event_id, max(CASE severity WHEN 'info' THEN 10.0 WHEN 'low' THEN 25.0 WHEN 'medium' THEN 50.0 WHEN 'high' THEN 75.0 WHEN 'critical' THEN 95.0 END) AS risk FROM member GROUP BY ALL
), ids AS (SELECT incident, 'inc-' || substr(sha256(string_agg(alert_id, chr(0) ORDER BY alert_id)), 1, 16) AS incident_id, count(*) AS alerts, min(ts) AS started_at, max(ts) AS ended_at, count(DISTINCT rule_id) AS n_rules, count(DISTINCT event_id) AS n_events FROM member GROUP BY incident)"""
_TACTICS = f"""tactics(technique, tactic) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in incidents.TECHNIQUE_TACTICS.items())}
), prog AS (SELECT incident, coalesce(e.tactic, b.tactic) AS tactic, min(ts) AS first_seen, array_to_string(list_sort(list(DISTINCT m.t)), ',') AS techniques, count(DISTINCT alert_id) AS n FROM (SELECT *, unnest(techs) AS t FROM member) m LEFT JOIN tactics e ON e.technique = m.t LEFT JOIN tactics b ON b.technique = split_part(m.t, '.', 1)
  WHERE coalesce(e.tactic, b.tactic) IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_PARTS} SELECT incident_id, alerts, started_at, ended_at FROM ids")
def incident_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incidents.reconstruct(_incident_alerts(spark, sf_dir), 21600)
    return out.select("incident_id", "alerts", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"))


@query(f"""WITH RECURSIVE {_PARTS}, {_TACTICS}, ent AS (SELECT incident, count(DISTINCT entity) AS n_ent FROM who JOIN member USING (alert_id) GROUP BY incident
), k AS (SELECT incident, count(*) AS firings, 100 * (1 - exp(sum(ln(1 - risk / 100)))) AS risk FROM risks GROUP BY incident), st AS (SELECT incident, count(*) AS n_tac FROM prog GROUP BY incident)
SELECT incident_id, round(risk, 2) AS risk_score, round((0.15 + 0.25 * least(1, (n_rules - 1) / 3.0) + 0.2 * least(1, (n_ent - 1) / 4.0) + 0.2 * least(1, n_events / 5.0) + 0.2 * least(1, coalesce(n_tac, 0) / 4.0)) * firings / alerts, 3) AS confidence, n_ent::INT AS entities
FROM ids JOIN ent USING (incident) JOIN k USING (incident) LEFT JOIN st USING (incident)""")
def incident_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incidents.reconstruct(_incident_alerts(spark, sf_dir), 21600)
    return out.select("incident_id", "risk_score", "confidence", F.size("entities").alias("entities"))


@query(f"WITH RECURSIVE {_PARTS}, {_TACTICS} SELECT incident_id, tactic, techniques, first_seen, n::INT AS alerts FROM prog JOIN ids USING (incident)")
def tactic_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incidents.reconstruct(_incident_alerts(spark, sf_dir), 21600).select("incident_id", F.explode("tactic_progression").alias("s"))
    return out.select("incident_id", "s.tactic", F.array_join("s.techniques", ",").alias("techniques"), F.col("s.first_seen").cast("timestamp_ntz").alias("first_seen"), F.size("s.alert_ids").alias("alerts"))


@query(f"WITH RECURSIVE {_PARTS} SELECT incident_id, round(count(DISTINCT alert_id) FILTER (is_tp) / count(DISTINCT alert_id), 6) AS alert_purity, round(count(DISTINCT event_id) FILTER (technique_id IS NOT NULL) / count(DISTINCT event_id), 6) AS event_purity FROM member JOIN ids USING (incident) GROUP BY incident_id")
def incident_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _incident_alerts(spark, sf_dir)
    return incidents.truth(incidents.reconstruct(found, 21600), found).withColumns({c: F.round(c, 6) for c in ("alert_purity", "event_purity")})


@query(f"WITH RECURSIVE {_PARTS} SELECT sum(alerts)::BIGINT AS alerts, count(*) AS incidents, round(sum(alerts) / count(*), 6) AS ratio FROM ids")
def incident_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.compression(incidents.figures(incidents.members(_incident_alerts(spark, sf_dir), 21600))).withColumn("ratio", F.round("ratio", 6))


# -- exposure


def _assets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions are exposed, lead to their nations, and nations to the next of their region and to their suppliers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation, supplier = read("region"), read("nation"), read("supplier")
    no, none = F.lit(False), F.array().cast("array<string>")
    creds = lambda c: F.array(F.struct(F.lit("adm").alias("username"), F.lit("d").alias("domain"), c.alias("is_privileged")))
    names = ("hostname", "value", "defences", "credentials", "is_internet_facing")
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    hosts = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit(1), F.when(F.col("r_regionkey") == 1, F.array(F.lit("edr"))).otherwise(none), creds(no), F.col("r_regionkey") != 2).toDF(*names)
    hosts = hosts.union(nation.select(F.concat(F.lit("n"), n.cast("string")), F.lit(5), F.when(n % 3 == 0, F.array(F.lit("edr"), F.lit("sysmon"))).when(n % 7 == 1, F.array(F.lit("credential_guard"))).otherwise(none), creds(n % 2 == 0), no).toDF(*names))
    hosts = hosts.union(supplier.select(F.concat(F.lit("s"), s.cast("string")), F.lit(9), F.when(s % 5 == 0, F.array(F.lit("app_allowlist"))).otherwise(none), creds(no), no).toDF(*names))
    ends = ("source", "target", "port", "requires_privileged")
    host = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = nation.select(host("r", F.col("n_regionkey")), host("n", n), F.when(n % 2 == 0, 445).otherwise(3389), n % 5 == 4).toDF(*ends)
    after = nation.alias("a").join(nation.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"))
    edges = edges.union(after.select(host("n", F.col("a.n_nationkey")), host("n", F.col("b.n_nationkey")), F.lit(22), no).toDF(*ends))
    edges = edges.union(supplier.select(host("n", F.col("s_nationkey")), host("s", s), F.when(s % 3 == 0, 445).otherwise(80), s % 4 == 0).toDF(*ends))
    return hosts, edges


_PATHS = """hosts AS (SELECT 'r' || r_regionkey AS h, 1 AS v, CASE WHEN r_regionkey = 1 THEN 1.8 ELSE 1 END AS m, false AS priv, r_regionkey <> 2 AS face FROM region
  UNION ALL SELECT 'n' || n_nationkey, 5, CASE WHEN n_nationkey % 3 = 0 THEN 1.8 * 1.4 ELSE 1 END, n_nationkey % 2 = 0 AND (n_nationkey % 3 = 0 OR n_nationkey % 7 <> 1), false FROM nation
  UNION ALL SELECT 's' || s_suppkey, 9, CASE WHEN s_suppkey % 5 = 0 THEN 2.2 ELSE 1 END, false, false FROM supplier
), edges AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b, CASE WHEN n_nationkey % 2 = 0 THEN 445 ELSE 3389 END AS port, n_nationkey % 5 = 4 AS gated FROM nation
  UNION ALL SELECT 'n' || x.n_nationkey, 'n' || y.n_nationkey, 22, false FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 445 ELSE 80 END, s_suppkey % 4 = 0 FROM supplier
), steps AS (SELECT a, b, gated, false AS gains, CASE port WHEN 3389 THEN 1.3 WHEN 445 THEN 1.1 ELSE 1.0 END + CASE port WHEN 3389 THEN 0.45 WHEN 445 THEN 0.5 ELSE 0.3 END * m AS w FROM edges JOIN hosts ON h = b
  UNION ALL SELECT h, h, false, true, 2.0 + 0.8 * m FROM hosts WHERE priv
), walk(h, held, score, hops, hosts) AS (SELECT h, false, 3.0::DOUBLE + 0.55 * m, 1, [h] FROM hosts WHERE face
  UNION ALL SELECT b, held OR gains, score + w, hops + 1, list_append(hosts, b) FROM walk JOIN steps ON walk.h = steps.a WHERE (held OR NOT gated) AND NOT (held AND gains)
), best AS (SELECT h, arg_min({'score': score, 'hops': hops, 'hosts': hosts}, {'s': round(score, 9), 'n': hops, 'l': hosts}) AS b FROM walk GROUP BY h)"""


@query(f"WITH RECURSIVE {_PATHS} SELECT h AS host, round(b.score, 6) AS score, b.hops AS hops, array_to_string(list_filter(b.hosts, lambda x, i: i = 1 OR b.hosts[i - 1] <> x), '>') AS hosts FROM best")
def exposure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.paths(*_assets(spark, sf_dir)).select("host", F.round("score", 6).alias("score"), "hops", F.array_join("hosts", ">").alias("hosts"))


@query(f"WITH RECURSIVE {_PATHS} SELECT h AS host FROM hosts WHERE h NOT IN (SELECT h FROM best)")
def exposure_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts, edges = _assets(spark, sf_dir)
    return exposure.unreachable(hosts, exposure.paths(hosts, edges))
