"""URL rules, and trust and distrust that flow over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: (host, path, verdict); a rule holds for its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: What a seed starts with; ranks are whole numbers, so every order of sums agrees. Up to 10**9 seeds fit a long.
ONE = 10**9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, w): links between different hosts, and a link each way between a host and its parent domain.

    ``pages`` has ``host`` and the raw page. Counted per (page host, linked host) before the shuffle, so a
    host with a third of all pages costs one row for each host that it links to and task.
    """
    links = pages.select("host", F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", _UPPER, _LOWER).alias("dst"))
    links = links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    hosts = pages.where("host <> ''").select("host").union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(0), F.size(labels) - 3),
        lambda i: F.struct(
            F.concat_ws(".", F.slice(labels, i + 1, F.size(labels))).alias("low"),
            F.concat_ws(".", F.slice(labels, i + 2, F.size(labels))).alias("high"),
        ),
    )
    family = hosts.where(F.size(labels) >= 3).select(F.explode(above).alias("x")).select("x.low", "x.high").distinct()
    ways = family.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(family.select("high", "low"))
    return links.union(ways.select("src", "dst", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = 8, keep: int = 85) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` of personalised PageRank.

    ``hosts`` has host, good and bad (is it a seed of either kind). Trust starts alike at all good hosts and
    follows links; distrust starts at the bad hosts and follows links backwards. Each round passes on
    ``keep`` hundredths, by link weight; the rest returns to the seeds, and what a host without links
    would pass on is dropped. No good or no bad seeds: that rank is 0. Shares are taken of decimals, so a host passes on
    something by each of its links however many seeds there are.
    """
    base = stored(hosts.select("host", *[F.when(F.col(c), F.lit(ONE)).otherwise(0).cast("long").alias(name) for c, name in (("good", "trust"), ("bad", "distrust"))]))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # sums before joins: a hub's edges never meet in one group
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("w").alias("of"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("w").alias("of"))
    forth = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "w").join(out, "host").select("host", "to", F.col("w").alias("f"), F.col("of").alias("fd"), zero.alias("r"), one.alias("rd"))
    back = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "w").join(into, "host").select("host", "to", zero.alias("f"), one.alias("fd"), F.col("w").alias("r"), F.col("of").alias("rd"))
    ways = stored(forth.union(back))
    rank = base
    reset = base.select("host", F.expr(f"trust * {100 - keep} div 100").alias("trust"), F.expr(f"distrust * {100 - keep} div 100").alias("distrust"))
    share = lambda rank, part, of: F.expr(f"CAST({rank} AS DECIMAL(19, 0)) * {keep} * {part} div (CAST({of} AS DECIMAL(19, 0)) * 100)").alias(rank)
    for i in range(rounds):
        passed = rank.join(ways, "host").select(F.col("to").alias("host"), share("trust", "f", "fd"), share("distrust", "r", "rd"))
        rank = reset.union(passed).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % 4 == 3 or i == rounds - 1:
            rank = stored(rank)
    return rank


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, share: int = 50, rounds: int = 8) -> DataFrame:
    """Add host, path, rule and verdict to ``pages`` (page_id, url, html).

    A rule's verdict stands. Hosts with pages that a rule allows are the good seeds, those with blocked
    pages the bad seeds (a host may be both). Other pages are blocked where distrust is above 0 and makes
    ``share`` hundredths or more of their host's trust and distrust, else allowed; so are pages without a
    host, which hold no rank. Null urls and pages, repeated rows and empty tables are fine.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.withColumn("host", host).withColumn("path", path)
    parts = parts.withColumn("_fit", by_rule(F.col("host"), F.col("path"), rules))
    edges = stored(host_edges(parts))
    seen = parts.where("host <> ''").groupBy("host").agg(
        F.coalesce(F.bool_or(F.col("_fit.verdict") == "allow"), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("_fit.verdict") == "block"), F.lit(False)).alias("bad")
    )
    no = F.lit(False)
    hosts = seen.union(edges.select("src", no, no)).union(edges.select("dst", no, no)).groupBy("host").agg(F.bool_or("good").alias("good"), F.bool_or("bad").alias("bad"))
    hosts = stored(hosts)
    seeds = hosts.agg(F.count_if("good"), F.count_if("bad")).first()
    good, bad = (max(1, n) for n in seeds)
    rank = propagate(hosts, edges, rounds=rounds)
    # each kind by its own number of seeds; decimals hold the products
    t, d = f"(CAST(trust AS DECIMAL(19, 0)) * {bad})", f"(CAST(distrust AS DECIMAL(19, 0)) * {good})"
    distrusted = rank.where(f"distrust > 0 AND {d} * 100 >= {share} * ({t} + {d})").select(F.col("host").alias("_host"), F.lit("block").alias("_ranked"))
    # only the few columns that are asked for meet the ranks; a host with many pages is split by adaptive execution
    verdict = F.coalesce("_fit.verdict", "_ranked", F.lit("allow"))
    return parts.drop("html").join(distrusted, F.col("host") == F.col("_host"), "left").select(*[c for c in pages.columns if c not in ("html", "host", "path", "rule", "verdict")], "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the rules, and by trust and distrust of their hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle(rounds: int = 8, keep: int = 85, share: int = 50) -> str:
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " + "'{}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    fits = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    link = _LINK.replace("'", "''")
    sql = f"""
WITH rest AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), parts AS (SELECT *, CASE {cases.format(*[h + p for h, p, _ in fits])} END AS rule, CASE {cases.format(*[v for *_, v in fits])} END AS ruled FROM split
), found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM parts
), links AS (SELECT src, dst, count(*) AS w FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL
), named AS (SELECT host FROM parts WHERE host <> '' UNION SELECT dst FROM links
), labels AS (SELECT string_split(host, '.') AS l FROM named
), family AS (SELECT DISTINCT array_to_string(l[i:], '.') AS low, array_to_string(l[i + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM labels)
), edges AS (SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT * FROM links UNION ALL SELECT low, high, 1 FROM family UNION ALL SELECT high, low, 1 FROM family) GROUP BY ALL
), weighed AS (SELECT src, dst, w, (sum(w) OVER (PARTITION BY src))::BIGINT AS ow, (sum(w) OVER (PARTITION BY dst))::BIGINT AS iw FROM edges
), hosts AS (SELECT host, bool_or(good) AS good, bool_or(bad) AS bad FROM (
    SELECT host, coalesce(ruled = 'allow', false) AS good, coalesce(ruled = 'block', false) AS bad FROM parts WHERE host <> ''
    UNION ALL SELECT src, false, false FROM edges UNION ALL SELECT dst, false, false FROM edges) GROUP BY host
), seeds AS (SELECT greatest(count_if(good), 1)::HUGEINT AS good, greatest(count_if(bad), 1)::HUGEINT AS bad FROM hosts
), r0 AS (SELECT host, (CASE WHEN good THEN {ONE} ELSE 0 END)::BIGINT AS t, (CASE WHEN bad THEN {ONE} ELSE 0 END)::BIGINT AS s FROM hosts
)"""
    for i in range(rounds):
        sql += f""", r{i + 1} AS MATERIALIZED (SELECT host, sum(t)::BIGINT AS t, sum(s)::BIGINT AS s FROM (
    SELECT host, t * {100 - keep} // 100 AS t, s * {100 - keep} // 100 AS s FROM r0
    UNION ALL SELECT dst, t::HUGEINT * {keep} * w // (ow::HUGEINT * 100), 0 FROM r{i} JOIN weighed ON host = src
    UNION ALL SELECT src, 0, s::HUGEINT * {keep} * w // (iw::HUGEINT * 100) FROM r{i} JOIN weighed ON host = dst) GROUP BY host)"""
    return sql + f"""
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN s > 0 AND s::HUGEINT * good * 100 >= {share} * (t::HUGEINT * bad + s::HUGEINT * good) THEN 'block' END, 'allow') AS verdict
FROM parts p LEFT JOIN r{rounds} r ON p.host = r.host CROSS JOIN (SELECT good, bad FROM seeds)"""
