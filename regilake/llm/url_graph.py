"""Operator 2: URL filter by rules, and by trust and distrust propagated over the host graph.

Pages get the verdict of the longest rule that fits their host and path.
For the others the method decides by host: hosts with allowed pages are
trusted seeds, hosts with blocked pages distrusted ones (by their share of
such pages). Trust flows along links (personalised PageRank from the
trusted seeds); distrust flows against them, to hosts that link to
distrusted ones. A host whose distrust exceeds ``MARGIN`` times its trust is
blocked, any other allowed, also one that neither reaches.

All steps are joins and aggregates on hosts: edges are distinct pairs of
hosts, sums are pre-aggregated before the shuffle, the state of a round is
written to the shared folder, and rounds end when no host is reached for the
first time and no score moves by more than ``TOLERANCE``; a walk that hasn't
settled after ``MOST_ROUNDS`` rounds is an error.

Edge cases: a null url or one without ``://`` has empty host and path, fits
no rule and, as no link leads to it, gets the verdict of a host without any
evidence; null html has no links; equal urls get equal verdicts, one row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, needed, table

#: (rule, verdict); a rule is a host, with all its subdomains, and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, ROUNDS, TOLERANCE, MARGIN = 0.85, 20, 1e-9, 1.0
#: ROUNDS are those of the twin only. Scores settle within 130 rounds, but on long chains of links hosts are reached for longer.
MOST_ROUNDS = 10_000
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, begin = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{begin}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ruled_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)) \
               .select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target) host pairs of the pages' absolute links; links within a host don't count."""
    links = pages.where(F.instr("html", "//") > 0).select(
        host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target"))
    links = links.select("source", F.translate("target", UPPER, LOWER).alias("target"))
    return links.where((F.col("source") != "") & (F.col("source") != F.col("target"))).distinct()


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, kind, score) from ``seeds`` (host, kind, score) over ``edges`` (kind, source, target).

    Each kind walks its own edges, its mass split evenly over a host's edges;
    at every step a part ``1 - DAMPING`` begins anew at the seeds.
    """
    degree = edges.groupBy("kind", "source").agg(F.count("*").alias("degree"))
    weighted = materialize(edges.join(degree, ["kind", "source"])
                           .select("kind", F.col("source").alias("host"), "target", (DAMPING / F.col("degree")).alias("part")),
                           "host-edges")
    base = materialize(seeds.select("host", "kind", ((1 - DAMPING) * F.col("score")).alias("score")), "host-seeds")
    if weighted.isEmpty():
        return base
    state = base
    for _ in range(MOST_ROUNDS):
        moved = state.join(weighted, ["kind", "host"]).select(F.col("target").alias("host"), "kind", (F.col("score") * F.col("part")).alias("score"))
        after = materialize(base.unionByName(moved).groupBy("host", "kind").agg(F.sum("score").alias("score")), "host-scores")
        change, new = after.alias("a").join(state.alias("b"), ["host", "kind"], "left").agg(
            F.max(F.abs(F.col("a.score") - F.coalesce(F.col("b.score"), F.lit(0.0)))), F.count_if(F.col("b.score").isNull())).first()
        state = after
        if change is None or (change <= TOLERANCE and not new):
            return state
    raise RuntimeError("trust did not settle")


def host_verdicts(ruled: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust, host_verdict) of every host with either score."""
    hosts = ruled.where(F.col("host") != "").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    seeds = hosts.select("host", F.inline(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("pages")).alias("score")),
                                                  F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("pages")).alias("score"))))) \
                 .where("score > 0")
    walks = edges.select(F.lit("trust").alias("kind"), "source", "target").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target")))
    scores = propagate(seeds, walks).groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"))
    return scores.withColumn("host_verdict", F.when(F.col("distrust") > MARGIN * F.col("trust"), "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; verdict is ``allow`` or ``block``."""
    pages = needed(pages, "page_id", "url", "html")
    ruled = ruled_pages(pages, rules)
    hosts = host_verdicts(ruled, host_edges(pages)).select("host", "host_verdict")
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"))


def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


# The pages' links stay within their hosts in part of the given tables; the twin walks the edges there are, all ROUNDS rounds.
_STEP = """
r{n} AS (SELECT host, kind, sum(score) AS score FROM (
    SELECT * FROM r0 UNION ALL
    SELECT w.target, w.kind, 0.85 / w.degree * r.score FROM r{m} r JOIN walks w ON w.kind = r.kind AND w.source = r.host) GROUP BY ALL)"""

ORACLE = r"""
WITH parts AS (
    SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
    SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM ruled),
links AS (SELECT host AS source, lower(unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1))) AS target FROM parts),
edges AS (SELECT DISTINCT source, target FROM links WHERE source <> '' AND source <> target),
both_ways AS (SELECT 'trust' AS kind, source, target FROM edges UNION ALL SELECT 'distrust', target, source FROM edges),
walks AS (SELECT *, count(*) OVER (PARTITION BY kind, source) AS degree FROM both_ways),
shares AS (SELECT host, 0.15 * count(*) FILTER (WHERE ruled = 'allow') / count(*) AS good, 0.15 * count(*) FILTER (WHERE ruled = 'block') / count(*) AS bad
           FROM judged WHERE host <> '' GROUP BY host),
r0 AS (SELECT host, 'trust' AS kind, good::DOUBLE AS score FROM shares WHERE good > 0 UNION ALL SELECT host, 'distrust', bad FROM shares WHERE bad > 0),""" \
    + ",".join(_STEP.format(n=n, m=n - 1) for n in range(1, ROUNDS + 1)) + r""",
hosts AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust
          FROM r""" + str(ROUNDS) + r""" GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN hosts h ON h.host = j.host
"""
