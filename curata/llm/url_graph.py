"""URL filters by link-graph propagation.

Rules ``(host, path)`` decide the urls that they fit. Hosts whose pages no rule
decides are judged by the links between hosts: pages that a rule allows make
their host a trusted seed, pages that a rule blocks a blocked seed (each by
its share of the host's pages). A personalised PageRank carries trust along
the links from the trusted seeds, another carries distrust against the links
from the blocked seeds, since who links to a blocked host is suspect. Both walk
together: one join and one sum a step over ``(host, kind, score)``.

A host is blocked when distrust makes up more than ``threshold`` of trust,
distrust and the weight of its pages that no rule decides (which count as much
as seeds of their share would); a host without evidence is allowed.

Edge cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is allowed; links inside one host and links without a host carry
nothing; repeated pages count as often as they occur; a null html has no link;
columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']?\s*((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"'\s>]+)"""
DAMPING = 0.85
STEPS = 12
THRESHOLD = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, verdict) that fits, as text, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, links."""
    host, _ = host_and_path(F.col("url"))
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    found = pages.select(host.alias("src"), link.alias("link"))
    to, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), "link")).otherwise(F.col("link")))
    return (found.select("src", to.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("links")))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """Trust and distrust of each host: host, kind (trust or distrust), score.

    ``seeds`` has the same columns. ``edges`` is read often, so it should be a
    written table."""
    def walk(kind: str, start: str, end: str) -> DataFrame:
        out = edges.groupBy(start).agg(F.sum("links").alias("out"))
        return edges.join(out, start).select(F.lit(kind).alias("kind"), F.col(start).alias("start"), F.col(end).alias("end"),
                                             (F.col("links") / F.col("out") * damping).alias("weight"))

    base = seeds.select("host", "kind", (F.col("score") * (1 - damping)).alias("score"))
    if edges.isEmpty():
        return base
    base = written(base, "seeds")
    ways = written(walk("trust", "src", "dst").unionByName(walk("distrust", "dst", "src")), "ways")
    now = base
    for step in range(steps):
        come = ways.join(now.withColumnRenamed("host", "start"), ["start", "kind"]).select(
            F.col("end").alias("host"), "kind", (F.col("weight") * F.col("score")).alias("score"))
        now = base.unionByName(come).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if step % 4 == 3:  # the plan stays short
            now = written(now, "scores")
    return now


def judge_hosts(urls: DataFrame, edges: DataFrame, steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """Verdict of each host from rows (host, verdict by rule or null)."""
    shares = urls.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("int")).alias("trust"),
        F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("int")).alias("distrust"))
    shares = written(shares, "shares")
    seeds = reduce(DataFrame.unionByName, (shares.select("host", F.lit(k).alias("kind"), F.col(k).alias("score")).where("score > 0") for k in ("trust", "distrust")))
    neutral = shares.select("host", F.lit("neutral").alias("kind"), ((1 - F.col("trust") - F.col("distrust")) * (1 - damping)).alias("score"))
    each = propagate(edges, seeds, steps, damping).unionByName(neutral).groupBy("host").agg(
        F.sum("score").alias("all"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    return each.select("host", (F.col("distrust") > threshold * F.col("all")).alias("blocked"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], steps: int = STEPS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """Every page's page_id, url, host, path, rule and verdict."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "verdict": verdict})
    hosts = judge_hosts(urls, written(host_edges(pages), "edges"), steps, damping, threshold)
    by_graph = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return urls.join(hosts, "host", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", by_graph).alias("verdict"))
