"""URL filters: rules on host and path, and trust propagated over links between hosts for what no rule decides.

Trust starts at hosts whose pages the rules allow and flows along links; distrust starts at hosts whose pages
they block and flows backwards, to the hosts that link to them.  A host starts with the share of its pages that
the rules allow, or block.  Both are personalised PageRanks, iterated as joins over host edges.  A page that no
rule fits is blocked if its host's distrust exceeds its trust by ``threshold``.  Null urls and urls without ://
have an empty host and path; no rule fits an empty host, and it takes part in no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import unused
from newsloom.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def rest_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def suffixes(name: Column) -> Column:
    """The host itself and its parent domains."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules that fit it, as an array; hosts without any are left out."""
    each = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).filter("host <> ''")
    fits = each.join(rules, "rule_host").withColumn("rule", F.concat("rule_host", "rule_path"))
    return fits.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("length"), "rule", "rule_path", "verdict")).alias("rules"))


def longest(rules: Column, page_path: Column) -> Column:
    """The longest of a host's rules that the path starts with; of equally long ones the last by name."""
    return F.array_max(F.filter(rules, lambda r: page_path.startswith(r["rule_path"])))


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): distinct links from host to another host."""
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda h: F.translate(F.regexp_replace(h, r"^.*@|:[0-9]*$", ""), UPPER, LOWER))))
    return pages.select(host(F.col(url)).alias("a"), to.alias("b")).filter("a <> '' and b <> '' and a <> b").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """Personalised PageRank: r = (1 - damping) seed + damping * (incoming ranks / their numbers of links).

    A host without outgoing links keeps what it has.  Each round is one join and one sum per host; every
    fifth round is written to the shared folder.
    """
    out = stage(edges.join(edges.groupBy("a").agg(F.count("*").alias("links")), "a"), "edges")
    start = stage(seeds.select("host", "seed"), "seeds")
    rank = start.select("host", F.col("seed").alias("rank"))
    if out.isEmpty():  # nothing flows, every host keeps its seed
        return rank
    sinks = start.join(out.select(F.col("a").alias("host")).distinct(), "host", "left_anti").select("host")
    for k in range(rounds):
        sent = rank.join(out, rank["host"] == out["a"]).select(F.col("b").alias("host"), (damping * F.col("rank") / F.col("links")).alias("part"))
        kept = rank.join(sinks, "host", "left_semi").select("host", (damping * F.col("rank")).alias("part"))
        own = start.select("host", ((1 - damping) * F.col("seed")).alias("part"))
        rank = sent.union(kept).union(own).groupBy("host").agg(F.sum("part").alias("rank"))
        if k % 5 == 4:
            rank = stage(rank, "rank")
    return rank


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", damping: float = 0.85, rounds: int = 20,
          threshold: float = 0.5) -> DataFrame:
    """``pages`` with a struct column ``_url`` (host, path, rule, verdict, trust, distrust); one of that name is replaced."""
    hosts = pages.select(host(F.col(url)).alias("host")).distinct()
    edges = stage(host_edges(pages, url, html), "host-edges")
    # two small frames per host, not per page
    fitting = stage(host_rules(hosts, rules), "host-rules")
    light = pages.select(host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    ruled = light.join(fitting, "host", "left").withColumn("verdict", longest(F.col("rules"), F.col("path"))["verdict"])
    shares = stage(ruled.filter("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("blocked")), "host-shares")
    everyone = shares.select("host").union(edges.select(F.col("b").alias("host"))).distinct()
    seeds = everyone.join(shares, "host", "left").na.fill(0.0)
    trust = propagate(edges, seeds.select("host", F.col("allowed").alias("seed")), damping, rounds)
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    distrust = propagate(back, seeds.select("host", F.col("blocked").alias("seed")), damping, rounds)
    known = stage(shares.select("host").join(fitting, "host", "left").join(trust.withColumnRenamed("rank", "trust"), "host", "left")
                  .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left"), "hosts")
    own, met = unused("_host", pages), unused("_known", pages)
    joined = pages.withColumn(own, host(F.col(url))).join(known.withColumnRenamed("host", met), F.col(own) == F.col(met), "left")
    best = longest(known["rules"], path(pages[url]))
    by_host = F.when(F.coalesce(known["distrust"] - known["trust"], F.lit(0.0)) > threshold, "block").otherwise("allow")
    made = F.struct(F.col(own).alias("host"), path(pages[url]).alias("path"), best["rule"].alias("rule"), F.coalesce(best["verdict"], by_host).alias("verdict"),
                    F.coalesce(known["trust"], F.lit(0.0)).alias("trust"), F.coalesce(known["distrust"], F.lit(0.0)).alias("distrust"))
    return joined.select(*(pages[c] for c in pages.columns if c != "_url"), made.alias("_url"))
