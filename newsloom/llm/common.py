"""What several operators share: words, table access, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import stage

# A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order, repeats included; null for null."""
    return F.filter(F.split(text, BLANKS), lambda word: word != "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def unused(name: str, docs: DataFrame) -> str:
    """``name``, made longer until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links between longs: (node, root), root the smallest node.

    Alternates the large-star and small-star steps, so a chain of n nodes takes about log n rounds.  Every
    round is joins and minima per node, combined on the map side; a hub's links are split by adaptive
    execution.  Rounds are written to the shared folder, so the lineage stays one round long.  Nodes
    without a link to another node are not in the result.
    """
    smaller, larger = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    links = stage(links.filter(F.col(a) != F.col(b)).select(larger, smaller).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before or now["n"] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a pair (v, m) may be the wrong way round for the next round only if v < m, which m = min forbids
        links = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
