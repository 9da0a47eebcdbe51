"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import licenses, linededup, manifest, mixing, packing, pii, quality, search, shards, simhash, spelling, tokencount, urlfilter
from newsloom.llm.common import table
from newsloom.llm.oracles import MANIFEST, SPELLING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op12_manifest": MANIFEST, "op13_spelling": SPELLING}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.duplicate_classes(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *(f"_quality.{c}" for c in quality.COUNTS), "_quality.base_failed", "_quality.kept")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, and the shards it goes to."""
    found = mixing.dealt(table(spark, sf_dir, "documents"))
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda words, _: words + F.col("size"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of near equal bytes."""
    placed = shards.assign(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    light = found.select("doc_id", "_pii.base", "_pii.spans")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return light.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document: its own, or that of the nearest directory above it.

    Documents have no paths; they are filed by source, language and the leading digits of their id.
    """
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), "doc_id")
    return licenses.scan(docs.select("doc_id", place.alias("path"), "text")).select("doc_id", "path", "license", "via", "license_line")


@query
def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))
    return judged.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


@query
def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines removed and what is left, for every document."""
    left = linededup.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("_lines.before").alias("n_lines"), F.col("_lines.removed").alias("n_removed"), F.octet_length("text").cast("long").alias("left_bytes"),
                       F.crc32(F.col("text").cast("binary")).alias("left_crc32"))


@query
def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs.filter("doc_id % 100 = 0"), docs).withColumn("score", F.round("score", 6))


@query
def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are more than 2,048."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a tampered copy still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in manifest.COLUMNS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, manifest.leaf(*values[:-1], F.replace("text", F.lit("\n"), F.lit(""))))
    found = manifest.manifest(docs, tampered=tampered)
    start = F.coalesce("tampered", "leaf")
    found = found.withColumns({"proof_sha256": manifest.proof_hash(F.col("proof")), "folded_root": manifest.folded(start, F.col("proof"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and number of near words of every word, letters lost in one of 97 runs."""
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("None")), F.lit(":"), F.col("run")).cast("binary"))
    lost = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(F.substring("run", F.lit(1), lost), F.substring("run", lost + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling.variants(spelling.counted(runs.withColumn("h", h).select(word.alias("word"))))
