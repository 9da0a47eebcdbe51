"""Sharding by size: sampled splitters, quantile boundaries, range partition, overfull ranges subdivided.

Null texts have no bytes; the size of a row is its bytes plus a fixed share for its frame.  Rows without a
key come last.  Rows that tie in key are ordered by their text's hash, equal rows arbitrarily among
themselves.  No rows give no shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import ship_package, stage

FRAME = 8
LAST = (1 << 63) - 1


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """One light row per document: id, key, size, text_crc32, tie."""
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(key or id_col).cast("long"), F.lit(LAST)).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + FRAME).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"))


def splitters(light: DataFrame, ranges: int, sample: int) -> np.ndarray:
    """Boundaries between ``ranges`` key ranges: quantiles of a size-weighted sample of keys.

    Each row draws an exponential time with its size as rate, from its hash; the earliest ``sample`` rows are
    a weighted sample.  Only that many keys reach the driver.
    """
    even = (F.shiftrightunsigned(F.xxhash64("id", "tie", F.lit(11)), 11) + 0.5) / float(1 << 53)
    drawn = light.select("key", (-F.log(even) / F.col("size")).alias("time")).orderBy("time", "key").limit(sample)
    keys = np.sort(np.array([r["key"] for r in drawn.select("key").collect()], np.int64))
    return np.unique(keys[[len(keys) * k // ranges for k in range(1, ranges)]]) if len(keys) else keys


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text", key: str | None = None,
           range_rows: int = 250_000) -> DataFrame:
    """Light rows with ``shard`` and ``slot``: shards of near equal size, slots gapless from 0 in each.

    The key ranges only spread the work: about ``range_rows`` rows each, eight a shard at least.  A range
    with over twice its share of bytes (a hot key, an unlucky sample) is subdivided by hash.  Rows are then
    laid end to end, range after range, and cut where a shard's share of all bytes ends.
    """
    spark = docs.sparkSession
    ship_package(spark)
    light = stage(sized(docs, id_col, text, key), "sized").withColumn("seq", F.monotonically_increasing_id())
    rows, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(max(8 * shards, rows // range_rows), 16384)
    bounds = spark.sparkContext.broadcast(splitters(light, ranges, 32 * ranges))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), side="right").astype("int32"))

    ranged = light.withColumn("range", range_of("key"))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * ranges > 2 * total)
    overfull = sizes.select("range", F.ceil(F.col("bytes") * ranges / (2.0 * total)).cast("int").alias("parts"))
    # at most ranges / 2 ranges can be above twice the mean
    part = F.coalesce(F.pmod(F.xxhash64("id", "tie", "seq"), F.col("parts")), F.lit(0)).cast("int")
    sliced = stage(ranged.join(F.broadcast(overfull), "range", "left").withColumn("part", part).drop("parts"), "sliced")
    slices = sliced.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # at most 1.5 times `ranges` slices
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range", "part").orderBy("key", "tie", "seq")
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    placed = sliced.join(F.broadcast(starts), ["range", "part"]).select(
        "id", "key", "size", "text_crc32", "tie", (F.col("rows_before") + F.row_number().over(inside) - 1).alias("row"),
        F.least(F.floor(middle * shards / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"))
    placed = stage(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "id", "size", "text_crc32", "tie", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text: str = "text", rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` below ``path`` as shard=0, 1, ..., each in slot order and in files of so many rows at most."""
    copy = F.row_number().over(Window.partitionBy("_id", "_tie").orderBy("_tie"))
    mine = docs.select("*", F.struct(F.col(id_col)).alias("_id"), F.xxhash64(text).alias("_tie")).withColumn("_copy", copy)
    place = assign(docs, shards, id_col, text).select(F.struct(F.col("id").alias(id_col)).alias("_id"), F.col("tie").alias("_tie"), "shard", "slot")
    place = place.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_tie").orderBy("shard", "slot")))
    joined = mine.join(place, mine["_id"].eqNullSafe(place["_id"]) & (mine["_tie"] == place["_tie"]) & (mine["_copy"] == place["_copy"]))
    part = F.floor(place["slot"] / rows_per_file)
    (joined.select(*(mine[c] for c in docs.columns if c not in ("shard", "slot")), place["shard"], place["slot"])
     .repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
