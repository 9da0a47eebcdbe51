"""Which feeds run: due now, marked as run, main feed as a stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import is_blank
from newsloom.functions.dates import moment, ran_today, today_at


def feeds_due(feeds: DataFrame, now) -> DataFrame:
    """Enabled feeds whose time has come today and that have not run today."""
    return feeds.where(
        F.col("enabled") & (moment(now) >= today_at(now, F.col("time"))) & ~ran_today(F.col("last_run"), now)
    )


def mark_as_run(feeds: DataFrame, processed: DataFrame, now) -> DataFrame:
    """Set ``last_run`` on the first row of every processed id.

    ``processed`` brings (id).  The first row of an id is found by aggregation,
    so no id's rows have to meet in one task.
    """
    stamp = F.date_format(moment(now), "yyyy-MM-dd HH:mm:ss")
    first = (
        feeds.groupBy("id").agg(F.min("feed_pos").alias("_first"))
        .join(processed.select("id").distinct(), "id", "left_semi")
    )
    return (
        feeds.join(first, "id", "left")
        .withColumn("last_run", F.when(F.col("feed_pos") == F.col("_first"), stamp).otherwise(F.col("last_run")))
        .select(*feeds.columns)
    )


def main_feed(table: DataFrame) -> DataFrame:
    """A one-row (feed_url, quantity, translate, category) table as a schedule row."""
    return table.where(~is_blank("feed_url")).select(
        F.lit(0).cast("long").alias("feed_pos"),
        F.lit("main").alias("id"),
        F.lit(True).alias("enabled"),
        "feed_url",
        F.lit(fixed.DEFAULT_TIME).alias("time"),
        F.coalesce(F.col("quantity"), F.lit(1)).cast("int").alias("quantity"),
        F.coalesce(F.col("category"), F.lit(0)).cast("int").alias("category"),
        F.coalesce(F.col("translate"), F.lit(False)).alias("translate"),
        F.lit("publish").alias("post_status"),
        F.lit("").alias("last_run"),
    )


def feeds_effective(feeds: DataFrame, main: DataFrame, now) -> DataFrame:
    """Due feeds; the main feed only when no feed at all is configured.

    The emptiness test reads at most one row of ``feeds``.
    """
    none_configured = feeds.select(F.lit(1).alias("one")).limit(1).agg(F.count("one").alias("n")).scalar() == 0
    return feeds_due(feeds, now).unionByName(main_feed(main).where(none_configured))
