"""Polling import: each micro-batch of feed items, or of whole feed documents, is one import run.

History is a table, not streaming state: an address stays known for ever, and state that only grows has no place
in memory.  It lies in hash buckets of the address, and a batch reads the buckets of its own addresses.  All
tables of a batch become visible by one commit (``sources.committed``), so a batch that breaks off anywhere
leaves nothing behind, and one that is run again after its commit does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.schedule import feeds_due
from newsloom.plans.importer import ImportOptions, daily_items, import_run
from newsloom.plans.rewrite import Rework
from newsloom.plans.translate import CACHE_SCHEMA, newest_entries
from newsloom.session import write_and_read
from newsloom.sources.committed import BUCKETS, CommittedTables, Keyed, Part, one_row_per_key
from newsloom.sources.feeds import parse_documents, parsed_items

POSTS_SCHEMA = (
    "post_id string, post_title string, post_content string, post_status string, post_author long, post_type string, "
    "post_date timestamp_ntz, post_date_gmt timestamp_ntz, category long, featured_image string, "
    "meta_description string, url string, feed string, feed_title string"
)
META_SCHEMA = "post_id string, meta_key string, meta_value string"
RESULT_SCHEMA = "feed string, seq long, link string, status string, reason string"
LOG_SCHEMA = "id long, time timestamp_ntz, level string, message string, context string"
FAILED_SCHEMA = "feed string, document string, feed_error string"
WRITER = "import"
# one batch of documents or items per call; the first argument is the batch's table
Batch = Callable[[DataFrame, int], None]


def import_tables(root: str, buckets: int = BUCKETS) -> CommittedTables:
    """The tables an import keeps.  ``first_seen`` is the history of addresses, ``cache`` that of translations."""
    with_batch = {
        "posts": POSTS_SCHEMA, "post_meta": META_SCHEMA, "results": RESULT_SCHEMA, "logs": LOG_SCHEMA,
        "failed_documents": FAILED_SCHEMA,
    }
    schemas = {name: f"{schema}, batch_id long" for name, schema in with_batch.items()}
    return CommittedTables(
        root, {**schemas, "first_seen": "url string", "cache": CACHE_SCHEMA},
        {"first_seen": Keyed("url", one_row_per_key("url"), buckets), "cache": Keyed("key", newest_entries, buckets)},
    )


def adopt_history(tables: CommittedTables, post_meta: DataFrame, options: ImportOptions = ImportOptions()) -> None:
    """Make the posts of an earlier system known: their metadata, and their addresses as seen."""
    spark = post_meta.sparkSession
    urls = post_meta.where((F.col("meta_key") == options.meta_key("original_url")) & F.col("meta_value").isNotNull())
    tables.commit(spark, {
        "post_meta": tables.write(post_meta.withColumn("batch_id", F.lit(-1).cast("long")), "post_meta"),
        "first_seen": tables.write(urls.select(F.col("meta_value").alias("url")).distinct(), "first_seen"),
    })


def seen_urls(tables: CommittedTables, asked: DataFrame, link: str = "link") -> DataFrame:
    """Those of the asked addresses that were imported before, each once."""
    return tables.among("first_seen", asked, link).distinct()


def _import(
    tables: CommittedTables, items: DataFrame, batch_id: int, pages: DataFrame, sources: DataFrame, now,
    options: ImportOptions, rework, scheduled: DataFrame | None = None, failed: DataFrame | None = None,
) -> None:
    spark = items.sparkSession

    def store(df: DataFrame, name: str) -> DataFrame:
        # one place per name: a batch starts when the one before it is done with it
        return write_and_read(df, f"{tables.path('_work')}/{name}")

    if isinstance(rework, Rework):  # the batch's own time, and the cache these tables keep
        rework = replace(rework, now=now, cache=lambda keys: tables.among("cache", keys), entries=None)
    out = import_run(
        items, pages, None, sources, now, options, rework=rework,
        posts_table=lambda winners: store(winners, "winners"), store=store,
        seen=lambda asked: seen_urls(tables, asked),
    )
    out.scheduled, out.failed_feeds = scheduled, failed
    rows = {
        "posts": out.posts, "post_meta": out.post_meta,
        "results": out.results.select("feed", "seq", "link", "status", "reason"), "logs": out.daily_logs,
    }
    if failed is not None:
        rows["failed_documents"] = failed
    label = f"batch-{batch_id}"
    parts: dict[str, Part] = {
        name: tables.write(df.withColumn("batch_id", F.lit(batch_id).cast("long")), name, label) for name, df in rows.items()
    }
    # with force an address is imported again, but is as known as before
    parts["first_seen"] = tables.write(out.winners.select(F.col("link").alias("url")).distinct(), "first_seen", label)
    if isinstance(rework, Rework) and rework.entries is not None:
        parts["cache"] = tables.write(rework.entries, "cache", label)
    tables.commit(spark, parts, writer=WRITER, batch=batch_id)
    for name in parts.keys() & tables.keyed.keys():
        tables.compact(spark, name)


def import_batch(
    tables: CommittedTables, pages: DataFrame, sources: DataFrame, now_of: Callable[[int], object],
    options: ImportOptions = ImportOptions(), rework=None,
) -> Batch:
    """The ``foreachBatch`` function of a stream of items.

    ``now_of(batch_id)`` gives the batch's time; it has to give the same time
    when a batch is run again.
    """

    def run(items: DataFrame, batch_id: int) -> None:
        if not tables.is_done(items.sparkSession, WRITER, batch_id):
            _import(tables, items, batch_id, pages, sources, now_of(batch_id), options, rework)

    return run


def documents_batch(
    tables: CommittedTables, pages: DataFrame, sources: DataFrame, now_of: Callable[[int], object],
    options: ImportOptions = ImportOptions(), rework=None, schedule: Callable[[], DataFrame] | None = None,
) -> Batch:
    """The ``foreachBatch`` function of a stream of feed documents (feed, document, xml).

    Every document is parsed once; those that cannot be read go to ``failed_documents`` with the reason.  With
    ``schedule`` (gives the schedule rows) only feeds that are due are imported, each by its own settings.
    """

    def run(documents: DataFrame, batch_id: int) -> None:
        if tables.is_done(documents.sparkSession, WRITER, batch_id):
            return
        now = now_of(batch_id)
        keep = ("feed", "document")
        parsed = write_and_read(parse_documents(documents, keep=keep), f"{tables.path('_work')}/parsed")
        items, due = parsed_items(parsed, keep), None
        if schedule is not None:
            due = feeds_due(schedule(), now)
            items = daily_items(items, due)
        failed = parsed.where("feed_error IS NOT NULL").select(*keep, "feed_error")
        _import(tables, items, batch_id, pages, sources, now, options, rework, due, failed)

    return run


def _start(stream: DataFrame, tables: CommittedTables, batch: Batch, trigger: dict | None):
    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", tables.path("_progress"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_import(
    items: DataFrame, tables: CommittedTables, pages: DataFrame, sources: DataFrame, now_of,
    options: ImportOptions = ImportOptions(), rework=None, trigger: dict | None = None,
):
    """Start the import of a streaming item table; by default it stops when all input is read."""
    return _start(items, tables, import_batch(tables, pages, sources, now_of, options, rework), trigger)


def stream_feed_import(
    documents: DataFrame, tables: CommittedTables, pages: DataFrame, sources: DataFrame, now_of,
    options: ImportOptions = ImportOptions(), rework=None, schedule=None, trigger: dict | None = None,
):
    """Start the import of feed documents as they arrive (``feeds.read_feed_documents(..., streaming=True)``)."""
    return _start(documents, tables, documents_batch(tables, pages, sources, now_of, options, rework, schedule), trigger)


def seen_tables(root: str, link: str, schema: str, buckets: int = BUCKETS) -> CommittedTables:
    return CommittedTables(root, {"first_seen": schema}, {"first_seen": Keyed(link, one_row_per_key(link), buckets)})


def stream_new_urls(items: DataFrame, root: str, link: str = "link", trigger: dict | None = None, buckets: int = BUCKETS):
    """Keep the items whose address was never seen before, in the table ``first_seen`` (see ``new_urls``)."""
    tables = seen_tables(root, link, items._jdf.schema().toDDL(), buckets)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if tables.is_done(spark, WRITER, batch_id):
            return
        first = batch.groupBy(link).agg(F.min_by(F.struct(*batch.columns), F.struct("feed", "seq")).alias("_row")).select("_row.*")
        first = write_and_read(first, f"{tables.path('_work')}/first")
        known = tables.among("first_seen", first, link).select(F.col(link).alias("_seen"))
        tables.append(first.join(known, F.col(link) == F.col("_seen"), "left_anti"), "first_seen", writer=WRITER, batch=batch_id)
        tables.compact(spark, "first_seen")

    return _start(items, tables, run, trigger)


def new_urls(spark: SparkSession, root: str, schema: str, link: str = "link") -> DataFrame:
    """What ``stream_new_urls`` has kept."""
    return seen_tables(root, link, schema).read(spark, "first_seen")
