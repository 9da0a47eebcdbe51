"""An import run: from feed items to posts, their metadata, results and logs.

Shape of the plan (each arrow is a DataFrame step):

    items -> newest per feed -> duplicate flag -> trust flag      (light columns)
          -> candidates + extracted pages -> content choice       (heavy columns)
          -> first importable item per address = posts
    flags + posts -> status of every item -> summary, logs

Pages are narrowed to the addresses that are still candidates before they are
parsed.  "The first one wins" is an aggregation per address, combined on the
map side, so an address carried by a great many feeds is no hot task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import byte_len, is_blank, or_default, strip_all_tags, strip_tags
from newsloom.functions.dates import moment
from newsloom.functions.text import escape_html
from newsloom.operators.logs import log_rows
from newsloom.operators.selection import imported_among, newest_per_feed, with_duplicate_flag, with_trust_flag
from newsloom.plans.extract import extract_pages
from newsloom.session import stage


@dataclass(frozen=True)
class ImportOptions:
    mode: str = "normal"              # "force" imports an address again
    quantity: int | str = 5           # a number, or the item column that holds it
    max_quantity: int | None = None   # bound of that column, where it has one
    translate: bool = False
    set_featured: bool = True
    post_status: str = "draft"
    category_id: int = 0
    default_category: int = 0
    post_author: int = 1
    trust_match: str = "contains"
    time_zone: str = "UTC"            # the site's own; "now" is its local time
    meta_prefix: str = "_newsloom_"   # set to the site's own prefix to go on with its tables
    extraction: dict = field(default_factory=dict)

    def meta_key(self, name: str) -> str:
        return self.meta_prefix + name


DAILY = ImportOptions(post_status="publish", quantity="quantity", max_quantity=fixed.QUANTITY_MAX)
OPTION_DEFAULTS = {
    "mode": "normal", "translate": False, "download_images": True, "set_featured": True,
    "post_status": "draft", "feed_url": "",
}


def with_default_options(requests: DataFrame, main_feed_url: str = "") -> DataFrame:
    """Import requests with the missing options filled in, quantity bounded, main feed as fallback."""
    out = requests
    for name, default in OPTION_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    quantity = F.coalesce(F.col("quantity"), F.lit(5))
    bounded = F.greatest(F.lit(fixed.QUANTITY_MIN), F.least(F.lit(fixed.QUANTITY_MAX), quantity))
    return out.withColumn("quantity", bounded.cast("int")).withColumn(
        "feed_url", or_default("feed_url", F.lit(main_feed_url))
    )


def content_choice(
    page_ok: Column, page_content: Column, page_title: Column, page_image: Column,
    item_title: Column, item_content: Column, item_description: Column,
) -> Column:
    """Struct of the content, title and image to use, and where the content came from.

    Long enough extracted text wins; then the feed's content, then its
    description; a feed text that is too short gives way to any extracted text.
    """
    long_enough = F.coalesce(page_ok, F.lit(False)) & (
        F.coalesce(byte_len(strip_tags(page_content)), F.lit(0)) > fixed.EXTRACTED_MIN_BYTES
    )
    from_feed = F.when(~is_blank(item_content), item_content).otherwise(F.coalesce(item_description, F.lit("")))
    feed_short = byte_len(strip_tags(from_feed)) < fixed.FEED_TEXT_MIN_BYTES
    use_short_page = feed_short & ~is_blank(page_content)
    origin = (
        F.when(long_enough, "page").when(use_short_page, "short_page")
        .when(~is_blank(item_content), "feed_content").when(~is_blank(item_description), "feed_description")
        .otherwise("none")
    )
    return F.struct(
        F.when(long_enough | use_short_page, page_content).otherwise(from_feed).alias("content"),
        F.when(long_enough & ~is_blank(page_title), page_title).otherwise(item_title).alias("title"),
        F.when(long_enough, F.coalesce(page_image, F.lit(""))).otherwise("").alias("featured_image"),
        origin.alias("origin"),
    )


def run_order() -> Column:
    """Feeds in their order, the oldest item first (the reverse of newest first)."""
    return F.struct(
        F.col("feed_pos").cast("long").alias("feed_pos"), F.col("feed").alias("feed"),
        F.col("pub_epoch").cast("long").alias("at"), (-F.col("seq")).cast("long").alias("back"),
    )


def first_importable(chosen: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Per key the first row, by order, of those with content.  A combinable aggregate."""
    return (
        chosen.groupBy(key)
        .agg(F.min_by(F.struct(*[c for c in fields if c != key]), order).alias("_row"), F.min(order).alias(order))
        .select(key, order, "_row.*")
    )


def item_status(items: DataFrame, winners: DataFrame, key: str, order: str) -> DataFrame:
    """Add ``status`` and ``reason``.  ``winners(key, order)`` holds each imported item once."""
    first = winners.select(F.col(key).alias("_key"), F.col(order).alias("_first"))
    joined = items.join(first, items[key] == first["_key"], "left")
    later = F.col(order) > F.col("_first")
    status = (
        F.when(F.col("is_duplicate") | ~F.col("is_trusted"), "skipped")
        .when(F.col(order) == F.col("_first"), "imported")
        .when(later, "skipped")
        .otherwise("failed")
    )
    in_run = later & ~F.col("is_duplicate")
    reason = (
        # the duplicate test comes first, also against what this run imported before
        F.when(F.col("is_duplicate") | F.coalesce(in_run, F.lit(False)) & F.col("is_trusted"), "")
        .when(~F.col("is_trusted"), fixed.UNTRUSTED_REASON)
        .when(status == "failed", fixed.NO_CONTENT_ERROR)
        .otherwise("")
    )
    return joined.withColumn("reason", reason).withColumn("status", status).drop("_key", "_first")


def import_summary(results: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Counts per feed, or per schedule row and feed where the results come from a schedule.

    ``feeds(feed, feed_error)`` adds feeds without items and failed fetches; with a ``schedule_row`` it
    is joined by that too.
    """
    keys = [c for c in ("schedule_row", "feed") if c in results.columns]
    counts = results.groupBy(*keys).agg(*[
        F.count_if(F.col("status") == s).cast("long").alias(s) for s in ("imported", "skipped", "failed")
    ])
    if feeds is None:
        return counts
    on = [c for c in keys if c in feeds.columns]
    return feeds.select(*on, "feed_error").join(counts, on, "left").na.fill(0, ["imported", "skipped", "failed"])


def import_totals(results: DataFrame) -> DataFrame:
    """Counts per feed and, with a null feed, of the whole run."""
    return results.rollup("feed").agg(*[
        F.count_if(F.col("status") == s).cast("long").alias(s) for s in ("imported", "skipped", "failed")
    ])


def build_posts(winners: DataFrame, now, options: ImportOptions) -> DataFrame:
    """Post rows.  Ids are hashes of address, place and run time: a replay gives the same ones."""
    when_run = F.date_format(moment(now), "yyyy-MM-dd HH:mm:ss")

    def choice(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in winners.columns else F.lit(default)

    category = choice("category", options.category_id)
    # with force, two schedule rows of one feed post the same item twice
    row = [F.col("schedule_row").cast("string")] if "schedule_row" in winners.columns else []
    return winners.select(
        F.md5(F.concat_ws("|", "link", "feed", F.col("seq").cast("string"), when_run, *row)).alias("post_id"),
        strip_all_tags("title").alias("post_title"),
        F.col("content").alias("post_content"),
        choice("post_status", options.post_status).alias("post_status"),
        F.lit(options.post_author).cast("long").alias("post_author"),
        F.lit("post").alias("post_type"),
        moment(now).alias("post_date"),
        F.convert_timezone(F.lit(options.time_zone), F.lit("UTC"), moment(now)).alias("post_date_gmt"),
        F.when(category > 0, category).otherwise(options.default_category).cast("long").alias("category"),
        (F.col("featured_image") if options.set_featured else F.lit("")).alias("featured_image"),
        F.coalesce("meta_description", F.lit("")).alias("meta_description"),
        F.col("link").alias("url"),
        "feed",
        F.coalesce("feed_title", F.lit("")).alias("feed_title"),
    )


def build_post_meta(posts: DataFrame, options: ImportOptions = ImportOptions()) -> DataFrame:
    """Long (post_id, meta_key, meta_value) rows; description keys only where there is one."""
    fixed_rows = (
        (options.meta_key("original_url"), F.col("url")),
        (options.meta_key("imported"), F.lit("1")),
        (options.meta_key("source_title"), F.col("feed_title")),
    )
    described = [(k, F.col("meta_description")) for k in (*fixed.SEO_DESCRIPTION_KEYS, options.meta_key("meta_description"))]
    entries = F.array(*[
        F.struct(F.lit(k).alias("meta_key"), v.alias("meta_value"), F.lit(optional).alias("optional"))
        for group, optional in ((fixed_rows, False), (described, True)) for k, v in group
    ])
    return (
        posts.select("post_id", F.inline(entries))
        .where(~F.col("optional") | ~is_blank("meta_value"))
        .drop("optional")
    )


def imported_total(post_meta: DataFrame, options: ImportOptions = ImportOptions()) -> DataFrame:
    return post_meta.where(F.col("meta_key") == options.meta_key("imported")).agg(
        F.count_distinct("post_id").cast("long").alias("imported_total")
    )


def credit_block(source_name: Column, url: Column) -> Column:
    """The attribution box that names and links the source."""
    style = fixed.CREDIT_STYLES
    return F.concat(
        F.lit(f'<div style="{style["box"]}"><p style="{style["head"]}">{fixed.CREDIT_LABEL}</p>'
              f'<p style="{style["body"]}"><strong>'),
        escape_html(source_name),
        F.lit('</strong><br><a href="'), escape_html(url),
        F.lit('" target="_blank" rel="nofollow noopener">'), escape_html(url),
        F.lit("</a></p></div>"),
    )


# --- the run ---------------------------------------------------------------

@dataclass
class ImportRun:
    """The tables of a run, each put together when it is first asked for."""

    flagged: DataFrame    # the items looked at, without their texts
    winners: DataFrame    # the items that are posted, with what is posted
    now: object
    options: ImportOptions
    feeds: DataFrame | None = None
    scheduled: DataFrame | None = None      # the schedule rows that ran
    failed_feeds: DataFrame | None = None   # feed, feed_error

    @cached_property
    def posts(self) -> DataFrame:
        return build_posts(self.winners, self.now, self.options)

    @cached_property
    def post_meta(self) -> DataFrame:
        return build_post_meta(self.posts, self.options)

    @cached_property
    def results(self) -> DataFrame:
        return item_status(self.flagged, self.winners, "run_key", "run_order")

    @cached_property
    def summary(self) -> DataFrame:
        return import_summary(self.results, self.feeds)

    @cached_property
    def totals(self) -> DataFrame:
        return import_totals(self.results)

    @cached_property
    def logs(self) -> DataFrame:
        return run_logs(self.results, self.now)

    @cached_property
    def daily_logs(self) -> DataFrame:
        return daily_logs(self.results, self.now, self.scheduled, self.failed_feeds, self.winners)


_ITEM_TEXTS = ("title", "content", "description")


# stores a table under a name and returns the stored table
Store = Callable[[DataFrame, str], DataFrame]


def flag_items(
    items: DataFrame, post_meta: DataFrame | None, sources: DataFrame, options: ImportOptions, store: Store = stage,
    seen: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The items a run looks at, with duplicate and trust flags, run order and in-run key.

    Known addresses come from ``post_meta``, or from ``seen(items)``, which gives those of the items' own.

    The few items that are left after newest-per-feed are written out, and again
    with their flags: the item table and the history are each read once, and from
    here on the planner knows the real sizes when it picks a join.
    """
    defaults = {"feed_pos": F.lit(1), "feed_title": F.lit(""), "content": F.lit(""), "description": F.lit(""),
                "translate": F.lit(options.translate)}
    for name, value in defaults.items():
        if name not in items.columns:
            items = items.withColumn(name, value)
    items = items.withColumn("link", F.coalesce("link", F.lit("")))
    # a feed that is scheduled twice is looked at twice, each time by its own settings
    scheduled = ["schedule_row"] if "schedule_row" in items.columns else []
    looked_at = store(newest_per_feed(items, options.quantity, options.max_quantity, ["feed", *scheduled]), "looked-at")
    if options.mode == "normal":
        known = seen(looked_at) if seen else imported_among(post_meta, looked_at, options.meta_key("original_url"))
        looked_at = with_duplicate_flag(looked_at, known)
        key = F.col("link")
    else:
        looked_at = looked_at.withColumn("is_duplicate", F.lit(False))
        key = F.concat_ws("|", *scheduled, "feed", F.col("seq").cast("string"), "link")
    flagged = with_trust_flag(looked_at, sources, match=options.trust_match)
    return store(flagged.withColumn("run_key", key).withColumn("run_order", run_order()), "flagged")


def choose_content(flagged: DataFrame, pages: DataFrame, options: ImportOptions) -> DataFrame:
    """Candidates that have content, with the content that will be posted."""
    candidates = flagged.where(~F.col("is_duplicate") & F.col("is_trusted"))
    # by 8-byte hash, so that very many addresses still fit a broadcast and no page text
    # is shuffled to be thrown away; a chance match is dropped by the exact join below
    wanted = candidates.select(F.xxhash64("link").alias("_wanted")).distinct()
    needed = pages.join(wanted, F.xxhash64(pages["url"]) == wanted["_wanted"], "left_semi")
    fields = ("success", "content", "title", "featured_image")
    extracted = extract_pages(needed, ("url",), fields, **options.extraction).select(
        F.col("url").alias("_url"), F.col("success").alias("_ok"), F.col("content").alias("_content"),
        F.col("title").alias("_title"), F.col("featured_image").alias("_image"),
    )
    joined = candidates.join(extracted, candidates["link"] == extracted["_url"], "left")
    choice = content_choice(
        F.col("_ok"), F.col("_content"), F.col("_title"), F.col("_image"), *[F.col(c) for c in _ITEM_TEXTS]
    )
    return (
        joined.withColumn("_choice", choice)
        .drop("_url", "_ok", "_content", "_title", "_image", *_ITEM_TEXTS)
        .select("*", "_choice.*").drop("_choice")
        .where(~is_blank("content"))
    )


def run_winners(flagged: DataFrame, pages: DataFrame, options: ImportOptions) -> DataFrame:
    chosen = choose_content(flagged, pages, options)
    fields = [c for c in chosen.columns if c not in ("run_key", "run_order", "is_duplicate", "is_trusted")]
    return first_importable(chosen, "run_key", "run_order", *fields)


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def run_logs(results: DataFrame, now) -> DataFrame:
    """A warning per failed item and one closing line for the run."""
    failed = log_rows(
        results.where(F.col("status") == "failed"), now, F.lit("WARNING"),
        _fill(fixed.ITEM_FAILED_MESSAGE, error=F.col("reason"), title=F.col("title")), F.struct("feed", "link"),
        position=F.struct("run_order"),
    )
    totals = results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("imported", "skipped", "failed")])
    closing = log_rows(
        totals, now, F.lit("INFO"),
        _fill(fixed.RUN_DONE_MESSAGE, **{s: F.col(s) for s in ("imported", "skipped", "failed")}),
        F.struct("imported", "skipped", "failed"),
    )
    return failed.unionByName(closing)


def daily_logs(
    results: DataFrame, now, scheduled: DataFrame | None = None, failed_feeds: DataFrame | None = None,
    winners: DataFrame | None = None,
) -> DataFrame:
    """All lines of a run: its start, every scheduled feed, feeds that could not be read, posts the rewriter failed on,
    and those of ``run_logs``."""
    one = results.sparkSession.range(1)
    lines = [log_rows(one, now, F.lit("INFO"), F.lit(fixed.RUN_STARTED_MESSAGE))]
    if scheduled is not None:
        asked = _fill(
            fixed.FEED_SCHEDULED_MESSAGE, feed=F.col("feed_url"), quantity=F.col("quantity"),
            translate=F.when(F.col("translate"), fixed.YES).otherwise(fixed.NO), category=F.col("category"))
        lines.append(log_rows(scheduled, now, F.lit("INFO"), asked, position=F.col("feed_pos")))
    if failed_feeds is not None:
        error = _fill(fixed.FEED_ERROR_MESSAGE, error=F.col("feed_error"))
        lines.append(log_rows(failed_feeds, now, F.lit("ERROR"), error, F.struct("feed"), position=F.struct(*failed_feeds.columns)))
    if winners is not None and "rewrite_error" in winners.columns:
        rejected = winners.where(~is_blank("rewrite_error"))
        failure = _fill(fixed.REWRITE_FAILED_MESSAGE, error=F.col("rewrite_error"))
        lines.append(log_rows(rejected, now, F.lit("WARNING"), failure, F.struct("feed", "link"), position=F.struct("run_order")))
    out = run_logs(results, now)
    for rows in lines:
        out = out.unionByName(rows)
    return out


def import_run(
    items: DataFrame,
    pages: DataFrame,
    post_meta: DataFrame | None,
    sources: DataFrame,
    now,
    options: ImportOptions = ImportOptions(),
    feeds: DataFrame | None = None,
    rework: Callable[[DataFrame], DataFrame] | None = None,
    posts_table: Callable[[DataFrame], DataFrame] | None = None,
    store: Store = stage,
    seen: Callable[[DataFrame], DataFrame] | None = None,
) -> ImportRun:
    """The tables of one run.

    ``items`` brings (feed, seq, link, title, content, description, pub_epoch)
    and optionally feed_pos, feed_title, quantity, category, post_status,
    translate.  ``rework`` rewrites or translates the rows that will be posted.
    ``posts_table`` stores the posts and returns the stored table; with it the
    other outputs read that table, so pages are parsed only once per run.
    ``store`` keeps the small tables between the steps.  ``seen`` looks known addresses up in place of ``post_meta``.
    """
    flagged = flag_items(items, post_meta, sources, options, store, seen)
    winners = run_winners(flagged, pages, options)
    if rework is not None:
        winners = rework(winners)
    if "meta_description" not in winners.columns:
        winners = winners.withColumn("meta_description", F.lit(""))
    if posts_table is not None:
        winners = posts_table(winners)
    return ImportRun(flagged.drop("content", "description"), winners, now, options, feeds)


def daily_items(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items of the feeds that run, with each schedule row's settings beside them.

    A feed address may be scheduled more than once; its items come once per ``schedule_row``.
    """
    settings = feeds.select(
        F.col("feed_url").alias("feed"), "feed_pos", F.col("feed_pos").alias("schedule_row"), "quantity", "category", "translate", "post_status"
    )
    return items.drop("feed_pos").join(settings, "feed")


def manual(options: ImportOptions, **changes) -> ImportOptions:
    """Options of a run started by hand: the quantity is bounded."""
    out = replace(options, **changes)
    if isinstance(out.quantity, int):
        out = replace(out, quantity=max(fixed.QUANTITY_MIN, min(fixed.QUANTITY_MAX, out.quantity)))
    return out
