"""Which items are looked at: newest per feed, not imported yet, trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.basics import as_col
from newsloom.functions.urls import bare_host

# characters of the pieces by which hosts and domains meet
GRAM = 6


def newest_per_feed(
    items: DataFrame, quantity: int | str, max_quantity: int | None = None,
    feed: str | list[str] = "feed", date: str = "pub_epoch", seq: str = "seq",
) -> DataFrame:
    """The newest ``quantity`` items of each feed; 0 keeps all of them.

    ``quantity`` is a number or the name of a column that is constant per feed.  ``feed`` may name several
    columns: a feed that is scheduled twice is two feeds here.
    Every map task first keeps only its own newest items of each feed (Spark's
    window group limit), so a feed with most of the rows sends few of them on.
    For a column Spark needs to know a bound for that: ``max_quantity`` says
    that the column lies in 1..max_quantity, as schedules always do.  Without a bound whole spans of time are kept
    or dropped by their counts (``_newest_by_span``).
    """
    order = Window.partitionBy(feed).orderBy(F.col(date).desc_nulls_last(), F.col(seq).asc())
    rank = F.row_number().over(order)
    if isinstance(quantity, int):
        if quantity <= 0:
            return items
        return items.withColumn("_rank", rank).where(F.col("_rank") <= quantity).drop("_rank")
    if max_quantity is not None:
        ranked = items.withColumn("_rank", rank).where(F.col("_rank") <= max_quantity)
        return ranked.where(F.col("_rank") <= F.col(quantity)).drop("_rank")
    keys = [feed] if isinstance(feed, str) else list(feed)
    return _newest_by_span(items, quantity, keys, date, seq)


# items of a feed are counted by spans of so many seconds
SPAN = 3600
_NO_SPAN = -(1 << 62)


def _newest_by_span(items: DataFrame, quantity: str, feed: list[str], date: str, seq: str) -> DataFrame:
    """The newest ``quantity`` items of each feed, whatever the quantity; 0 and less keep all.

    Items are counted per feed and span of time.  Whole spans are kept or dropped by these counts, and only the one
    span in which a feed's quantity ends is ranked, so no task holds a feed.
    """
    span = F.coalesce(F.floor(F.col(date) / SPAN), F.lit(_NO_SPAN)).cast("long")   # items without a date come last
    wanted = F.coalesce(F.col(quantity), F.lit(0)).cast("long")
    counted = items.groupBy(*[F.col(c).alias(f"_{c}") for c in feed], span.alias("_span")).agg(F.count("*").alias("_n"), F.max(wanted).alias("_wanted"))
    newer = Window.partitionBy(*[f"_{c}" for c in feed]).orderBy(F.col("_span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_room", F.when(F.col("_wanted") <= 0, F.col("_n")).otherwise(F.col("_wanted") - F.coalesce(F.sum("_n").over(newer), F.lit(0))))
    spans = counted.where("_room > 0")
    same = span == F.col("_span")
    for c in feed:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = items.join(spans, same)
    rank = F.row_number().over(Window.partitionBy(*feed, "_span").orderBy(F.col(date).desc_nulls_last(), F.col(seq).asc()))
    cut = met.where("_room < _n").withColumn("_rank", rank).where("_rank <= _room").select(*items.columns)
    return met.where("_room >= _n").select(*items.columns).unionByName(cut)


def imported_urls(post_meta: DataFrame, url_key: str) -> DataFrame:
    """Distinct addresses already imported (one column, ``url``)."""
    return (
        post_meta.where((F.col("meta_key") == url_key) & F.col("meta_value").isNotNull())
        .select(F.col("meta_value").alias("url"))
        .distinct()
    )


def imported_among(post_meta: DataFrame, items: DataFrame, url_key: str, link: str = "link") -> DataFrame:
    """Those of the items' addresses that are already imported, each once.

    The history only grows while a run looks at few items: their addresses go to
    the history (broadcast when small), not the whole history through a shuffle.
    """
    asked = items.select(F.col(link).alias("_asked")).distinct()
    history = post_meta.where(F.col("meta_key") == url_key).select(F.col("meta_value").alias("url"))
    return history.join(asked, F.col("url") == F.col("_asked"), "left_semi").distinct()


def new_items(items: DataFrame, seen: DataFrame, link: str = "link") -> DataFrame:
    """Items whose address is not among ``seen(url)``."""
    return items.join(seen, items[link] == seen["url"], "left_anti")


def skipped_items(items: DataFrame, seen: DataFrame, link: str = "link") -> DataFrame:
    return items.join(seen, items[link] == seen["url"], "left_semi")


def with_duplicate_flag(items: DataFrame, seen: DataFrame, link: str = "link") -> DataFrame:
    """Add ``is_duplicate``; ``seen`` has each address once, so no row multiplies."""
    marks = seen.select(F.col("url").alias("_seen"))
    return (
        items.join(marks, items[link] == marks["_seen"], "left")
        .withColumn("is_duplicate", F.col("_seen").isNotNull())
        .drop("_seen")
    )


# --- trusted sources -------------------------------------------------------

def _source_domains(sources: DataFrame) -> DataFrame:
    """Domains without ``www.``, lower case, each once."""
    return sources.where(F.col("domain").isNotNull()).select(
        F.lower(F.replace(F.col("domain"), F.lit("www."), F.lit(""))).alias("domain")
    ).distinct()


def _grams(text: Column, length: Column) -> Column:
    """The distinct pieces of so many characters; empty where the text is shorter."""
    starts = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substr(text, i, length)))


def _rarest_grams(domains: DataFrame) -> DataFrame:
    """(domain, gram): of each domain the piece of GRAM characters that fewest domains have; short ones are their own."""
    own = F.least(F.lit(GRAM), F.length("domain"))
    grams = domains.where("domain <> ''").select("domain", F.explode(_grams(F.col("domain"), own)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "gram"))
    return grams.join(counts, "gram").groupBy("domain").agg(rarest.alias("_r")).select("domain", "_r.gram")


def trusted_hosts(hosts: DataFrame, sources: DataFrame, match: str = "contains") -> DataFrame:
    """Those of the distinct ``hosts(host)`` that contain a source domain (``match="suffix"``: end in it).

    A host that contains a domain contains the domain's rarest piece: hosts and domains meet by equal pieces, and
    what meets is verified.  This is one plan for lists of any length, and neither side comes to the driver.
    """
    if match not in ("contains", "suffix"):
        raise ValueError(f"unknown match: {match}")
    pieces = F.flatten(F.array(*[_grams(F.col("host"), F.lit(n)) for n in range(1, GRAM + 1)]))
    met = hosts.select("host", F.explode(pieces).alias("gram")).join(_rarest_grams(_source_domains(sources)), "gram")
    ends = (F.col("host") == F.col("domain")) | F.endswith("host", F.concat(F.lit("."), F.col("domain")))
    return met.where(F.contains("host", F.col("domain")) if match == "contains" else ends).select("host").distinct()


def with_trust_flag(items: DataFrame, sources: DataFrame, link: str = "link", match: str = "contains") -> DataFrame:
    """Add ``is_trusted``: the host contains a source domain (``match="suffix"``: ends in it).

    An empty list trusts everything; no host trusts nothing.  Hosts are tested once each and joined back.
    """
    no_list = _source_domains(sources).limit(1).agg(F.count("*")).scalar() == 0
    host = F.lower(bare_host(F.col(link)))
    hosts = items.select(host.alias("host")).where("host IS NOT NULL").distinct()
    trusted = trusted_hosts(hosts, sources, match).select(F.col("host").alias("_host"))
    return (
        items.withColumn("_item_host", host)
        .join(trusted, F.col("_item_host") == F.col("_host"), "left")
        .withColumn("is_trusted", F.col("_host").isNotNull() | no_list)
        .drop("_item_host", "_host")
    )


def trusted_items(items: DataFrame, sources: DataFrame, link: str = "link", match: str = "contains") -> DataFrame:
    return with_trust_flag(items, sources, link, match).where("is_trusted").drop("is_trusted")


def item_pages(items: DataFrame, pages: DataFrame, link: str = "link", wanted: Column | None = None) -> DataFrame:
    """Items with the columns of their page; items without one stay."""
    condition = as_col(link) == F.col("url")
    return items.join(pages, condition if wanted is None else condition & wanted, "left")
