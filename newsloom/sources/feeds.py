"""Feed documents in three dialects, read into one item table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fixed
from newsloom.functions.basics import as_col, first_match, is_blank, or_default
from newsloom.functions.dates import feed_date, moment
from newsloom.functions.urls import url_host

DIALECTS = ("rss", "atom", "rdf")

_ENCLOSURE = "array<struct<_url:string,_type:string>>"
_MEDIA = "array<struct<_url:string,_VALUE:string>>"
_RSS_ITEM = (
    "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, description string, "
    "`content:encoded` string, pubDate string, `dc:date` string, `dc:creator` array<string>, author string, "
    f"category array<struct<_VALUE:string,_domain:string>>, enclosure {_ENCLOSURE}, "
    f"`media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}"
)
_ATOM_ENTRY = (
    "title struct<_VALUE:string,_type:string>, link array<struct<_href:string,_rel:string,_type:string>>, id string, "
    "summary struct<_VALUE:string,_type:string>, content struct<_VALUE:string,_type:string>, "
    "updated string, published string, `dc:creator` array<string>, author array<struct<name:string>>, "
    "category array<struct<_term:string,_label:string>>, "
    f"`media:content` {_MEDIA}, `media:thumbnail` {_MEDIA}"
)
ITEM_SCHEMAS = {"rss": _RSS_ITEM, "atom": _ATOM_ENTRY, "rdf": _RSS_ITEM}
ROW_TAGS = {"rss": "item", "atom": "entry", "rdf": "item"}


# a whole document of any dialect: RSS has its items in the channel, RDF beside it, Atom has entries
_DOCUMENT_SCHEMA = (
    "channel struct<title:string, item:array<struct<{item}>>>, item array<struct<{item}>>, "
    "title struct<_VALUE:string,_type:string>, entry array<struct<{entry}>>, _corrupt_record string"
)


def _texts(value: Column) -> Column:
    """An array of strings without nulls, never null itself."""
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda v: v.isNotNull())


def _item_fields(get: Callable[[str], Column], atom: bool, rdf: Column) -> dict[str, Column]:
    """The common fields of an item; ``get`` gives a field of the dialect by name."""
    if atom:
        links = get("link")
        page_link = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        enclosed = F.transform(
            F.filter(links, lambda x: x["_rel"] == "enclosure"),
            lambda x: F.struct(x["_href"].alias("url"), x["_type"].alias("type")),
        )
        content, summary = get("content")["_VALUE"], get("summary")["_VALUE"]
        fields = dict(
            link=F.coalesce(F.get(page_link, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]),
            title=get("title")["_VALUE"],
            content=F.coalesce(content, summary),
            description=F.coalesce(summary, content),
            pub_date=F.coalesce(get("updated"), get("published")),
            enclosures=enclosed,
            author=F.get(get("author"), F.lit(0))["name"],
            categories=_texts(F.transform(get("category"), lambda c: F.coalesce(c["_label"], c["_term"]))),
        )
    else:
        guid = get("guid")
        permalink = F.when(F.coalesce(guid["_isPermaLink"], F.lit("true")) != "false", guid["_VALUE"])
        fields = dict(
            link=F.coalesce(get("link"), permalink),
            title=get("title"),
            content=F.coalesce(get("content:encoded"), get("description")),
            description=F.coalesce(get("description"), get("content:encoded")),
            pub_date=F.coalesce(F.when(rdf, get("dc:date")), get("pubDate"), get("dc:date")),
            enclosures=F.transform(
                get("enclosure"), lambda e: F.struct(e["_url"].alias("url"), e["_type"].alias("type"))
            ),
            author=get("author"),
            categories=_texts(F.transform(get("category"), lambda c: c["_VALUE"])),
        )
    fields["enclosures"] = F.coalesce(fields["enclosures"], F.array().cast("array<struct<url:string,type:string>>"))
    for name in ("link", "title", "pub_date"):
        fields[name] = F.trim(fields[name])
    return fields | dict(
        dc_creator=F.get(get("dc:creator"), F.lit(0)),
        media_content_url=F.get(get("media:content"), F.lit(0))["_url"],
        media_thumbnail_url=F.get(get("media:thumbnail"), F.lit(0))["_url"],
    )


def _with_time(items: DataFrame) -> DataFrame:
    """Add ``pub_epoch``, the seconds of a readable date."""
    return items.withColumn("pub_epoch", feed_date("pub_date").cast("long"))


def normalize_items(raw: DataFrame, dialect: str, *keep: str) -> DataFrame:
    """The columns of one dialect brought into the common item shape."""
    fields = _item_fields(lambda name: F.col(f"`{name}`"), dialect == "atom", F.lit(dialect == "rdf"))
    return _with_time(raw.select(*keep, *[value.alias(name) for name, value in fields.items()], F.lit(dialect).alias("dialect")))


def read_feed_items(spark: SparkSession, path: str, dialect: str, streaming: bool = False) -> DataFrame:
    """Items straight from feed files, split inside the files by row tag.

    The feed is named by its file; use ``parse_feed_documents`` to keep titles.
    """
    reader = (spark.readStream if streaming else spark.read).schema(
        T.StructType.fromDDL(ITEM_SCHEMAS[dialect])
    )
    raw = reader.format("xml").option("rowTag", ROW_TAGS[dialect]).load(path)
    return normalize_items(raw.withColumn("feed", F.input_file_name()), dialect, "feed")


# --- whole documents ---------------------------------------------------------

_ROOT = r"(?s)<(?:[\w\-]+:)?(rss|RSS|feed|RDF|rdf)[\s>]"
_ROOT_PREFIX = r"(?s)<([\w\-]+):(?:rss|RSS|feed)[\s>]"
_RDF_PREFIX = r"""(?s)xmlns:([\w\-]+)\s*=\s*["']http://purl\.org/rss/1\.0/["']"""
_FILE_NAME = r"([^/]+?)(?:\.(?:xml|rss|atom|rdf))?$"


def document_dialect(xml) -> Column:
    """``rss``, ``atom`` or ``rdf`` by the document's outermost element."""
    root = F.lower(first_match(xml, _ROOT))
    return F.when(root == "feed", "atom").when(root == "rdf", "rdf").when(root == "rss", "rss")


def without_own_prefix(xml, dialect: Column) -> Column:
    """The document with the prefix of its own vocabulary taken off its elements.

    That is the root's prefix (``<a:feed>``), or in RDF the prefix that stands for RSS 1.0.  Prefixes of other
    vocabularies stay.
    """
    prefix = F.when(dialect == "rdf", first_match(xml, _RDF_PREFIX)).otherwise(first_match(xml, _ROOT_PREFIX))
    return F.when(prefix.isNull(), xml).otherwise(
        F.regexp_replace(xml, F.concat(F.lit("(</?)"), prefix, F.lit(r":(?=[\w\-])")), F.lit("$1")))


def parse_documents(documents: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("feed",)) -> DataFrame:
    """Every document parsed once: ``keep``, dialect, feed_title, ``items`` (array) and ``feed_error``.

    A document that cannot be read is a row with an error and no items; one without items is no error.
    """
    marked = documents.select(*keep, F.col(xml).alias("_xml"), document_dialect(F.col(xml)).alias("dialect"))
    schema = _DOCUMENT_SCHEMA.format(item=_colons(ITEM_SCHEMAS["rss"]), entry=_colons(ITEM_SCHEMAS["atom"]))
    parsed = marked.select(*keep, "dialect", "_xml", F.when(F.col("dialect").isNotNull(), F.from_xml(
        without_own_prefix(F.col("_xml"), F.col("dialect")), schema, {"ignoreNamespace": "false", "mode": "PERMISSIVE"}
    )).alias("_doc"))
    doc, dialect = F.col("_doc"), F.col("dialect")

    def items(value: Column, atom: bool) -> Column:
        return F.transform(value, lambda x: F.struct(
            *[field.alias(name) for name, field in _item_fields(lambda name: x[name], atom, dialect == "rdf").items()]
        ))

    rss = F.when(dialect == "rss", doc["channel"]["item"]).otherwise(doc["item"])
    error = (
        F.when(is_blank(F.trim("_xml")), "empty document")
        .when(dialect.isNull(), "unknown dialect")
        .when(doc.isNull() | doc["_corrupt_record"].isNotNull(), "malformed XML")
    )
    return parsed.select(
        *keep, "dialect", F.when(dialect == "atom", doc["title"]["_VALUE"]).otherwise(doc["channel"]["title"]).alias("feed_title"),
        F.when(error.isNull(), F.when(dialect == "atom", items(doc["entry"], True)).otherwise(items(rss, False))).alias("items"),
        error.alias("feed_error"),
    )


def parsed_items(parsed: DataFrame, keep: tuple[str, ...] = ("feed",)) -> DataFrame:
    """One row per item of parsed documents; ``seq`` is the place in the feed."""
    # the outer form, for Spark would filter by the array's size before a plain one and so parse every document again
    rows = parsed.select(*keep, "feed_title", "dialect", F.posexplode_outer("items").alias("seq", "item")).where("seq IS NOT NULL")
    return _with_time(rows.select(*keep, "feed_title", F.col("seq").cast("long").alias("seq"), "item.*", "dialect"))


def parse_feed_documents(
    documents: DataFrame, dialect: str, xml: str = "xml", keep: tuple[str, ...] = ("feed",)
) -> DataFrame:
    """The items of the documents of one dialect."""
    return parsed_items(parse_documents(documents, xml, keep).where(F.col("dialect") == dialect), keep)


def _colons(ddl: str) -> str:
    """Top-level columns as struct fields: the name is followed by a colon."""
    fields = T.StructType.fromDDL(ddl).fields
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)


def file_feed(path) -> Column:
    """The feed a file was fetched from: its name if that is a percent-encoded address, else its path."""
    decoded = F.try_url_decode(F.replace(as_col(path), F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(decoded, _FILE_NAME, 1)
    address = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(name.rlike(r"(?i)^https?%3A"), address).otherwise(as_col(path))


def read_feed_documents(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """One row per feed file: ``feed`` (see ``file_feed``), ``document`` (its path) and the whole ``xml``.

    ``streaming``: files that arrive in the folder come as a stream; ``options`` are the reader's, such as
    ``maxFilesPerTrigger``.
    """
    reader = (spark.readStream if streaming else spark.read).format("text").options(wholetext=True, **options)
    files = reader.load(path).select(F.input_file_name().alias("document"), F.col("value").alias("xml"))
    return files.select(file_feed("document").alias("feed"), "document", "xml")


def feed_items(documents: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("feed",)) -> DataFrame:
    """Items of documents in any mix of dialects."""
    return parsed_items(parse_documents(documents, xml, keep), keep)


def failed_documents(documents: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ("feed",)) -> DataFrame:
    """``keep`` and ``feed_error`` of the documents that cannot be read.  The rows fit ``import_summary``'s ``feeds``."""
    return parse_documents(documents, xml, keep).where("feed_error IS NOT NULL").select(*keep, "feed_error")


# --- one item's derived fields --------------------------------------------

def item_image() -> Column:
    """Image enclosure, else media content, else thumbnail, else first image in the content."""
    pictures = F.filter(
        F.col("enclosures"), lambda e: ~is_blank(e["url"]) & F.contains(F.coalesce(e["type"], F.lit("")), F.lit("image"))
    )
    return F.coalesce(
        F.get(pictures, F.lit(0))["url"],
        F.col("media_content_url"),
        F.col("media_thumbnail_url"),
        first_match("content", fixed.IMG_SRC_PATTERN),
        F.lit(""),
    )


def item_creator() -> Column:
    return F.coalesce(F.col("dc_creator"), F.col("author"), F.lit(""))


def enrich_items(items: DataFrame) -> DataFrame:
    """Add ``featured_image`` and ``creator`` and make ``categories`` distinct."""
    return items.select(
        *[c for c in items.columns if c not in ("featured_image", "creator", "categories")],
        item_image().alias("featured_image"),
        item_creator().alias("creator"),
        F.array_distinct("categories").alias("categories"),
    )


# --- per feed --------------------------------------------------------------

def analyze_feeds(items: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Per feed: item count, date text of the first item, host and title.

    ``feeds(feed, feed_url, feed_title)`` adds feeds without items.  Only one
    small record per feed and map task is shuffled.
    """
    per_feed = items.groupBy("feed").agg(
        F.count("*").alias("item_count"),
        F.min_by("pub_date", "seq").alias("_first_date"),
        F.max("feed_title").alias("_title"),
        F.max("feed_url").alias("_url"),
    )
    if feeds is not None:
        known = feeds.select("feed", F.col("feed_url").alias("_known_url"), F.col("feed_title").alias("_known_title"))
        per_feed = known.join(per_feed, "feed", "left")
        url, title = F.coalesce("_known_url", "_url"), F.coalesce("_known_title", "_title")
    else:
        url, title = F.col("_url"), F.col("_title")
    return per_feed.select(
        "feed",
        F.lit(True).alias("valid"),
        F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"),
        or_default(F.col("_first_date"), fixed.UNKNOWN_UPDATE).alias("last_update"),
        feed_date(F.col("_first_date")).alias("last_update_ts"),
        url_host(url).alias("domain"),
        or_default(title, fixed.UNTITLED_FEED).alias("feed_title"),
    )


def analyze_documents(parsed: DataFrame, keep: tuple[str, ...] = ("feed",), feed_url: str = "feed") -> DataFrame:
    """One row per parsed document: valid or not and why, item count, date text of the first item, host and title.

    Nothing is shuffled: a document's items are in its row.
    """
    first_date = F.get(F.col("items"), F.lit(0))["pub_date"]
    valid = F.col("feed_error").isNull()
    return parsed.select(
        *keep,
        valid.alias("valid"),
        F.coalesce(F.col("feed_error"), F.lit("")).alias("feed_error"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("item_count"),
        F.when(valid, or_default(first_date, fixed.UNKNOWN_UPDATE)).alias("last_update"),
        feed_date(first_date).alias("last_update_ts"),
        url_host(F.col(feed_url)).alias("domain"),
        F.when(valid, or_default("feed_title", fixed.UNTITLED_FEED)).alias("feed_title"),
    )


def save_analysis(rows: DataFrame, path: str, now) -> None:
    """Append an analysis to the kept ones, with its time."""
    rows.withColumn("analyzed_at", moment(now)).write.mode("append").parquet(path)


def last_analysis(analyses: DataFrame, feed: str = "feed") -> DataFrame:
    """The newest kept analysis of every feed."""
    row = F.struct(*[c for c in analyses.columns if c != feed])
    return analyses.groupBy(feed).agg(F.max_by(row, "analyzed_at").alias("_row")).select(feed, "_row.*")


def preview_feeds(items: DataFrame, samples: int = 5, date: str = "pub_epoch") -> DataFrame:
    """Per feed: item count and the newest few items as an array of (url, title, date).

    The samples are cut down before anything is gathered, so a feed's array
    never holds more than ``samples`` entries.
    """
    order = Window.partitionBy("feed").orderBy(F.col(date).desc_nulls_last(), F.col("seq").asc())
    few = items.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= samples)
    entry = F.struct(F.col("_rank").alias("rank"), F.col("url"), F.col("title"), F.col("pub_date").alias("date"))
    sample = few.groupBy("feed").agg(F.array_sort(F.collect_list(entry)).alias("sample"))
    counts = items.groupBy("feed").agg(F.count("*").cast("long").alias("item_count"))
    return counts.join(sample, "feed")
