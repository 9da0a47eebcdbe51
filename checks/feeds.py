"""Feed documents in three dialects, item fields, analysis, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive as d
from checks.registry import check
from newsloom.functions.dates import feed_date, next_daily_run
from newsloom.functions.text import escape_html
from newsloom.functions.urls import url_host
from newsloom.operators import schedule
from newsloom.session import fresh_dir
from newsloom.sources import config
from newsloom.sources import feeds as fd


def _epoch(df):
    return df.withColumn("at", F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919) % 2592000))


def documents(df):
    """One small feed document per page: RSS for https, Atom for http with a fragment or html name, RDF else."""
    df = _epoch(df).withColumn("t", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    pid, title, link = F.col("page_id").cast("string"), escape_html(F.col("t")), escape_html(F.col("url"))
    kind = F.when(F.col("url").startswith("https://"), "rss").when(F.contains("url", F.lit("/en/")), "atom").otherwise("rdf")
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed '), pid,
        F.lit("</title><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>"),
        F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><dc:creator>Ann "), pid,
        F.lit('</dc:creator><category>news</category><category domain="x">p'), pid,
        F.lit('</category><category>news</category><enclosure url="https://m.example/a.mp3" type="audio/mpeg"/><enclosure url="https://m.example/'), pid,
        F.lit('.jpg" type="image/jpeg"/><description><![CDATA[<b>D</b> '), pid, F.lit("]]></description></item>"
              "<item><title>bare</title><link>https://bare.example/"), pid, F.lit("</link></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed '), pid, F.lit("</title><entry><title>"), title,
        F.lit('</title><link rel="alternate" href="'), link, F.lit('"/><updated>'),
        F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated><published>2001-01-01T00:00:00Z</published><author><name>Bob "), pid,
        F.lit('</name></author><category term="news"/><summary type="html">D '), pid, F.lit("</summary></entry></feed>"),
    )
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
              "<channel><title>Feed "), pid, F.lit("</title></channel><item><title>"), title, F.lit("</title><link>"), link,
        F.lit("</link><dc:date>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</dc:date><description>D "), pid,
        F.lit("</description></item></rdf:RDF>"),
    )
    return df.select(
        F.concat(F.lit("feed"), pid).alias("feed"), kind.alias("kind"),
        F.when(kind == "rss", rss).when(kind == "atom", atom).otherwise(rdf).alias("xml"),
    )


_AT = "to_timestamp(1704067200 + (page_id * 7919) % 2592000) AT TIME ZONE 'UTC'"
_RSS_DATE = f"strftime({_AT}, '%a, %d %b %Y %H:%M:%S') || ' +0000'"
_ISO_DATE = f"strftime({_AT}, '%Y-%m-%dT%H:%M:%S') || 'Z'"
_KIND = "CASE WHEN url LIKE 'https://%' THEN 'rss' WHEN url LIKE '%/en/%' THEN 'atom' ELSE 'rdf' END"
_MAIN = f"""(SELECT 'feed' || page_id AS feed, 'Feed ' || page_id AS feed_title, CAST(0 AS BIGINT) AS seq, url AS link, trim({d.RAW_TITLE}) AS title,
  CASE WHEN url LIKE 'https://%' THEN '<b>D</b> ' || page_id ELSE 'D ' || page_id END AS description,
  CASE WHEN url LIKE 'https://%' THEN {_RSS_DATE} ELSE {_ISO_DATE} END AS pub_date,
  CASE {_KIND} WHEN 'rss' THEN 'Ann ' || page_id WHEN 'atom' THEN 'Bob ' || page_id ELSE '' END AS creator, page_id, url, {_KIND} AS dialect FROM pages)"""
_COLUMNS = "feed, feed_title, seq, link, title, description, pub_date, dialect"
_BARE = ("SELECT 'feed' || page_id AS feed, 'Feed ' || page_id AS feed_title, CAST(1 AS BIGINT) AS seq, 'https://bare.example/' || page_id AS link, "
         "'bare' AS title, NULL AS description, NULL AS pub_date, 'rss' AS dialect FROM pages WHERE url LIKE 'https://%'")


def _docs(spark, folder):
    return documents(d.plain_pages(spark, folder))


def _shown(items):
    return items.select("feed", "feed_title", "seq", "link", "title", "description", "pub_date", "dialect")


def _dialect(spark, folder, dialect):
    docs = _docs(spark, folder)
    return _shown(fd.parse_feed_documents(docs.where(F.col("kind") == dialect), dialect))


@check("feed_items_rss", f"SELECT {_COLUMNS} FROM {_MAIN} WHERE dialect = 'rss' UNION ALL {_BARE}")
def feed_items_rss(spark, folder):
    return _dialect(spark, folder, "rss")


@check("feed_items_atom", f"SELECT {_COLUMNS} FROM {_MAIN} WHERE dialect = 'atom'")
def feed_items_atom(spark, folder):
    return _dialect(spark, folder, "atom")


@check("feed_items_rdf", f"SELECT {_COLUMNS} FROM {_MAIN} WHERE dialect = 'rdf'")
def feed_items_rdf(spark, folder):
    return _dialect(spark, folder, "rdf")


@check("feed_items", f"SELECT {_COLUMNS} FROM {_MAIN} UNION ALL {_BARE}")
def feed_items(spark, folder):
    return _shown(fd.feed_items(_docs(spark, folder)))


_ENRICHED = f"""(SELECT feed, seq, CASE WHEN dialect = 'rss' THEN 'https://m.example/' || page_id || '.jpg' ELSE '' END AS featured_image, creator,
  CASE dialect WHEN 'rss' THEN 'news,p' || page_id WHEN 'atom' THEN 'news' ELSE '' END AS categories, description FROM {_MAIN}
  UNION ALL SELECT 'feed' || page_id, 1, '', '', '', NULL FROM pages WHERE url LIKE 'https://%')"""


@check("item_enriched", f"SELECT * FROM {_ENRICHED}")
def item_enriched(spark, folder):
    rows = fd.enrich_items(fd.feed_items(_docs(spark, folder)))
    return rows.select("feed", "seq", "featured_image", "creator", F.array_join("categories", ",").alias("categories"), "description")


@check("item_categories", f"SELECT feed, seq, unnest(string_split(categories, ',')) AS category FROM {_ENRICHED} WHERE categories <> ''")
def item_categories(spark, folder):
    return fd.feed_items(_docs(spark, folder)).select("feed", "seq", F.explode(F.array_distinct("categories")).alias("category"))


def _picture(url):
    return F.concat(F.lit(f"https://{url}.example/"), F.col("page_id").cast("string"))


@check("item_image", """
SELECT page_id, CASE (page_id + strlen(html)) % 5 WHEN 0 THEN 'https://enc.example/' || page_id WHEN 1 THEN 'https://con.example/' || page_id
  WHEN 2 THEN 'https://thumb.example/' || page_id WHEN 3 THEN 'https://img.example/' || page_id ELSE '' END AS image FROM pages""")
def item_image(spark, folder):
    step = (F.col("page_id") + F.octet_length("html")) % 5
    rows = d.plain_pages(spark, folder).select(
        "page_id",
        F.when(step == 0, F.array(
            F.struct(F.lit("https://x.example/a.mp3").alias("url"), F.lit("audio/mpeg").alias("type")),
            F.struct(_picture("enc").alias("url"), F.lit("image/png").alias("type")),
        )).otherwise(F.array().cast("array<struct<url:string,type:string>>")).alias("enclosures"),
        F.when(step == 1, _picture("con")).alias("media_content_url"),
        F.when(step <= 2, _picture("thumb")).alias("media_thumbnail_url"),
        F.when(step <= 3, F.concat(F.lit("<p>x</p><IMG class='a' src='"), _picture("img"), F.lit("'>"))).otherwise("no image").alias("content"),
    )
    return rows.select("page_id", fd.item_image().alias("image"))


@check("feed_dates", f"SELECT feed, seq, {_AT} AS at FROM {_MAIN} UNION ALL SELECT feed, seq, NULL FROM ({_BARE})")
def feed_dates(spark, folder):
    items = fd.feed_items(_docs(spark, folder))
    return items.select("feed", "seq", feed_date("pub_date").cast("timestamp_ntz").alias("at"))


_BY_HOST = f"""(SELECT {d.host('url')} AS feed, page_id AS seq, url, {_RSS_DATE} AS pub_date, {d.RAW_TITLE} AS title,
  1704067200 + (page_id * 7919) % 2592000 AS pub_epoch FROM pages)"""


def _by_host(spark, folder):
    p = _epoch(d.plain_pages(spark, folder))
    return p.select(
        url_host("url").alias("feed"), F.col("page_id").alias("seq"), "url",
        F.concat(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pub_date"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        (F.lit(1704067200) + (F.col("page_id") * 7919) % 2592000).alias("pub_epoch"),
    )


@check("feed_analysis", f"""
SELECT feed, true AS valid, CAST(count(*) AS BIGINT) AS item_count, arg_min(pub_date, seq) AS last_update,
  to_timestamp(arg_min(pub_epoch, seq)) AT TIME ZONE 'UTC' AS last_update_ts, feed AS domain,
  CASE WHEN feed LIKE 'www.%' THEN 'Feed sem título' ELSE 'Title ' || feed END AS feed_title,
  'https://' || feed || '/rss' AS feed_url, TIMESTAMP '{d.NOW}' AS analyzed_at FROM {_BY_HOST} GROUP BY feed""")
def feed_analysis(spark, folder):
    """The analysis with its address and time, as it is kept in the history table."""
    items = _by_host(spark, folder)
    items = items.withColumn("feed_url", F.concat(F.lit("https://"), "feed", F.lit("/rss"))).withColumn(
        "feed_title", F.when(F.col("feed").startswith("www."), "").otherwise(F.concat(F.lit("Title "), "feed")))
    rows = fd.analyze_feeds(items)
    return rows.withColumn("last_update_ts", F.col("last_update_ts").cast("timestamp_ntz")).withColumn(
        "feed_url", F.concat(F.lit("https://"), "feed", F.lit("/rss"))).withColumn("analyzed_at", F.lit(d.NOW).cast("timestamp_ntz"))


def failing_documents(df):
    """The documents, some of them made unreadable by page number, and Atom ones with prefixed elements."""
    docs = documents(df).join(df.select(F.concat(F.lit("feed"), F.col("page_id").cast("string")).alias("feed"), (F.col("page_id") % 10).alias("kept_as")), "feed")
    prefixed = F.regexp_replace(F.replace("xml", F.lit("xmlns="), F.lit("xmlns:a=")), r"(</?)(\w)", "$1a:$2")
    kept_as = F.col("kept_as")
    xml = (F.when(kept_as == 0, F.replace("xml", F.lit("</title>"), F.lit("</titel>"))).when(kept_as == 1, "")
           .when(kept_as == 2, "<html><body>moved</body></html>").when((kept_as == 3) & (F.col("kind") == "atom"), prefixed).otherwise(F.col("xml")))
    return docs.select("feed", F.concat(F.col("feed"), F.lit(".xml")).alias("document"), xml.alias("xml"))


READABLE = "(page_id % 10) > 2"
FEED_ERROR = "CASE page_id % 10 WHEN 0 THEN 'malformed XML' WHEN 1 THEN 'empty document' WHEN 2 THEN 'unknown dialect' END"


@check("failed_documents", f"SELECT 'feed' || page_id AS feed, {FEED_ERROR} AS feed_error FROM pages WHERE NOT {READABLE}")
def failed_documents(spark, folder):
    return fd.failed_documents(failing_documents(d.plain_pages(spark, folder)))


@check("document_analysis", f"""
SELECT feed, {READABLE} AS valid, coalesce({FEED_ERROR}, '') AS feed_error,
  CAST(CASE WHEN NOT {READABLE} THEN 0 WHEN dialect = 'rss' THEN 2 ELSE 1 END AS BIGINT) AS item_count,
  CASE WHEN {READABLE} THEN pub_date END AS last_update, CASE WHEN {READABLE} THEN {_AT} END AS last_update_ts,
  CASE WHEN {READABLE} THEN feed_title END AS feed_title, 'h' || page_id || '.example' AS domain, TIMESTAMP '2024-01-15 10:00:00' AS analyzed_at FROM {_MAIN}""")
def document_analysis(spark, folder):
    """Analyses of readable and unreadable documents, kept and read back; the newer of two stays."""
    docs = failing_documents(d.plain_pages(spark, folder))
    docs = docs.withColumn("address", F.concat(F.lit("https://h"), F.substring("feed", 5, 20), F.lit(".example/rss")))
    rows = fd.analyze_documents(fd.parse_documents(docs, keep=("feed", "address")), ("feed",), "address")
    path = fresh_dir(spark, "analyses")
    fd.save_analysis(rows.withColumn("item_count", F.lit(-1).cast("long")), path, "2024-01-14 10:00:00")
    fd.save_analysis(rows, path, d.NOW)
    kept = fd.last_analysis(spark.read.parquet(path))
    return kept.withColumn("last_update_ts", F.col("last_update_ts").cast("timestamp_ntz"))


@check("feed_preview", f"""
SELECT feed, CAST(any_value(n) AS BIGINT) AS item_count, string_agg(url || ' ' || title || ' ' || pub_date, chr(10) ORDER BY rn) AS sample
FROM (SELECT *, count(*) OVER (PARTITION BY feed) AS n, row_number() OVER (PARTITION BY feed ORDER BY pub_epoch DESC, seq) AS rn FROM {_BY_HOST})
WHERE rn <= 3 GROUP BY feed""")
def feed_preview(spark, folder):
    return fd.preview_feeds(_by_host(spark, folder), 3).select(
        "feed", "item_count",
        F.array_join(F.transform("sample", lambda s: F.concat_ws(" ", s["url"], s["title"], s["date"])), "\n").alias("sample"))


# --- schedules -------------------------------------------------------------

_FEED_COLUMNS = "event_id, feed_pos, id, enabled, feed_url, time, quantity, category, translate, post_status, last_run"


def _feeds(spark, folder):
    return config.feed_config(d.feed_json(spark, folder), keep=("event_id",))


@check("feed_config", f"SELECT {_FEED_COLUMNS} FROM {d.FEEDS}")
def feed_config(spark, folder):
    return _feeds(spark, folder)


@check("trusted_sources", f"""
SELECT page_id, unnest([{d.host('url')}, 'b.example']) AS domain, unnest(['Site ' || page_id, 'B']) AS name FROM pages""")
def trusted_sources(spark, folder):
    host = url_host("url")
    text = F.concat(
        F.lit('[{"domain":"'), host, F.lit('","name":" Site '), F.col("page_id").cast("string"),
        F.lit('"},{"domain":"only.example"},{"name":"only"},{"domain":"b.example","name":"B","x":[1]}]'))
    return config.trusted_sources(d.plain_pages(spark, folder).select("page_id", text.alias("json")), keep=("page_id",))


@check("feeds_due", f"SELECT event_id, id, feed_url FROM {d.DUE}")
def feeds_due(spark, folder):
    return schedule.feeds_due(_feeds(spark, folder), d.NOW).select("event_id", "id", "feed_url")


@check("next_run", f"""
SELECT event_id, CASE WHEN run_at > TIMESTAMP '{d.NOW}' THEN run_at ELSE run_at + INTERVAL 1 DAY END AS next_run
FROM (SELECT event_id, CAST('2024-01-15 ' || time || ':00' AS TIMESTAMP) AS run_at FROM {d.FEEDS})""")
def next_run(spark, folder):
    return _feeds(spark, folder).select("event_id", next_daily_run(d.NOW, F.col("time")).alias("next_run"))


@check("feeds_marked", f"""
SELECT event_id, id, CASE WHEN event_id IN (SELECT event_id FROM {d.DUE}) THEN '{d.NOW}' ELSE last_run END AS last_run FROM {d.FEEDS}""")
def feeds_marked(spark, folder):
    feeds = _feeds(spark, folder).withColumn("id", F.concat_ws("/", "id", F.col("event_id").cast("string")))
    due = schedule.feeds_due(feeds, d.NOW)
    marked = schedule.mark_as_run(feeds, due, d.NOW)
    return marked.select("event_id", F.regexp_extract("id", "^(.*)/", 1).alias("id"), "last_run")


@check("feeds_effective", f"""
SELECT 'configured' AS schedule, id, feed_url, quantity, post_status, category FROM {d.DUE}
UNION ALL SELECT 'none', 'main', 'https://main' || page_id || '.example/rss', 1, 'publish', 4 FROM pages""")
def feeds_effective(spark, folder):
    """The main feed stands in only where nothing is configured; here one per page shows that."""
    main = d.plain_pages(spark, folder).select(
        F.concat(F.lit("https://main"), F.col("page_id").cast("string"), F.lit(".example/rss")).alias("feed_url"),
        F.lit(1).alias("quantity"), F.lit(False).alias("translate"), F.lit(4).alias("category"))
    feeds = _feeds(spark, folder).drop("event_id")
    found = [schedule.feeds_effective(some, main, d.NOW).withColumn("schedule", F.lit(name))
             for name, some in (("configured", feeds), ("none", feeds.where("feed_url = ''")))]
    return found[0].union(found[1]).select("schedule", "id", "feed_url", "quantity", "post_status", "category")
