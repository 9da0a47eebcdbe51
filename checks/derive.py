"""Inputs that Spark derives from the given tables, each with its SQL twin.

The tables hold pages, documents and events but no feeds, posts or schedules;
those are made from all rows of the tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.basics import byte_len
from newsloom.functions.urls import url_host
from newsloom.sources.pages import read_pages

NOW = "2024-01-15 10:00:00"
SOURCES = [("example.com", "Example"), ("www.example.org", "Example Org")]

# --- SQL fragments ---------------------------------------------------------

HOST = r"nullif(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)', 1), '')"
PATH = r"nullif(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '')"
SCHEME = r"nullif(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1), '')"
RAW_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
TRIM = r"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"
TAG = r"(?s)<!--.*?-->|<(?:[^\s>][^>]*)?(?:>|\z)"
STRIP = "regexp_replace({x}, '" + TAG + "', '', 'g')"
STRIP_ALL = TRIM.format(x=STRIP.format(
    x="regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g'), "
      "'(?is)<style[^>]*>.*?</style>', '', 'g')"))


def host(u: str) -> str:
    return HOST.format(u=u)


def path(u: str) -> str:
    return PATH.format(u=u)


def scheme(u: str) -> str:
    return SCHEME.format(u=u)


def trim(x: str) -> str:
    return TRIM.format(x=x)


def strip(x: str) -> str:
    return STRIP.format(x=x)


def strip_all(x: str) -> str:
    return STRIP_ALL.format(x=x)


def words(x: str) -> str:
    return (f"CAST(len(regexp_extract_all(regexp_replace(regexp_replace({x}, '^[''\\-]', ''), '-\\z', ''), "
            f"'[A-Za-z''\\-]+', 0)) AS BIGINT)")


# --- tables ----------------------------------------------------------------

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet", "page_id", "url", "html")


def plain_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages for built-in expressions only; columns are pruned into the scan."""
    return table(spark, folder, "pages")


def varied(df: DataFrame) -> DataFrame:
    """Pages served by plain http have their article in a div, so scoring has to find it."""
    as_div = F.replace(
        F.replace(F.col("html"), F.lit("<article>"), F.lit('<div class="story">')), F.lit("</article>"), F.lit("</div>")
    )
    return df.withColumn("html", F.when(F.col("url").startswith("http://"), as_div).otherwise(F.col("html")))


VARIED = """(SELECT page_id, url, CASE WHEN url LIKE 'http://%'
  THEN replace(replace(html, '<article>', '<div class="story">'), '</article>', '</div>') ELSE html END AS html FROM pages)"""


def fetched(df: DataFrame) -> DataFrame:
    """The pages that could be fetched: addresses with a page number are missing."""
    return df.where(~F.contains(F.col("url"), F.lit("?page=")))


def items(df: DataFrame) -> DataFrame:
    """One feed item per page, the host as the feed.  ``df`` is the page table."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    kind = byte_len("html") % 4
    return df.select(
        F.lit(1).alias("feed_pos"),
        url_host("url").alias("feed"),
        F.concat(F.lit("Feed "), url_host("url")).alias("feed_title"),
        F.col("page_id").alias("seq"),
        F.col("url").alias("link"),
        title.alias("title"),
        F.when(kind == 0, "").when(kind == 1, title)
        .when(kind == 2, F.concat(F.lit("<p>"), F.repeat(F.concat(title, F.lit(" ")), F.lit(6)), F.lit("</p>")))
        .alias("content"),
        F.when(F.col("url").startswith("https://"), title).alias("description"),
        (F.lit(1704067200) + (F.col("page_id") * 7919) % 2592000).alias("pub_epoch"),
    )


ITEMS = f"""(SELECT 1 AS feed_pos, {host('url')} AS feed, 'Feed ' || {host('url')} AS feed_title, page_id AS seq, url AS link,
  {RAW_TITLE} AS title,
  CASE strlen(html) % 4 WHEN 0 THEN '' WHEN 1 THEN {RAW_TITLE}
    WHEN 2 THEN '<p>' || repeat({RAW_TITLE} || ' ', 6) || '</p>' END AS content,
  CASE WHEN url LIKE 'https://%' THEN {RAW_TITLE} END AS description,
  1704067200 + (page_id * 7919) % 2592000 AS pub_epoch FROM pages)"""


def with_mirror(df: DataFrame) -> DataFrame:
    """The items once more under one feed that carries them all and runs last."""
    copy = df.withColumn("feed", F.lit("mirror.example")).withColumn("feed_title", F.lit("Mirror"))
    return df.unionByName(copy.withColumn("feed_pos", F.lit(2)))


WITH_MIRROR = f"""(SELECT * FROM {ITEMS} UNION ALL
  SELECT 2 AS feed_pos, 'mirror.example' AS feed, 'Mirror' AS feed_title, seq, link, title, content, description, pub_epoch
  FROM {ITEMS})"""


def post_meta(df: DataFrame, prefix: str = "_newsloom_") -> DataFrame:
    """Metadata of the pages imported before: those reached through a feed link."""
    old = df.where(F.contains(F.col("url"), F.lit("utm_source=feed")))
    return old.select(
        F.md5("url").alias("post_id"),
        F.inline(F.array(*[
            F.struct(F.lit(prefix + name).alias("meta_key"), value.alias("meta_value"))
            for name, value in (("original_url", F.col("url")), ("imported", F.lit("1")), ("source_title", url_host("url")))
        ])),
    )


SEEN = "(SELECT url FROM pages WHERE url LIKE '%utm_source=feed%')"
TRUSTED = "({h} LIKE '%example.com%' OR {h} LIKE '%example.org%')"


def trusted(u: str) -> str:
    return TRUSTED.format(h=f"lower(replace({host(u)}, 'www.', ''))")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "domain string, name string")


# --- what a page's main block is, in SQL ------------------------------------

_INNER = r"""regexp_extract(html, '(?is)<(?:article|div class="story")>(.*?)</(?:article|div)>', 1)"""
_DECODE = r"""regexp_replace(replace({x}, '&quot;', '"'), '&amp;?', '&', 'g')"""
_OPEN = """CASE WHEN url LIKE 'http://%' THEN '<div class="story">' ELSE '<article>' END"""
_CLOSE = """CASE WHEN url LIKE 'http://%' THEN '</div>' ELSE '</article>' END"""

# page_id, url, html, tag, text_bytes, p_count, score, by_selector, content, origin
BLOCKS = rf"""(SELECT *,
  text_bytes > 500 AND tag = 'article' AS by_selector,
  CASE WHEN text_bytes < 100 THEN 0.0 ELSE text_bytes / 100 + p_count * 10 END AS score,
  CASE WHEN text_bytes > 500 AND tag = 'article' THEN 'selector'
       WHEN text_bytes >= 100 AND text_bytes / 100 + p_count * 10 > 10 THEN 'score' ELSE 'none' END AS origin,
  CASE WHEN (text_bytes > 500 AND tag = 'article') OR (text_bytes >= 100 AND text_bytes / 100 + p_count * 10 > 10)
       THEN trim(regexp_replace(opening || balanced || closing, '\s+', ' ', 'g')) ELSE '' END AS content
  FROM (SELECT page_id, url, html,
    CASE WHEN url LIKE 'http://%' THEN 'div' ELSE 'article' END AS tag,
    {_OPEN} AS opening, {_CLOSE} AS closing,
    strlen({trim(_DECODE.format(x=strip(_INNER)))}) AS text_bytes,
    len(regexp_extract_all({_INNER}, '<p>', 0)) AS p_count,
    regexp_replace({_INNER}, '(<br>\s*)(<p>|\z)', '\1</b></p>\2', 'g') AS balanced
    FROM {VARIED}))"""

DECODED_TITLE = "trim(replace(replace(" + RAW_TITLE + ", '&quot;', '\"'), '&amp;', '&'))"

# what an item would be posted with: seq, feed, ..., p_content (null = page missing), choice, chosen
CHOICES = f"""(SELECT i.*, b.content AS page_content, b.url IS NOT NULL AS page_found,
  CASE WHEN coalesce(strlen({strip('b.content')}), 0) > 500 THEN 'page'
       WHEN strlen({strip("coalesce(nullif(i.content, ''), i.description, '')")}) < 200 AND coalesce(b.content, '') <> ''
         THEN 'short_page'
       WHEN coalesce(i.content, '') <> '' THEN 'feed_content'
       WHEN coalesce(i.description, '') <> '' THEN 'feed_description' ELSE 'none' END AS choice,
  {DECODED_TITLE.replace('html', 'b.html')} AS page_title
  FROM {{items}} i LEFT JOIN (SELECT * FROM {BLOCKS} WHERE url NOT LIKE '%?page=%') b ON i.link = b.url)"""


def choices(source: str = ITEMS) -> str:
    return CHOICES.replace("{items}", source)


def newest(source: str, n: int | str, keys: str = "feed") -> str:
    return (f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY pub_epoch DESC, seq) AS rn FROM {source}) WHERE rn <= {n})")


def statuses(source: str, n: int | str, keys: str = "feed") -> str:
    """Status of every item of a run, first importable item per address wins."""
    return f"""(SELECT *, CASE WHEN dup OR NOT ok THEN 'skipped' WHEN before > 0 THEN 'skipped'
      WHEN choice <> 'none' THEN 'imported' ELSE 'failed' END AS status,
      CASE WHEN dup OR before > 0 AND ok THEN '' WHEN NOT ok THEN 'Fonte não confiável'
      WHEN choice = 'none' THEN 'Conteúdo não encontrado' ELSE '' END AS reason
    FROM (SELECT *, coalesce(sum(CASE WHEN NOT dup AND ok AND choice <> 'none' THEN 1 ELSE 0 END) OVER (
        PARTITION BY link ORDER BY feed_pos, feed, pub_epoch, -seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, link IN {SEEN} AS dup, {trusted('link')} AS ok FROM {choices(newest(source, n, keys))})))"""


# --- schedules from events ---------------------------------------------------

def feed_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a schedule in JSON, with a second entry that has no address."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    time = F.when(F.col("event_type") == "error", "25:00").otherwise(F.date_format("ts", "HH:mm"))
    last = (
        F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_type") == "signup", "garbage")
        .when(F.col("event_type") == "click", "2024-01-15 09:30:00")
        .when(F.col("event_type") == "error", "2024-01-14 09:30:00")
        .otherwise("")
    )
    has_id = F.when(F.col("event_type") == "view", "").otherwise(
        F.concat(F.lit('"id":"f'), F.col("event_id").cast("string"), F.lit('",'))
    )
    entry = F.concat(
        F.lit("{"), has_id,
        F.lit('"enabled":'), F.when(F.col("user_id") % 3 == 0, "false").otherwise("true"),
        F.lit(',"feed_url":" https://feed'), F.col("user_id").cast("string"), F.lit('.example/rss "'),
        F.lit(',"time":"'), time, F.lit('","quantity":'), k,
        F.lit(',"category":"'), (F.col("user_id") % 7).cast("string"),
        F.lit('","translate":"'), F.when(F.col("user_id") % 2 == 0, "1").otherwise(""),
        F.lit('","post_status":"'), F.when(F.col("event_type") == "view", "draft").otherwise(""),
        F.lit('","last_run":"'), last, F.lit('"}'),
    )
    return e.select(
        "event_id", F.concat(F.lit("["), entry, F.lit(',{"id":"none","feed_url":"","time":"10:00"}]')).alias("json")
    )


FEEDS = """(SELECT event_id, CAST(0 AS BIGINT) AS feed_pos,
  CASE WHEN event_type = 'view' THEN 'feed_' || md5('0| https://feed' || user_id || '.example/rss |' || strftime(ts, '%H:%M')
    || '|' || k || '|' || (user_id % 7) || '|draft') ELSE 'f' || event_id END AS id,
  user_id % 3 <> 0 AS enabled, 'https://feed' || user_id || '.example/rss' AS feed_url,
  CASE WHEN event_type = 'error' THEN '09:00' ELSE strftime(ts, '%H:%M') END AS time,
  CAST(greatest(1, least(20, k)) AS INTEGER) AS quantity, CAST(user_id % 7 AS INTEGER) AS category,
  user_id % 2 = 0 AS translate, CASE WHEN event_type = 'view' THEN 'draft' ELSE 'publish' END AS post_status,
  CASE event_type WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'signup' THEN 'garbage'
    WHEN 'click' THEN '2024-01-15 09:30:00' WHEN 'error' THEN '2024-01-14 09:30:00' ELSE '' END AS last_run
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

DUE = f"""(SELECT * FROM {FEEDS} WHERE enabled AND TIMESTAMP '{NOW}' >= CAST('2024-01-15 ' || time || ':00' AS TIMESTAMP)
  AND NOT coalesce(CAST(TRY_CAST(last_run AS TIMESTAMP) AS DATE) = DATE '2024-01-15', false))"""


# --- logs from events --------------------------------------------------------

def logs(spark: SparkSession, folder: str) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING")
        .when(F.col("event_type") == "signup", "SUCCESS").when(F.col("event_type") == "view", "INFO").otherwise("DEBUG")
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("time"), level.alias("level"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        F.col("props").alias("context"),
    )


LOGS = """(SELECT event_id AS id, ts AS time, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING'
  WHEN 'signup' THEN 'SUCCESS' WHEN 'view' THEN 'INFO' ELSE 'DEBUG' END AS level,
  event_type || ' by user ' || user_id AS message, props AS context FROM events)"""


# --- translation cache from documents -----------------------------------------

def cache(spark: SparkSession, folder: str) -> DataFrame:
    """Translations of the English documents, of ages from 0 to 59 days."""
    d = table(spark, folder, "documents").where(F.col("lang") == "en")
    age = F.make_dt_interval((F.col("n_chars") % 60).cast("int"))
    return d.select(
        F.md5(F.concat("text", F.lit("enpttext"))).alias("key"), F.concat(F.lit("[pt] "), F.col("text")).alias("value"),
        (F.lit(NOW).cast("timestamp_ntz") - age).alias("cached_at"),
    )


CACHE = f"""(SELECT md5(text || 'enpttext') AS key, '[pt] ' || text AS value,
  TIMESTAMP '{NOW}' - to_days(CAST(n_chars % 60 AS INTEGER)) AS cached_at FROM documents WHERE lang = 'en')"""
FRESH = f"(SELECT DISTINCT key, value FROM {CACHE} WHERE cached_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY)"
