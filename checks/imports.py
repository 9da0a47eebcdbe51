"""Feed items, selection, the import run and what it writes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import derive as d
from checks.registry import check
from newsloom import fixed_values as fixed
from newsloom.functions.text import contains_any_word
from newsloom.operators.selection import (
    imported_urls,
    item_pages,
    new_items,
    newest_per_feed,
    skipped_items,
    with_trust_flag,
)
from newsloom.plans import importer as im

N = 5
URL_KEY = "_newsloom_original_url"
OPTIONS = im.ImportOptions(quantity=N, post_status="publish", default_category=7)


def _items(spark, folder):
    return d.items(d.plain_pages(spark, folder))


def _run(spark, folder, items=None, options=OPTIONS):
    pages = d.fetched(d.varied(d.pages(spark, folder))).select("url", "html")
    return im.import_run(
        items if items is not None else _items(spark, folder), pages, d.post_meta(d.plain_pages(spark, folder)),
        d.sources(spark), d.NOW, options,
    )


_COUNTS = """CAST(count(*) FILTER (status = 'imported') AS BIGINT) AS imported,
  CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed"""


@check("import_summary", f"SELECT feed, {_COUNTS} FROM {d.statuses(d.ITEMS, N)} GROUP BY feed")
def import_summary(spark, folder):
    return _run(spark, folder).summary


@check("import_totals", f"SELECT feed, {_COUNTS} FROM {d.statuses(d.ITEMS, N)} GROUP BY ROLLUP (feed)")
def import_totals(spark, folder):
    return im.import_totals(_run(spark, folder).results)


@check("run_dedup", f"SELECT feed, seq, link, status, reason FROM {d.statuses(d.WITH_MIRROR, 20)}")
def run_dedup(spark, folder):
    """Every item comes again in one feed that holds half of all rows."""
    out = _run(spark, folder, d.with_mirror(_items(spark, folder)), replace(OPTIONS, quantity=20))
    return out.results.select("feed", "seq", "link", "status", "reason")


_TWICE = f"""(SELECT i.* EXCLUDE (feed_pos), s.* FROM {d.ITEMS} i,
  (VALUES (0, 2, 3, true, 'publish'), (1, 4, 0, false, 'pending')) s(feed_pos, quantity, category, translate, post_status))"""


@check("daily_import", f"""
SELECT CAST(feed_pos AS BIGINT) AS schedule_row, feed, seq, link, status, reason, CAST(quantity AS BIGINT) AS quantity,
  translate FROM {d.statuses(_TWICE, 'quantity', 'feed, feed_pos')}""")
def daily_import(spark, folder):
    """Every feed is scheduled twice, with different settings."""
    items = _items(spark, folder)
    settings = F.array(*[
        F.struct(F.lit(p).cast("long").alias("feed_pos"), F.lit(q).alias("quantity"), F.lit(c).alias("category"),
                 F.lit(t).alias("translate"), F.lit(s).alias("post_status"))
        for p, q, c, t, s in ((0, 2, 3, True, "publish"), (1, 4, 0, False, "pending"))
    ])
    feeds = items.select(F.col("feed").alias("feed_url")).distinct().select("feed_url", F.inline(settings))
    out = _run(spark, folder, im.daily_items(items, feeds), replace(im.DAILY, default_category=7))
    return out.results.select("schedule_row", "feed", "seq", "link", "status", "reason", F.col("quantity").cast("long").alias("quantity"), "translate")


@check("import_force", f"""
SELECT feed, seq, CASE WHEN NOT {d.trusted('link')} THEN 'skipped' WHEN choice <> 'none' THEN 'imported' ELSE 'failed' END AS status
FROM {d.choices(d.newest(d.WITH_MIRROR, N))}""")
def import_force(spark, folder):
    out = _run(spark, folder, d.with_mirror(_items(spark, folder)), replace(OPTIONS, mode="force"))
    return out.results.select("feed", "seq", "status")


_POST = f"""(SELECT md5(link || '|' || feed || '|' || seq || '|{d.NOW}') AS post_id, feed, feed_title, link,
  {d.strip_all("CASE WHEN choice = 'page' AND page_title <> '' THEN page_title ELSE title END")} AS post_title,
  CASE WHEN choice IN ('page', 'short_page') THEN page_content WHEN choice = 'feed_content' THEN content ELSE description END AS post_content
  FROM {d.statuses(d.ITEMS, N)} WHERE status = 'imported')"""


@check("posts_out", f"""
SELECT post_id, post_title, md5(post_content) AS content_md5, 'publish' AS post_status, CAST(1 AS BIGINT) AS post_author,
  'post' AS post_type, TIMESTAMP '{d.NOW}' AS post_date, TIMESTAMP '{d.NOW}' + INTERVAL 3 HOUR AS post_date_gmt, CAST(7 AS BIGINT) AS category, link AS url FROM {_POST}""")
def posts_out(spark, folder):
    out = _run(spark, folder, options=replace(OPTIONS, time_zone="America/Sao_Paulo"))
    return out.posts.select(
        "post_id", "post_title", F.md5("post_content").alias("content_md5"), "post_status", "post_author", "post_type",
        "post_date", "post_date_gmt", "category", "url")


_META = f"""(SELECT post_id, unnest(['_newsloom_original_url', '_newsloom_imported', '_newsloom_source_title']) AS meta_key,
  unnest([link, '1', feed_title]) AS meta_value FROM {_POST}
  UNION ALL SELECT post_id, unnest(['_yoast_wpseo_metadesc', 'rank_math_description', '_seopress_titles_desc', '_newsloom_meta_description']),
  'About ' || feed FROM {_POST} WHERE link LIKE 'https://%')"""


def _described(spark, folder):
    posts = _run(spark, folder).posts
    about = F.concat(F.lit("About "), F.col("feed"))
    return posts.withColumn("meta_description", F.when(F.col("url").startswith("https://"), about).otherwise(""))


@check("post_meta_out", f"SELECT * FROM {_META}")
def post_meta_out(spark, folder):
    return im.build_post_meta(_described(spark, folder))


@check("imported_total", "SELECT CAST(count(*) AS BIGINT) AS imported_total FROM pages WHERE url LIKE '%utm_source=feed%'")
def imported_total(spark, folder):
    meta = d.post_meta(d.plain_pages(spark, folder))
    return im.imported_total(meta.unionByName(meta))   # counted once per post, however often it is marked


@check("import_logs", f"""
SELECT 'WARNING' AS level, {d.strip_all("'Falha ao importar: ' || title || ' — " + fixed.NO_CONTENT_ERROR + "'")} AS message FROM {d.statuses(d.ITEMS, N)} WHERE status = 'failed'
UNION ALL SELECT 'INFO', 'Importação diária concluída: ' || count(*) FILTER (status = 'imported') || ' importados, ' ||
  count(*) FILTER (status = 'skipped') || ' pulados, ' || count(*) FILTER (status = 'failed') || ' falhas' FROM {d.statuses(d.ITEMS, N)}""")
def import_logs(spark, folder):
    return _run(spark, folder).logs.select("level", "message")


@check("daily_logs", f"""
SELECT 'INFO' AS level, '{fixed.RUN_STARTED_MESSAGE}' AS message
UNION ALL SELECT 'INFO', 'Processando feed agendado: ' || feed || ' (qtd: 2, traduzir: sim, categoria: 3)' FROM (SELECT DISTINCT feed FROM {d.ITEMS})
UNION ALL SELECT 'ERROR', 'Erro ao buscar feed: page ' || page_id FROM pages WHERE url LIKE '%/es/%'
UNION ALL SELECT 'WARNING', {d.strip_all("'Falha ao importar: ' || title || ' — " + fixed.NO_CONTENT_ERROR + "'")} FROM {d.statuses(d.ITEMS, N)} WHERE status = 'failed'
UNION ALL SELECT 'INFO', 'Importação diária concluída: ' || count(*) FILTER (status = 'imported') || ' importados, ' ||
  count(*) FILTER (status = 'skipped') || ' pulados, ' || count(*) FILTER (status = 'failed') || ' falhas' FROM {d.statuses(d.ITEMS, N)}""")
def daily_logs(spark, folder):
    """All lines of a run, with its schedule and the feeds that could not be read."""
    run = _run(spark, folder)
    feeds = _items(spark, folder).select(F.col("feed").alias("feed_url")).distinct().select(
        "feed_url", F.col("feed_url").alias("feed_pos"), F.lit(2).alias("quantity"), F.lit(True).alias("translate"), F.lit(3).alias("category"))
    run.scheduled = feeds
    run.failed_feeds = d.plain_pages(spark, folder).where(F.contains("url", F.lit("/es/"))).select(
        F.col("url").alias("feed"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("feed_error"))
    return run.daily_logs.select("level", "message")


@check("feed_top_n", f"SELECT feed, seq, link, pub_epoch FROM {d.newest(d.WITH_MIRROR, N)}")
def feed_top_n(spark, folder):
    items = d.with_mirror(_items(spark, folder)).select("feed", "seq", "link", "pub_epoch")
    return newest_per_feed(items, N)


@check("feed_newest_half", f"""
SELECT feed, seq, link, pub_epoch FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pub_epoch DESC, seq) AS rn,
  count(*) OVER (PARTITION BY feed) AS n FROM {d.WITH_MIRROR}) WHERE rn <= n // 2 OR n < 2""")
def feed_newest_half(spark, folder):
    """The newest half of every feed; one feed holds half of all rows."""
    items = d.with_mirror(_items(spark, folder)).select("feed", "seq", "link", "pub_epoch")
    half = items.groupBy("feed").agg(F.floor(F.count("*") / 2).alias("quantity"))   # a feed of one item: 0, which keeps all
    return newest_per_feed(items.join(half, "feed"), "quantity").select("feed", "seq", "link", "pub_epoch")


@check("new_items", f"SELECT feed, seq, link FROM {d.ITEMS} WHERE link NOT IN {d.SEEN}")
def new(spark, folder):
    seen = imported_urls(d.post_meta(d.plain_pages(spark, folder)), URL_KEY)
    return new_items(_items(spark, folder), seen).select("feed", "seq", "link")


@check("skipped_items", f"SELECT feed, seq, link FROM {d.ITEMS} WHERE link IN {d.SEEN}")
def skipped(spark, folder):
    seen = imported_urls(d.post_meta(d.plain_pages(spark, folder)), URL_KEY)
    return skipped_items(_items(spark, folder), seen).select("feed", "seq", "link")


_LISTED = f"(SELECT DISTINCT lower(replace(substr({d.host('url')}, 2), 'www.', '')) AS domain FROM pages WHERE page_id % 3 = 0 AND length({d.host('url')}) > 1)"


@check("trusted_items", f"""
SELECT feed, seq, link, contains(host, domain) AS by_part, host = domain OR ends_with(host, '.' || domain) AS by_suffix
FROM (SELECT feed, seq, link, lower(replace({d.host('link')}, 'www.', '')) AS host, NULL AS domain FROM {d.ITEMS}) WHERE false
UNION ALL SELECT feed, seq, link, EXISTS (SELECT 1 FROM {_LISTED} l WHERE contains(host, l.domain)),
  EXISTS (SELECT 1 FROM {_LISTED} l WHERE host = l.domain OR ends_with(host, '.' || l.domain))
FROM (SELECT feed, seq, link, lower(replace({d.host('link')}, 'www.', '')) AS host FROM {d.ITEMS})""")
def trusted(spark, folder):
    """Every third page's host, without its first letter, is a source: a list that grows with the pages."""
    listed = d.plain_pages(spark, folder).where("page_id % 3 = 0").select(F.expr("substr(parse_url(url, 'HOST'), 2)").alias("domain"))
    listed = listed.where("domain <> ''")
    items = _items(spark, folder).select("feed", "seq", "link")
    for match, name in (("contains", "by_part"), ("suffix", "by_suffix")):
        items = with_trust_flag(items, listed, match=match).withColumnRenamed("is_trusted", name)
    return items


@check("item_pages", f"""
SELECT i.feed, i.seq, p.page_id, md5(p.html) AS html_md5 FROM {d.WITH_MIRROR} i
LEFT JOIN (SELECT * FROM pages WHERE url NOT LIKE '%?page=%') p ON i.link = p.url""")
def pages_of_items(spark, folder):
    items = d.with_mirror(_items(spark, folder)).select("feed", "seq", "link")
    pages = d.fetched(d.plain_pages(spark, folder)).select("page_id", "url", F.md5("html").alias("html_md5"))
    return item_pages(items, pages).select("feed", "seq", "page_id", "html_md5")


@check("content_choice", f"""
SELECT seq, choice AS origin, CASE WHEN choice = 'page' AND page_title <> '' THEN page_title ELSE title END AS title,
  md5(CASE WHEN choice IN ('page', 'short_page') THEN page_content WHEN choice = 'feed_content' THEN content ELSE description END) AS content_md5
FROM {d.choices()} WHERE choice <> 'none'""")
def content_choice(spark, folder):
    items = _items(spark, folder).withColumns({
        "is_duplicate": F.lit(False), "is_trusted": F.lit(True), "run_key": F.col("link"), "run_order": F.lit(0)})
    pages = d.fetched(d.varied(d.pages(spark, folder))).select("url", "html")
    return im.choose_content(items, pages, OPTIONS).select("seq", "origin", "title", F.md5("content").alias("content_md5"))


@check("import_options", f"""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'force' ELSE 'normal' END AS mode, user_id % 2 = 0 AS translate, true AS set_featured,
  CASE WHEN event_type = 'click' THEN 'publish' ELSE 'draft' END AS post_status,
  CAST(CASE WHEN event_type = 'error' THEN 5 ELSE greatest(1, least(20, CAST(json_extract_string(props, '$.k') AS INTEGER))) END AS INTEGER) AS quantity,
  CASE WHEN event_type = 'signup' THEN 'https://f' || user_id || '.example/rss' ELSE 'https://main.example/rss' END AS feed_url FROM events""")
def import_options(spark, folder):
    e = d.table(spark, folder, "events")
    requests = e.select(
        "event_id", F.when(F.col("event_type") == "view", "force").alias("mode"),
        F.when(F.col("user_id") % 2 == 0, True).alias("translate"),
        F.lit(None).cast("boolean").alias("download_images"), F.lit(None).cast("boolean").alias("set_featured"),
        F.when(F.col("event_type") == "click", "publish").alias("post_status"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("int")).alias("quantity"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("https://f"), F.col("user_id").cast("string"), F.lit(".example/rss"))).alias("feed_url"),
    )
    out = im.with_default_options(requests, "https://main.example/rss")
    return out.select("event_id", "mode", "translate", "set_featured", "post_status", "quantity", "feed_url")


@check("credit_block", f"""
SELECT seq, md5('<div style="{fixed.CREDIT_STYLES['box']}"><p style="{fixed.CREDIT_STYLES['head']}">{fixed.CREDIT_LABEL}</p><p style="{fixed.CREDIT_STYLES['body']}"><strong>'
  || feed_title || '</strong><br><a href="' || replace(link, '&', '&amp;') || '" target="_blank" rel="nofollow noopener">' || replace(link, '&', '&amp;') || '</a></p></div>') AS block_md5
FROM {d.ITEMS}""")
def credit(spark, folder):
    return _items(spark, folder).select("seq", F.md5(im.credit_block(F.col("feed_title"), F.col("link"))).alias("block_md5"))


@check("keyword_filter", f"SELECT seq, title FROM {d.ITEMS} WHERE lower(title) LIKE '%there%' OR lower(title) LIKE '%das%'")
def keyword_filter(spark, folder):
    return _items(spark, folder).where(contains_any_word("title", ["There", "das"])).select("seq", "title")
