"""Page functions, block search, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive as d
from checks.registry import check
from newsloom import fixed_values as fixed
from newsloom.functions import page as pg
from newsloom.functions.basics import byte_len, strip_all_tags, strip_tags
from newsloom.functions.html_tree import page_tree
from newsloom.functions.text import decode_entities
from newsloom.functions.urls import absolute_url, bare_host, resolve_url, url_host
from newsloom.operators import blocks
from newsloom.plans.extract import extract_pages, image_manifest, with_local_images

def headed(df):
    """Pages with the title taken out or moved to an og: tag, so every branch is met."""
    no_title = F.regexp_replace("html", "<title>[^<]*</title>", "")
    og = F.concat(F.lit('<meta property="og:title" content=" A &amp; B '), F.col("page_id").cast("string"),
                  F.lit(' &euro;&#233;&#x41;">'))
    title = F.regexp_extract("html", "<title>[^<]*</title>", 0)
    return df.withColumn(
        "html",
        F.when(F.contains("url", F.lit(".html")), no_title)
        .when(F.contains("url", F.lit("#top")), F.replace(F.col("html"), title, og)).otherwise(F.col("html")),
    )


@check("page_charset", """
SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'ISO-8859-1' WHEN url LIKE '%#top%' THEN 'UTF-8'
  ELSE upper(trim(regexp_extract(html, '(?i)<meta[^>]+charset=["'']?([^"''>]+)["'']?', 1))) END AS charset FROM pages""")
def page_charset(spark, folder):
    p = d.plain_pages(spark, folder)
    latin = F.replace(F.col("html"), F.lit('charset="utf-8"'), F.lit("charset=iso-8859-1 "))
    none = F.replace(F.col("html"), F.lit('charset="utf-8"'), F.lit('name="x"'))
    html = F.when(F.col("url").startswith("http://"), latin).when(F.contains("url", F.lit("#top")), none).otherwise(F.col("html"))
    return p.select("page_id", pg.page_charset(html).alias("charset"))


@check("page_title", rf"""
SELECT page_id, CASE
  WHEN url LIKE '%.html%' THEN upper(left(regexp_extract({d.path('url')}, '([^/]*)/*$', 1), 1)) || substr(regexp_extract({d.path('url')}, '([^/]*)/*$', 1), 2)
  WHEN url LIKE '%#top%' THEN 'A & B ' || page_id || ' €éA'
  ELSE {d.DECODED_TITLE} END AS title FROM pages""")
def page_title(spark, folder):
    return headed(d.plain_pages(spark, folder)).select("page_id", pg.page_title("html", "url").alias("title"))


@check("entity_decode", r"""
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&lt;', '<')) AS text_md5
FROM pages""")
def entity_decode(spark, folder):
    return d.plain_pages(spark, folder).select("page_id", F.md5(decode_entities("html")).alias("text_md5"))


@check("jsonld_body", """
SELECT page_id, CASE WHEN url LIKE 'http://%' THEN '<p>First ' || page_id || '</p>' || chr(10) || '<p>Second<br />' || chr(10) || 'line</p>' || chr(10) END AS body
FROM pages""")
def jsonld_body(spark, folder):
    script = F.when(
        F.col("url").startswith("http://"),
        F.concat(F.lit('<script type="application/ld+json">{"articleBody": "First '), F.col("page_id").cast("string"),
                 F.lit('\\n\\nSecond\\nline"}</script>')),
    ).when(F.contains("url", F.lit("#top")), '<script type="application/ld+json">{"name": "x"}</script>').otherwise("")
    return d.plain_pages(spark, folder).select("page_id", pg.jsonld_body(F.concat(script, F.col("html"))).alias("body"))


@check("featured_image", f"""
SELECT page_id, CASE WHEN url LIKE 'http://%' THEN '' ELSE {d.scheme('url')} || '://' || {d.host('url')} || '/i/' || page_id || '.png' END AS image FROM pages""")
def featured_image(spark, folder):
    og = F.concat(F.lit('<meta property="og:image" content="/i/'), F.col("page_id").cast("string"), F.lit('.png">'), F.col("html"))
    html = F.when(F.col("url").startswith("http://"), F.col("html")).otherwise(og)
    return d.plain_pages(spark, folder).select("page_id", pg.featured_image(html, F.col("url")).alias("image"))


_IMAGES = (
    "https://img.example/a.jpg?x=1", "//cdn.example/b.PNG", "/c/d.gif", "e.webp", "f.bmp", "/c/d.gif", "noext", "data:image/png;base64,AA",
)


def with_images(df):
    tags = "".join(f'<img alt="x" src="{u}">' for u in _IMAGES)
    return df.withColumn("html", F.concat(F.lit(tags), F.lit('<img src="/p'), F.col("page_id").cast("string"), F.lit('.jpg">'), F.col("html")))


@check("page_images", f"""
SELECT page_id, CAST(unnest(range(5)) AS BIGINT) AS position, unnest(['https://img.example/a.jpg?x=1', {d.scheme('url')} || '://cdn.example/b.PNG',
  {d.scheme('url')} || '://' || {d.host('url')} || '/c/d.gif', {d.scheme('url')} || '://' || {d.host('url')} || '/e.webp',
  {d.scheme('url')} || '://' || {d.host('url')} || '/p' || page_id || '.jpg']) AS image FROM pages""")
def page_images(spark, folder):
    p = with_images(d.plain_pages(spark, folder))
    return p.select("page_id", F.posexplode(pg.page_images("html", F.col("url"))).alias("position", "image")).select(
        "page_id", F.col("position").cast("long").alias("position"), "image"
    )


def _folder(u: str) -> str:
    p = f"regexp_replace(coalesce({d.path(u)}, '/'), '(.)/+$', '\\1')"
    return f"coalesce(nullif(regexp_replace({p}, '/+[^/]*$', ''), ''), '/')"


@check("image_manifest", f"""
SELECT page_id AS post_parent, position, image_url, file_name, mime_type, regexp_replace(file_name, '\\.[^.]+$', '') AS post_title
FROM (SELECT page_id, unnest([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8]) AS position,
  unnest(['https://img.example/a.jpg?x=1', {d.scheme('url')} || '://' || {d.host('url')} || '//cdn.example/b.PNG',
    {d.scheme('url')} || '://' || {d.host('url')} || '/c/d.gif', {d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/e.webp',
    {d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/f.bmp', {d.scheme('url')} || '://' || {d.host('url')} || '/c/d.gif',
    {d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/noext',
    {d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/data:image/png;base64,AA',
    {d.scheme('url')} || '://' || {d.host('url')} || '/p' || page_id || '.jpg']) AS image_url,
  unnest(['a.jpg', 'b.PNG', 'd.gif', 'e.webp', 'f.bmp', 'd.gif',
    'image-' || md5({d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/noext') || '.jpg',
    'image-' || md5({d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/data:image/png;base64,AA') || '.jpg', 'p' || page_id || '.jpg']) AS file_name,
  unnest(['image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/bmp', 'image/gif', 'image/jpeg', 'image/jpeg', 'image/jpeg']) AS mime_type
  FROM pages)""")
def image_manifest_query(spark, folder):
    p = with_images(d.plain_pages(spark, folder))
    out = image_manifest(p, post_id="page_id", html="html", base="url")
    return out.select("post_parent", "position", "image_url", "file_name", "mime_type", "post_title")


_LOCAL = "'https://media.example/' || md5(page_id || '|{k}') || '-{file}'"


@check("post_images_html", f"""
SELECT page_id, md5('<img data-src="/lazy.jpg" class="wide wp-image-' || md5(page_id || '|0') || '" src="' || {_LOCAL.format(k=0, file='a.jpg')} || '">'
  || '<IMG class="wp-image-' || md5(page_id || '|1') || '" alt="src=x" src="' || {_LOCAL.format(k=1, file='b.png')} || '" class2=y/>'
  || '<img src="/c.unknown" class="k"><img alt="no address">' || html
  || '<img src="' || {_LOCAL.format(k=3, file="' || 'p' || page_id || '.gif")} || '" class="x y wp-image-' || md5(page_id || '|3') || '">') AS html_md5 FROM pages""")
def post_images_html(spark, folder):
    """Quoted, unquoted and lazy addresses, with and without a class; what is no attachment stays."""
    head = ('<img data-src="/lazy.jpg" class="wide" src="/i/a.jpg"><IMG alt="src=x" src=b.png class2=y/>'
            '<img src="/c.unknown" class="k"><img alt="no address">')
    html = F.concat(F.lit(head), F.col("html"), F.lit("<img src='/p"), F.col("page_id").cast("string"), F.lit(".gif' class=\"x y\">"))
    pages = d.plain_pages(spark, folder).withColumn("html", html)
    return with_local_images(pages, "https://media.example/", "page_id", "html", "url").select("page_id", F.md5("html").alias("html_md5"))


@check("page_meta", """
SELECT page_id, CASE WHEN url LIKE 'http://%' THEN 'About ' || page_id END AS description, CAST(CASE WHEN url LIKE 'http://%' THEN 1 ELSE 0 END AS BIGINT) AS entries FROM pages""")
def page_meta(spark, folder):
    tag = F.concat(F.lit('<meta name="description" content="About '), F.col("page_id").cast("string"), F.lit('">'), F.col("html"))
    html = F.when(F.col("url").startswith("http://"), tag).otherwise(F.col("html"))
    p = d.plain_pages(spark, folder).select("page_id", pg.page_metadata(html).alias("m"))
    return p.select("page_id", F.col("m")["description"].alias("description"), F.size("m").cast("long").alias("entries"))


_RELATIVE = ("HTTPS://a.example/x", "//b.example/y", "/z", "w/v.html", "?q=1")


def _links(df):
    links = F.array(*[F.lit(u) for u in _RELATIVE], F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return df.select("page_id", "url", F.posexplode(links).alias("position", "link"))


_LINKS = "(SELECT page_id, url, unnest(range(6)) AS position, unnest([" + ", ".join(f"'{u}'" for u in _RELATIVE) + ", 'p' || page_id]) AS link FROM pages)"


@check("abs_url", f"""
SELECT page_id, CAST(position AS BIGINT) AS position, CASE WHEN lower(link) LIKE 'http%' THEN link WHEN link LIKE '//%' THEN {d.scheme('url')} || ':' || link
  WHEN link LIKE '/%' THEN {d.scheme('url')} || '://' || {d.host('url')} || link
  ELSE {d.scheme('url')} || '://' || {d.host('url')} || '/' || link END AS absolute FROM {_LINKS}""")
def abs_url(spark, folder):
    return _links(d.plain_pages(spark, folder)).select(
        "page_id", F.col("position").cast("long").alias("position"), absolute_url("link", F.col("url")).alias("absolute"))


@check("resolve_url", f"""
SELECT page_id, CAST(position AS BIGINT) AS position, CASE WHEN link LIKE '/%' THEN {d.scheme('url')} || '://' || {d.host('url')} || link
  ELSE {d.scheme('url')} || '://' || {d.host('url')} || {_folder('url')} || '/' || link END AS resolved FROM {_LINKS}""")
def resolve(spark, folder):
    return _links(d.plain_pages(spark, folder)).select(
        "page_id", F.col("position").cast("long").alias("position"), resolve_url("link", F.col("url")).alias("resolved"))


@check("url_host", f"SELECT page_id, {d.host('url')} AS host, replace({d.host('url')}, 'www.', '') AS bare_host FROM pages")
def hosts(spark, folder):
    return d.plain_pages(spark, folder).select("page_id", url_host("url").alias("host"), bare_host("url").alias("bare_host"))


@check("strip_tags", f"""
SELECT page_id, strlen({d.strip('html')}) AS bytes, md5({d.strip('html')}) AS text_md5, md5({d.strip_all('html')}) AS all_md5 FROM pages""")
def strip_query(spark, folder):
    return d.plain_pages(spark, folder).select(
        "page_id", byte_len(strip_tags("html")).alias("bytes"), F.md5(strip_tags("html")).alias("text_md5"),
        F.md5(strip_all_tags("html")).alias("all_md5"))


@check("clean_attrs", r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(
  replace(html, '<p>', '<p style="color:red" onclick=''go()'' title="t">'), '(?i)\s+style=["''][^"'']*["'']', '', 'g'),
  '(?i)\s+on[a-z]+=["''][^"'']*["'']', '', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def clean_attrs(spark, folder):
    html = F.replace(F.col("html"), F.lit("<p>"), F.lit("<p style=\"color:red\" onclick='go()' title=\"t\">"))
    return d.plain_pages(spark, folder).select("page_id", F.md5(pg.clean_attributes(html)).alias("text_md5"))


@check("page_nodes", """
SELECT page_id, count(*) AS nodes, sum(CASE WHEN t = '<p' THEN 1 ELSE 0 END)::BIGINT AS paragraphs, sum(CASE WHEN t = '<a' THEN 1 ELSE 0 END)::BIGINT AS links
FROM (SELECT page_id, unnest(regexp_extract_all(replace(html, 'var t="</p>"', ''), '<[a-z][a-z0-9]*', 0)) AS t FROM pages) GROUP BY page_id""")
def page_nodes(spark, folder):
    nodes = blocks.page_nodes(d.pages(spark, folder))
    return nodes.groupBy("page_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("tag") == "p").cast("long").alias("paragraphs"),
        F.count_if(F.col("tag") == "a").cast("long").alias("links"))


def _trees(spark, folder):
    p = d.varied(d.pages(spark, folder))
    return p.select("page_id", "url", page_tree("html").alias("tree")).select("page_id", "url", "tree.*")


_AD = r"""regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1)"""
_AD_BYTES = f"strlen({d.trim(_AD)})"
_TWO_BLOCKS = f"""(SELECT page_id, 'div' AS tag, 'ad' AS cls, {_AD_BYTES} AS text_bytes, CAST(0 AS BIGINT) AS p_count, CAST(0 AS BIGINT) AS headings FROM pages
  UNION ALL SELECT page_id, tag, CASE WHEN tag = 'div' THEN 'story' ELSE '' END, text_bytes, p_count, CAST(1 AS BIGINT) FROM {d.BLOCKS})"""


@check("block_metrics", f"""
SELECT page_id, tag, cls, text_bytes, p_count, CAST(0 AS BIGINT) AS link_bytes, CAST(0 AS DOUBLE) AS link_density FROM {_TWO_BLOCKS}""")
def block_metrics(spark, folder):
    rows = _trees(spark, folder).select("page_id", F.inline(blocks.block_metrics("nodes")))
    return rows.select("page_id", "tag", "cls", "text_bytes", "p_count", "link_bytes", "link_density")


@check("block_score", f"""
SELECT page_id, tag, cls, CASE WHEN text_bytes < 100 THEN CAST(0 AS DOUBLE)
  ELSE text_bytes / 100 + p_count * 10 - CASE WHEN cls = 'ad' THEN 100 ELSE 0 END END AS score FROM {_TWO_BLOCKS}""")
def block_score(spark, folder):
    rows = _trees(spark, folder).select("page_id", F.explode(blocks.block_metrics("nodes")).alias("b"))
    return rows.select("page_id", "b.tag", "b.cls", blocks.block_score("b").alias("score"))


@check("block_score_documented", f"""
SELECT page_id, tag, cls, CASE WHEN text_bytes < 100 THEN CAST(0 AS DOUBLE)
  ELSE text_bytes / 100 + p_count * 10 + headings * 5 - CASE WHEN p_count > 0 AND words < p_count * 20 THEN 30 ELSE 0 END
   + CASE WHEN tag = 'article' THEN 30 ELSE 0 END - CASE WHEN cls = 'ad' THEN 100 ELSE 0 END END AS score
FROM (SELECT t.*, CASE WHEN t.cls = 'ad' THEN 0 ELSE
    len(list_filter(regexp_split_to_array({d._DECODE.format(x=d.strip(d._INNER))}, '\\s+'), lambda w: w <> '')) END AS words
  FROM {_TWO_BLOCKS} t JOIN {d.VARIED} p ON t.page_id = p.page_id)""")
def block_score_documented(spark, folder):
    rows = _trees(spark, folder).select("page_id", F.explode(blocks.block_metrics("nodes")).alias("b"))
    return rows.select("page_id", "b.tag", "b.cls", blocks.block_score("b", "documented").alias("score"))


@check("best_block", f"SELECT page_id, text_bytes, CAST(score AS DOUBLE) AS score FROM {d.BLOCKS} WHERE score > 10")
def best_block(spark, folder):
    rows = _trees(spark, folder).select("page_id", blocks.best_block("nodes").alias("b")).where(F.col("b").isNotNull())
    return rows.select("page_id", F.col("b.text_bytes").alias("text_bytes"), (-F.col("b.minus_score")).alias("score"))


@check("selector_block", f"SELECT page_id, CAST(0 AS BIGINT) AS rank, text_bytes FROM {d.BLOCKS} WHERE by_selector")
def selector_block(spark, folder):
    rows = _trees(spark, folder).select("page_id", blocks.selector_block("nodes").alias("b")).where(F.col("b").isNotNull())
    return rows.select("page_id", F.col("b.rank").cast("long").alias("rank"), F.col("b.text_bytes").alias("text_bytes"))


# a share bar, a nav and an odd id inside the article must go; text around them stays
_JUNK = ('<div class="my-share-buttons x"><a href="/s">Share</a><div class="menu">m</div></div>', "<nav>n</nav>", '<p id="the-pagination">1</p>')


@check("clean_nodes", rf"""
SELECT page_id, md5(trim(regexp_replace('<article>' || regexp_replace(regexp_extract(html, '(?is)<article>(.*?)</article>', 1),
  '(<br>\s*)(<p>|\z)', '\1</b></p>\2', 'g') || '</article>', '\s+', ' ', 'g'))) AS content_md5 FROM pages""")
def clean_nodes(spark, folder):
    p = d.pages(spark, folder)
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit("<article>" + _JUNK[0]))
    html = F.replace(html, F.lit("</h1>"), F.lit("</h1>" + _JUNK[1]))
    html = F.replace(html, F.lit("</article>"), F.lit(_JUNK[2] + "</article>"))
    tree = p.select("page_id", page_tree(html).alias("tree")).select("page_id", "tree.*")
    article = F.get(F.filter("nodes", lambda n: n["tag"] == "article"), F.lit(0))
    tree = tree.withColumn("block", article)
    return tree.select("page_id", F.md5(blocks.clean_block("markup", "nodes", "block")).alias("content_md5"))


@check("page_extract", f"""
SELECT page_id, url NOT LIKE '%?page=%' AS success, origin, CASE WHEN url LIKE '%?page=%' THEN '' ELSE {d.DECODED_TITLE} END AS title,
  md5(content) AS content_md5, '' AS featured_image, CAST(0 AS BIGINT) AS images,
  CASE WHEN url LIKE '%?page=%' THEN '{fixed.NO_PAGE_ERROR}' END AS error
FROM (SELECT page_id, url, html, CASE WHEN url LIKE '%?page=%' THEN '' ELSE content END AS content,
  CASE WHEN url LIKE '%?page=%' THEN 'none' ELSE origin END AS origin FROM {d.BLOCKS})""")
def page_extract(spark, folder):
    p = d.varied(d.pages(spark, folder))
    p = p.withColumn("html", F.when(~F.contains("url", F.lit("?page=")), F.col("html")))
    out = extract_pages(p, keep=("page_id",))
    return out.select(
        "page_id", "success", "origin", "title", F.md5("content").alias("content_md5"), "featured_image",
        F.size("images").cast("long").alias("images"), "error")
