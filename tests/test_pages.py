"""Tree, block choice, cleaning and the page record, on hand-made pages."""

import pytest

from newsloom.functions import page as pg
from newsloom.functions.html_tree import NODE_FIELDS, encode_page
from newsloom.functions.text import decode_entities, paragraphs_to_html
from newsloom.operators.blocks import main_content
from newsloom.plans.extract import extract_pages, image_manifest, with_local_images
from newsloom.sources.pages import decode_pages

NAMES = [n for n, _ in NODE_FIELDS]
LONG = "word " * 120   # 600 bytes


def tree(page):
    markup, rows = encode_page(page)
    return markup, [dict(zip(NAMES, r)) for r in rows]


def test_tree_closes_what_is_open():
    markup, nodes = tree("<div><p>a<b>b<p>c<ul><li>1<li>2</ul></div></i><br>x")
    assert markup == "<div><p>a<b>b</b></p><p>c</p><ul><li>1</li><li>2</li></ul></div><br>x"
    div = nodes[0]
    assert (div["pre"], div["post"], div["text_bytes"]) == (0, 6, 5)
    for n in nodes:
        assert markup[n["start"]:n["stop"]].startswith("<" + n["tag"])


def test_attributes_are_read_in_order():
    _, nodes = tree("""<div title="a class=evil" class="post-content" CLASS=late><p id=x>y</p></div>""")
    assert (nodes[0]["cls"], nodes[1]["id"]) == ("post-content", "x")


def test_deep_pages_are_measured_once():
    deep = 4000
    _, nodes = tree("<div> " * deep + "two w<b>o</b>rds " * 5000 + "</div>" * deep)
    assert nodes[0]["words"] == nodes[deep - 1]["words"] == 10000
    assert nodes[0]["text_bytes"] == len("two words " * 5000) - 1


def test_tree_text_and_attributes():
    _, nodes = tree("""<div class='a b' ID=x data-class="no"> &eacute;&amp; <script>if (a<b) "</div>"</script></div>""")
    div, script = nodes
    assert (div["cls"], div["id"]) == ("a b", "x")
    assert div["visible_bytes"] == 3 and div["text_bytes"] > 15
    assert script["hidden"] and not div["hidden"]


def test_tree_counters_are_for_the_subtree():
    _, nodes = tree("<div><p>1</p><div><p>2</p><a>link</a></div></div><p>3</p>")
    inner = [n for n in nodes if n["tag"] == "div"][1]
    assert nodes[inner["post"]]["p_run"] - inner["p_run"] == 1
    assert nodes[inner["post"]]["link_run"] - inner["link_run"] == 4


PAGES = {
    # the sample page of two short paragraphs: too short for anything
    "too_short": ("<html><body><div class='post-content'><h1>Título do Artigo</h1><p>Este é o conteúdo do artigo.</p></div></body></html>", "none", ""),
    "article": (f"<nav>n</nav><article><p>{LONG}</p></article>", "selector", f"<article><p>{LONG}</p></article>"),
    "main_before_class": (f"<div class='post-content'>{LONG}</div><main>{LONG}</main>", "selector", f"<main>{LONG}</main>"),
    "class_contains": (f"<div class='my-entry-content x'>{LONG}</div>", "selector", f"<div class='my-entry-content x'>{LONG}</div>"),
    "id_equals": (f"<div id='content2'>no</div><div id='content'>{LONG}</div>", "selector", f"<div id='content'>{LONG}</div>"),
    "second_article": (f"<article>short</article><article>{LONG}</article>", "selector", f"<article>{LONG}</article>"),
    "scored": (f"<div class='links'>{'<a>' + LONG + '</a>'}</div><section><p>{LONG}</p></section>", "score", f"<section><p>{LONG}</p></section>"),
    "tie_first": (f"<section id='s1'>{'y' * 1100}</section><section id='s2'>{'z' * 1100}</section>", "score", f"<section id='s1'>{'y' * 1100}</section>"),
    "sidebar_loses": (f"<div class='sidebar'><p>{LONG}</p></div><div class='q'><p>{'k ' * 60}</p></div>", "score", f"<div class='q'><p>{'k ' * 60}</p></div>"),
    "script_in_scored": (f"<section><p>{LONG}</p><script>x()</script><form>f</form></section>", "score", f"<section><p>{LONG}</p></section>"),
    "script_in_selector": (f"<article>{LONG}<script>x()</script></article>", "selector", f"<article>{LONG}<script>x()</script></article>"),
    "unwanted": (f"<article><div class='x share-buttons'><p>s</p><nav>q</nav></div><h1 style='a' onclick=\"b\">t</h1>{LONG}<aside>a</aside><p id='my-pagination'>1</p>z</article>",
                 "selector", f"<article><h1>t</h1>{LONG}z</article>"),
    "root_unwanted": (f"<article class='score'>{LONG}</article>", "selector", ""),
    "jsonld": ('<script type="application/ld+json">{"articleBody":"One\\n\\nTwo"}</script><article>' + LONG + "</article>", "jsonld", "<p>One</p>\n<p>Two</p>\n"),
    "jsonld_other": (f'<script type="application/ld+json">{{"name":1}}</script><article>{LONG}</article>', "selector", f"<article>{LONG}</article>"),
    "jsonld_broken": (f'<script type="application/ld+json">{{"art</script><article>{LONG}</article>', "selector", f"<article>{LONG}</article>"),
    "nothing": ("<p>loose</p>", "none", ""),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in PAGES.items()], "name string, html string")
    return {r["name"]: r for r in main_content(rows).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_main_content(found, name):
    _, origin, content = PAGES[name]
    assert found[name]["origin"] == origin
    expected = content if origin == "jsonld" else " ".join(content.split())
    assert found[name]["content"].replace("> ", ">").replace(" <", "<") == expected.replace("> ", ">").replace(" <", "<")


def test_extra_removals_and_threshold(spark):
    page = spark.createDataFrame([(f"<article><b class='promo-x'>no</b>{LONG}</article>", f"<div>{'a ' * 60}<p>b</p></div>")], "html string, low string")
    kept = main_content(page, extra_classes=("promo-x",)).first().content
    assert "no" not in kept.split()
    assert main_content(page, html="low", min_score=50).first().origin == "none"


def test_page_record(spark):
    html = ('<html><head><title> A &amp; B </title><meta property="og:image" content="/i.png"><meta name="description" content="D"></head>'
            f'<body><article><img src="//c.example/x.JPG"><img src="/y.gif?z"><img src="/y.gif?z"><img src="z.bmp">{LONG}</article></body></html>')
    rows = spark.createDataFrame([("https://s.example/a/b", html), ("https://s.example/gone", None), ("https://s.example/empty", "")], "url string, html string")
    out = {r.url.rsplit("/", 1)[1]: r for r in extract_pages(rows).collect()}
    b = out["b"]
    assert b.success and b.title == "A & B" and b.featured_image == "https://s.example/i.png" and b.metadata == {"description": "D"}
    assert b["images"] == ["https://c.example/x.JPG", "https://s.example/y.gif?z"]
    for gone in ("gone", "empty"):
        assert not out[gone].success and out[gone].content == "" and out[gone].error and out[gone]["images"] == [] and out[gone].metadata == {}


def test_titles_and_entities(spark):
    rows = spark.createDataFrame([
        ("https://s.example/my-long_title.html/", "<p>x"), ("https://s.example", "x"), ("https://s.example/0", "x"),
        ("https://s.example/q", "<meta property='og:title' content='O &#8364; &hellip; &bogus; &#x1F600;'>"),
    ], "url string, html string")
    titles = [r.t for r in rows.select(pg.page_title("html", "url").alias("t")).collect()]
    assert titles == ["My Long Title.html", "Artigo Importado", "Artigo Importado", "O € … &bogus; 😀"]
    odd = spark.createDataFrame([("&#0;&#xD800;&#1114112;&lt;&amp;lt;",)], "t string").select(decode_entities("t").alias("t")).first().t
    assert odd == "&#0;&#xD800;&#1114112;<&lt;"


def test_paragraphs(spark):
    out = spark.createDataFrame([("\n a\nb\n\n \n\nc \r\n",)], "t string").select(paragraphs_to_html("t").alias("t")).first().t
    assert out == "<p>a<br />\nb</p>\n<p>c</p>\n"


def test_charsets(spark):
    raw = [("<meta charset=%s>é" % c).encode(e) for c, e in (("utf-8", "utf-8"), ("'ISO-8859-1'", "latin-1"), ("windows-1252", "cp1252"), ("nonsense", "utf-8"))]
    out = decode_pages(spark.createDataFrame([(bytearray(r),) for r in raw], "content binary")).collect()
    assert [r.charset for r in out] == ["UTF-8", "ISO-8859-1", "WINDOWS-1252", "NONSENSE"]
    assert all(r["html"].endswith("é") for r in out)


def test_images_take_the_src_attribute_itself(spark):
    html = ("<img src='a.jpg' data-src='b.jpg'><img data-src=\"x.jpg\" alt='say src=\"y.jpg\"' src=c.png>"
            "<IMG class=wide SRC = \"d.gif\" /><img alt='none'>")
    rows = image_manifest(spark.createDataFrame([(1, "https://h.example/p/x.html", html)], "post_id long, url string, post_content string"))
    assert [r.image_url for r in rows.orderBy("position").collect()] == [f"https://h.example/p/{n}" for n in ("a.jpg", "c.png", "d.gif")]


def test_images_in_the_post_point_to_their_attachments(spark):
    html = ("<p>a</p><img src='a.jpg' data-src='b.jpg'><img data-src=\"x.jpg\" alt='say src=\"y.jpg\" class=no' src=c.png class=big>"
            "<IMG class=\"wide 2\" SRC = \"d.gif\" /><img alt='none'><img src=e.unknown><img src=cut.png")
    posts = spark.createDataFrame([(1, "https://h.example/p/x.html", html), (2, "https://h.example/", None), (3, "https://h.example/", "no image")],
                                  "post_id long, url string, post_content string")
    ids = {r.file_name: r.attachment_id for r in image_manifest(posts).collect()}
    out = {r.post_id: r.post_content for r in with_local_images(posts, "https://m.example/u").collect()}
    at = lambda n: f'"https://m.example/u/{ids[n]}-{n}"'
    assert out[1] == (f"<p>a</p><img class=\"wp-image-{ids['a.jpg']}\" src={at('a.jpg')} data-src='b.jpg'>"
                      f"<img data-src=\"x.jpg\" alt='say src=\"y.jpg\" class=no' src={at('c.png')} class=\"big wp-image-{ids['c.png']}\">"
                      f"<IMG class=\"wide 2 wp-image-{ids['d.gif']}\" SRC = {at('d.gif')} /><img alt='none'><img src=e.unknown><img src=cut.png")
    assert out[2] is None and out[3] == "no image"
