"""Feed files, item fields, schedules."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions.dates import feed_date, next_daily_run
from newsloom.operators import schedule
from newsloom.sources import config
from newsloom.sources import feeds as fd


def test_documents_of_all_dialects(spark, data):
    docs = fd.read_feed_documents(spark, f"{data}/*.xml")
    rows = {r.link: r for r in fd.enrich_items(fd.feed_items(docs)).collect()}
    assert set(rows) == {"https://n.example/1", "https://n.example/2", "https://n.example/3", "https://a.example/1",
                         "https://a.example/2", "https://r.example/1", "https://r.example/2"}
    first = rows["https://n.example/1"]
    assert (first.feed_title, first.seq, first.creator, first.featured_image) == ("Two & Two", 0, "Ann", "https://n.example/a.jpg")
    assert first.categories == ["news", "world"] and first.content.startswith("<p>Body") and first.description == "short"
    assert rows["https://n.example/2"].featured_image == "https://n.example/m.png"
    assert (rows["https://n.example/3"].featured_image, rows["https://n.example/3"].creator) == ("", "")
    assert rows["https://a.example/1"].pub_date == "2024-02-01T08:00:00Z" and rows["https://a.example/1"].content == "<b>c</b>"
    assert rows["https://a.example/2"].pub_date == "2024-01-02T08:00:00+02:00"
    assert rows["https://a.example/1"].categories == ["Label"]
    assert rows["https://r.example/1"].pub_date == "2024-03-01T00:00:00Z"


def test_row_tag_reader_splits_inside_files(spark, data):
    for name, dialect, count in (("rss2", "rss", 3), ("atom", "atom", 2), ("rdf", "rdf", 2)):
        items = fd.read_feed_items(spark, f"{data}/{name}.xml", dialect)
        assert items.count() == count
        assert items.where(F.col("feed").endswith(f"{name}.xml")).count() == count


def test_analysis_and_preview(spark, data):
    items = fd.feed_items(fd.read_feed_documents(spark, f"{data}/*.xml")).withColumn("feed_url", F.lit("https://www.n.example/rss"))
    feeds = spark.createDataFrame([("none", "https://empty.example/f", "")], "feed string, feed_url string, feed_title string")
    out = {r.feed_title: r for r in fd.analyze_feeds(items).collect()}
    assert out["Two & Two"].item_count == 3 and out["Two & Two"].last_update == "Mon, 01 Jan 2024 10:00:00 +0100"
    assert out["Two & Two"].domain == "www.n.example" and out["Old style"].item_count == 2
    empty = fd.analyze_feeds(items, feeds).first()
    assert (empty.item_count, empty.last_update, empty.feed_title, empty.domain) == (0, "Desconhecido", "Feed sem título", "empty.example")


def test_dates(spark):
    texts = ["Mon, 01 Jan 2024 10:00:00 +0100", "1 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00-02:00", "soon", ""]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(feed_date("t").cast("string").alias("d")).collect()
    assert [r.d for r in out] == ["2024-01-01 09:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00", "2024-01-01 12:00:00", None, None]


CONFIG = """[{"id":"a","enabled":true,"feed_url":" https://a.example ","time":"25:00","quantity":99,"last_run":"2024-01-15 01:00:00"},
 {"enabled":1,"feed_url":"https://b.example","time":"09:30","quantity":"0x","category":"3","translate":"0"},
 {"id":"c","enabled":"","feed_url":"https://c.example"}, {"id":"d","feed_url":""},
 {"id":"e","enabled":true,"feed_url":"https://e.example","time":"10:00","last_run":"garbage"},
 {"id":"e","enabled":true,"feed_url":"https://e2.example","time":"10:01"}]"""


def test_feed_config_and_due(spark):
    table = spark.createDataFrame([(CONFIG,), ("not json",), ("",), (None,)], "json string")
    rows = config.feed_config(table)
    out = {r.feed_url: r for r in rows.collect()}
    assert list(out) == ["https://a.example", "https://b.example", "https://c.example", "https://e.example", "https://e2.example"]
    a, b = out["https://a.example"], out["https://b.example"]
    assert (a.time, a.quantity, a.category, a.translate, a.post_status) == ("09:00", 20, 0, False, "publish")
    assert (b.quantity, b.category, b.translate, b.id[:5], b.enabled) == (1, 3, False, "feed_", True)
    now = "2024-01-15 10:00:00"
    due = schedule.feeds_due(rows, now)
    assert sorted(r.feed_url for r in due.collect()) == ["https://b.example", "https://e.example"]
    marked = {r.feed_url: r.last_run for r in schedule.mark_as_run(rows, due, now).collect()}
    assert marked["https://e.example"] == now and marked["https://e2.example"] == "" and marked["https://a.example"] == "2024-01-15 01:00:00"


def test_main_feed_only_without_any_schedule(spark):
    main = spark.createDataFrame([("https://m.example", None, None, None)], "feed_url string, quantity int, translate boolean, category int")
    rows = config.feed_config(spark.createDataFrame([(CONFIG,)], "json string"))
    off = rows.where(~F.col("enabled"))
    assert schedule.feeds_effective(off, main, "2024-01-15 10:00:00").count() == 0
    alone = schedule.feeds_effective(rows.where("false"), main, "2024-01-15 10:00:00").collect()
    assert [(r.feed_url, r.quantity) for r in alone] == [("https://m.example", 1)]


def test_next_run(spark):
    row = spark.range(1).select(next_daily_run("2024-01-15 09:00:00", F.lit("09:00")).alias("a"), next_daily_run("2024-01-15 09:00:00", F.lit("09:01")).alias("b")).first()
    assert (row.a, row.b) == (dt.datetime(2024, 1, 16, 9), dt.datetime(2024, 1, 15, 9, 1))


def test_documents_that_cannot_be_read_are_named(spark):
    rss = "<rss><channel><title>T</title>{}</channel></rss>"
    docs = spark.createDataFrame([
        ("good", rss.format("<item><title>a</title><link>https://h.example/1</link></item>")), ("no items", rss.format("")),
        ("atom", '<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title>a</title></entry></feed>'),
        ("page", "<html><body>moved</body></html>"), ("broken", rss.format("<item><title>a</item>")),
        ("prefixed", '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>T</a:title><a:entry><a:title>p</a:title>'
                     '<a:link href="https://h.example/2"/></a:entry></a:feed>'),
        ("old", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:r="http://purl.org/rss/1.0/" xmlns:dc="d">'
                "<r:channel><r:title>O</r:title></r:channel><r:item><r:title>o</r:title><dc:date>2024-01-01T00:00:00Z</dc:date></r:item></rdf:RDF>"),
        ("blank", " "), ("none", None)], "feed string, xml string")
    assert {r.feed: r.feed_error for r in fd.failed_documents(docs).collect()} == {
        "page": "unknown dialect", "broken": "malformed XML", "blank": "empty document", "none": "empty document"}
    items = {r.feed: r for r in fd.feed_items(docs).collect()}
    assert set(items) == {"good", "atom", "prefixed", "old"}
    assert (items["prefixed"].link, items["prefixed"].title, items["prefixed"].feed_title) == ("https://h.example/2", "p", "T")
    assert (items["old"].title, items["old"].feed_title, items["old"].pub_epoch) == ("o", "O", 1704067200)
    analysis = {r.feed: r for r in fd.analyze_documents(fd.parse_documents(docs)).collect()}
    assert not analysis["broken"].valid and analysis["broken"].feed_error == "malformed XML" and analysis["broken"].item_count == 0
    assert analysis["no items"].valid and (analysis["no items"].item_count, analysis["good"].item_count) == (0, 1)


def test_files_name_their_feed(spark, tmp_path):
    for name in ("https%3A%2F%2Fh.example%2Frss%3Fa%3D1%2B2.xml", "plain name.xml"):
        (tmp_path / name).write_text("<rss><channel><title>T</title></channel></rss>")
    docs = {r.feed for r in fd.read_feed_documents(spark, str(tmp_path)).collect()}
    assert "https://h.example/rss?a=1+2" in docs and any(f.endswith("plain%20name.xml") or f.endswith("plain name.xml") for f in docs)


def test_kept_analyses(spark, tmp_path):
    path = f"{tmp_path}/analyses"
    for now, count in (("2024-01-01 00:00:00", 1), ("2024-01-03 00:00:00", 3), ("2024-01-02 00:00:00", 2)):
        fd.save_analysis(spark.createDataFrame([("f", count)], "feed string, item_count int"), path, now)
    kept = fd.last_analysis(spark.read.parquet(path)).first()
    assert spark.read.parquet(path).count() == 3 and kept.item_count == 3
