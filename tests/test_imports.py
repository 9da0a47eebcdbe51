"""Selection and import runs, against brute force on small random data."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from newsloom.operators import selection as sel
from newsloom.plans import importer as im
from newsloom.session import fresh_dir

NOW = "2024-01-15 10:00:00"
ITEM = "feed_pos int, feed string, seq long, link string, title string, content string, description string, pub_epoch long"
META = "post_id string, meta_key string, meta_value string"
SOURCE = "domain string, name string"
BODY = "<article><p>" + "long text " * 60 + "</p></article>"


def make(rows, spark):
    return spark.createDataFrame(rows, ITEM)


@pytest.fixture(scope="module")
def world(spark):
    """One address holds a third of the items; some pages are missing, some texts empty."""
    rnd = random.Random(7)
    pages = [(f"https://{'good' if i % 3 else 'bad'}.example/{i}", BODY if i % 2 else "<p>x</p>") for i in range(12)]
    items = []
    for i in range(240):
        link = pages[1][0] if i % 3 == 0 else rnd.choice([p[0] for p in pages] + ["https://good.example/missing", None])
        items.append((rnd.randint(1, 2), f"feed{rnd.randint(1, 3)}", i, link, f"T{i}", rnd.choice(["", None, "<p>own</p>", "0"]),
                      rnd.choice([None, "", "summary"]), rnd.randint(1, 50)))
    meta = [("p", "_newsloom_original_url", pages[5][0]), ("p", "other", pages[7][0])]
    return dict(items=items, pages=pages, meta=meta, sources=[("www.good.example", "G")])


def brute(world, quantity, mode):
    """One item after the other, in run order."""
    by_feed = {}
    for row in world["items"]:
        by_feed.setdefault(row[1], []).append(row)
    looked = [r for rows in by_feed.values() for r in sorted(rows, key=lambda r: (-r[7], r[2]))[:quantity]]
    seen, pages, status = {m[2] for m in world["meta"] if m[1] == "_newsloom_original_url"}, dict(world["pages"]), {}
    for row in sorted(looked, key=lambda r: (r[0], r[1], r[7], -r[2])):
        link = row[3] or ""
        text = (row[5] if row[5] not in (None, "", "0") else row[6]) or ""
        if mode == "normal" and link in seen:
            status[row[2]] = "skipped"
        elif "good.example" not in link:
            status[row[2]] = "skipped"
        elif text not in ("", "0") or pages.get(link) == BODY:
            status[row[2]] = "imported"
            seen.add(link)
        else:
            status[row[2]] = "failed"
    return status


def run(spark, world, options, meta=None):
    return im.import_run(
        make(world["items"], spark), spark.createDataFrame(world["pages"], "url string, html string"),
        spark.createDataFrame(world["meta"], META) if meta is None else meta,
        spark.createDataFrame(world["sources"], SOURCE), NOW, options)


@pytest.mark.parametrize("mode", ["normal", "force"])
def test_run_equals_one_by_one(spark, world, mode):
    options = im.ImportOptions(quantity=60, mode=mode)
    out = run(spark, world, options)
    got = {r.seq: r.status for r in out.results.collect()}
    assert got == brute(world, 60, mode)
    assert {"imported", "skipped", "failed"} <= set(got.values()) or mode == "force"
    assert out.posts.count() == sum(s == "imported" for s in got.values())
    totals = out.totals.where(F.col("feed").isNull()).first()
    assert totals.imported + totals.skipped + totals.failed == len(got)


def test_second_run_imports_nothing(spark, world):
    options = im.ImportOptions(quantity=60)
    first = run(spark, world, options)
    meta = first.post_meta.unionByName(spark.createDataFrame(world["meta"], META))
    path = fresh_dir(spark, "meta")
    meta.write.parquet(path)
    again = run(spark, world, options, spark.read.parquet(path))
    assert again.results.where("status = 'imported'").count() == 0 and again.posts.count() == 0


def test_stored_posts_give_the_same_tables(spark, world):
    """With a posts table the other outputs hang on the stored rows only."""
    from newsloom.session import stage

    options = im.ImportOptions(quantity=60)
    plain, stored = run(spark, world, options), im.import_run(
        make(world["items"], spark), spark.createDataFrame(world["pages"], "url string, html string"),
        spark.createDataFrame(world["meta"], META), spark.createDataFrame(world["sources"], SOURCE), NOW, options,
        posts_table=lambda df: stage(df, "winners"))
    key = ["feed", "seq", "status", "reason"]
    assert sorted(plain.results.select(key).collect()) == sorted(stored.results.select(key).collect())
    assert sorted(r.post_id for r in plain.posts.collect()) == sorted(r.post_id for r in stored.posts.collect())
    assert "ArrowEvalPython" not in stored.results._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, world):
    """Pages are narrowed to wanted addresses before they are parsed; top-N is cut on the map side."""
    plan = plan_of(run(spark, world, im.ImportOptions(quantity=5)).posts)
    assert plan.count("ArrowEvalPython") == 1
    assert "LeftSemi" in plan[plan.index("ArrowEvalPython"):]     # deeper in the tree, that is, earlier in the run
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    items = make(world["items"], spark)
    assert plan_of(sel.newest_per_feed(items, 5)).count("WindowGroupLimit") == 2      # partial and final
    with_column = items.withColumn("quantity", F.lit(3))
    assert plan_of(sel.newest_per_feed(with_column, "quantity", 20)).count("WindowGroupLimit") == 2
    seen = sel.imported_urls(spark.createDataFrame(world["meta"], META), "_newsloom_original_url")
    assert "LeftAnti" in plan_of(sel.new_items(items, seen)) and "LeftSemi" in plan_of(sel.skipped_items(items, seen))


def test_top_n(spark):
    rows = spark.createDataFrame([("a", i, i // 2, q) for i in range(10) for q in (0,)] + [("b", i, 0, 3) for i in range(5)] + [("c", i, i, 2000) for i in range(4)],
                                 "feed string, seq long, pub_epoch long, quantity int")
    by_column = sorted((r.feed, r.seq) for r in sel.newest_per_feed(rows, "quantity").collect())
    assert by_column == [("a", i) for i in range(10)] + [("b", 0), ("b", 1), ("b", 2)] + [("c", i) for i in range(4)]
    assert sorted(r.seq for r in sel.newest_per_feed(rows.where("feed = 'a'"), 3).collect()) == [6, 8, 9]
    assert sel.newest_per_feed(rows, 0).count() == rows.count()
    assert sorted((r.feed, r.seq) for r in sel.newest_per_feed(rows.where("feed = 'b'"), "quantity", 20).collect()) == [("b", 0), ("b", 1), ("b", 2)]


def test_top_n_of_any_quantity(spark):
    deal = random.Random(3)
    rows = [(deal.choice(["big"] * 5 + ["a", None]), i, deal.choice([None, deal.randrange(40) * 1800]), 0) for i in range(400)]
    quantity = {"big": 150, "a": 10**7, None: 3}
    rows = [(f, i, at, quantity[f]) for f, i, at, _ in rows] + [("all", i, i, q) for i, q in ((0, 0), (1, 0))] + [("none", 0, 5, None)]
    frame = spark.createDataFrame(rows, "feed string, seq long, pub_epoch long, quantity int")
    want = []
    for f in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == f), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want += [(f, r[1]) for r in (own[:own[0][3]] if own[0][3] else own)]
    got = sel.newest_per_feed(frame, "quantity")
    assert sorted(((r.feed, r.seq) for r in got.collect()), key=str) == sorted(want, key=str) and got.columns == frame.columns


HOSTS = ["https://bbc.com/x", "http://www.bbc.com/y", "https://notBBC.com/", "https://news.bbc.com.evil.example/1", "https://other.example/", "nohost", None]


def test_trust(spark, monkeypatch):
    items = spark.createDataFrame([(i, u) for i, u in enumerate(HOSTS)], "seq long, link string")
    sources = spark.createDataFrame([("www.bbc.com", "B"), ("BBC.com", "again"), (None, "x"), ("a.b", "y")], SOURCE)

    def trusted(**kw):
        return sorted(r.seq for r in sel.trusted_items(items, sources, **kw).collect())

    for gram in (6, 3, 20):
        monkeypatch.setattr(sel, "GRAM", gram)
        assert {m: trusted(match=m) for m in ("contains", "suffix")} == {"contains": [0, 1, 2, 3], "suffix": [0, 1]}
    plan = sel.with_trust_flag(items, sources)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert sel.trusted_items(items, sources.where("false")).count() == len(HOSTS)


def test_null_links_are_new(spark):
    items = spark.createDataFrame([(1, None), (2, "a")], "seq long, link string")
    seen = sel.imported_urls(spark.createDataFrame([("p", "k", "a"), ("p", "k", "a"), ("q", "k", None)], META), "k")
    assert [r.seq for r in sel.new_items(items, seen).collect()] == [1]
    assert [r.is_duplicate for r in sel.with_duplicate_flag(items, seen).orderBy("seq").collect()] == [False, True]


def test_daily_run_takes_settings_from_feeds(spark, world):
    feeds = spark.createDataFrame([(1, "feed1", 2, 9, False, "publish"), (0, "feed2", 1, 0, False, "pending")],
                                  "feed_pos long, feed_url string, quantity int, category int, translate boolean, post_status string")
    items = im.daily_items(make(world["items"], spark), feeds)
    options = replace(im.DAILY, default_category=4)
    out = im.import_run(items, spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], META),
                        spark.createDataFrame([], SOURCE), NOW, options)
    assert {r.feed: r.imported + r.skipped + r.failed for r in out.summary.collect()} == {"feed1": 2, "feed2": 1}
    assert {(r.feed, r.category, r.post_status) for r in out.posts.collect()} <= {("feed1", 9, "publish"), ("feed2", 4, "pending")}


def test_a_feed_scheduled_twice_is_two_feeds(spark):
    """Each schedule row looks at its own number of items; what the first imports is a duplicate for the second."""
    items = [(1, "f", i, f"https://good.example/{i}", f"T{i}", "<p>own</p>", "", i) for i in range(10)]
    feeds = spark.createDataFrame([(0, "f", 2, 3, True, "publish"), (1, "f", 4, 0, False, "pending")],
                                  "feed_pos long, feed_url string, quantity int, category int, translate boolean, post_status string")

    def go(mode):
        return im.import_run(im.daily_items(make(items, spark), feeds), spark.createDataFrame([], "url string, html string"),
                             spark.createDataFrame([], META), spark.createDataFrame([("good.example", "G")], SOURCE), NOW,
                             replace(im.DAILY, mode=mode, time_zone="America/Sao_Paulo"))

    out = go("normal")
    assert {(r.schedule_row, r.imported, r.skipped) for r in out.summary.collect()} == {(0, 2, 0), (1, 2, 2)}
    assert sorted((r.url[-1], r.category, r.post_status) for r in out.posts.collect()) == [
        ("6", 0, "pending"), ("7", 0, "pending"), ("8", 3, "publish"), ("9", 3, "publish")]
    assert {str(r.post_date_gmt) for r in out.posts.collect()} == {"2024-01-15 13:00:00"}
    forced = go("force")
    assert {(r.schedule_row, r.imported) for r in forced.summary.collect()} == {(0, 2), (1, 4)}
    assert len({r.post_id for r in forced.posts.collect()}) == 6


def test_manual_run_passes_its_translate_option_on(spark, world):
    out = run(spark, world, im.manual(im.ImportOptions(translate=True), quantity=3))
    assert {r.translate for r in out.results.collect()} == {True}


def test_feed_errors_in_summary(spark):
    results = spark.createDataFrame([("a", "imported")], "feed string, status string")
    feeds = spark.createDataFrame([("a", None), ("b", "timeout")], "feed string, feed_error string")
    out = {r.feed: (r.imported, r.failed, r.feed_error) for r in im.import_summary(results, feeds).collect()}
    assert out == {"a": (1, 0, None), "b": (0, 0, "timeout")}


def test_manual_options():
    assert im.manual(im.ImportOptions(), quantity=99).quantity == 20 and im.manual(im.ImportOptions(), quantity=0).quantity == 1


def test_meta_prefix_and_descriptions(spark):
    posts = spark.createDataFrame([("1", "u", "F", ""), ("2", "v", "F", "about")], "post_id string, url string, feed_title string, meta_description string")
    rows = im.build_post_meta(posts, im.ImportOptions(meta_prefix="_site_")).collect()
    assert sum(r.post_id == "1" for r in rows) == 3 and sum(r.post_id == "2" for r in rows) == 7
    assert {r.meta_key for r in rows if r.post_id == "1"} == {"_site_original_url", "_site_imported", "_site_source_title"}
