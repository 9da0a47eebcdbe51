"""Log table, streaming imports, replays."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from newsloom.operators import logs as lg
from newsloom.plans import rewrite as rw
from newsloom.plans.importer import ImportOptions, import_run
from newsloom.session import fresh_dir
from newsloom.sources import feeds as fd
from newsloom.sources.committed import CommittedTables, Keyed
from newsloom.streaming import cache as sc
from newsloom.streaming import imports as si

NOW = "2024-01-15 10:00:00"
LOG = "id long, time timestamp_ntz, level string, message string, context string"
ITEM = "feed string, seq long, link string, title string, content string, description string, pub_epoch long"


def logs(spark, n):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 3), "INFO" if i % 2 else "ERROR", f"m{i} 50%_x", None) for i in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_retention_and_expired_split_the_table(spark):
    for n, keep in ((10, 4), (3, 5), (0, 5)):
        table = logs(spark, n)
        kept = sorted(r.id for r in lg.log_retention(table, keep).collect())
        gone = sorted(r.id for r in lg.log_expired(table, keep).collect())
        assert kept == list(range(max(0, n - keep), n)) and gone == list(range(max(0, n - keep)))


def test_equal_messages_get_ids_of_their_own(spark):
    rows = lg.log_rows(spark.range(6), NOW, F.lit("info"), F.lit("same"), position=F.col("id"))
    assert rows.select("id").distinct().count() == 6
    assert lg.log_retention(rows, 2).count() == 2 and lg.log_expired(rows, 2).count() == 4


def test_equal_rows_are_cut_exactly(spark):
    rows = lg.log_rows(spark.range(6), NOW, F.lit("info"), F.lit("same"))
    assert rows.select("id").distinct().count() == 1
    assert lg.log_retention(rows, 2).count() == 2 and lg.log_expired(rows, 2).count() == 4


def test_pages_and_search(spark):
    table = logs(spark, 25)
    assert [r.id for r in lg.log_page(table, 2, 10).collect()] == list(range(14, 4, -1))
    assert lg.log_page(table, 0, 0).count() == 1
    assert lg.filter_logs(table, search="M1 50%_").count() == 1 and lg.filter_logs(table, search="50__").count() == 0
    info = lg.log_page_info(table, 10, level="info").first()
    assert (info.total, info.pages) == (12, 2)


def test_counts_fill_zeros(spark):
    out = {r.level: r.total for r in lg.log_counts(logs(spark, 3)).collect()}
    assert out == {"INFO": 1, "ERROR": 2, "WARNING": 0, "SUCCESS": 0}


def test_rows_export_and_clear(spark):
    rows = lg.log_rows(spark.range(2), NOW, F.lit("info"), F.lit("<b>hi</b>"), F.struct("id"))
    assert {(r.level, r.message) for r in rows.collect()} == {("INFO", "hi")}
    path = fresh_dir(spark, "logs")
    lg.append_logs(rows, path)
    stored = spark.read.parquet(path)
    out = lg.log_export(stored, NOW, "1")
    assert {(r.total_logs, r.n) for r in out.select("total_logs", F.get_json_object("log", "$.level").alias("n")).collect()} == {(2, "INFO")}
    assert lg.log_export(stored, NOW, "1").count() == 2
    assert lg.clear_table(path, spark).first().removed == 2 and spark.read.parquet(path).count() == 0


def items(spark):
    rows = [(f"f{i % 3}", i, f"https://x.example/{i % 7}", f"T{i}", "text" if i % 4 else "", None, i) for i in range(30)]
    return spark.createDataFrame(rows, ITEM)


def _import(spark, tables, source, options, rework=None):
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(source)
    pages = spark.createDataFrame([], "url string, html string")
    none = spark.createDataFrame([], "domain string, name string")
    si.stream_import(stream, tables, pages, none, lambda batch: NOW, options, rework).awaitTermination()
    return pages, none


def test_stream_never_imports_twice(spark):
    source, tables, options = fresh_dir(spark, "in"), si.import_tables(fresh_dir(spark, "out"), 8), ImportOptions(quantity=0)
    items(spark).repartition(3).write.parquet(source)
    pages, none = _import(spark, tables, source, options)
    posts = tables.read(spark, "posts")
    assert posts.select("batch_id").distinct().count() >= 2
    urls = [r.url for r in posts.collect()]
    assert sorted(urls) == sorted(f"https://x.example/{i}" for i in range(7))
    assert tables.read(spark, "results").count() == 30
    # new files with old and new addresses
    more = items(spark).withColumn("link", F.concat("link", F.when(F.col("seq") < 3, F.lit("-new")).otherwise("")))
    more.coalesce(1).write.mode("append").parquet(source)
    _import(spark, tables, source, options)
    assert sorted(r.url for r in tables.read(spark, "posts").collect() if "-new" in r.url) == ["https://x.example/1-new", "https://x.example/2-new"]
    # running a finished batch again changes nothing
    before = sorted(tables.read(spark, "posts").collect())
    last = max(r.batch_id for r in before)
    si.import_batch(tables, pages, none, lambda batch: NOW, options)(more, last)
    assert sorted(tables.read(spark, "posts").collect()) == before
    # the history is read by bucket
    asked = spark.createDataFrame([("https://x.example/1",)], "link string")
    plan = si.seen_urls(tables, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.url for r in si.seen_urls(tables, asked).collect()] == ["https://x.example/1"]


def test_one_batch_equals_batch_run(spark):
    source, tables, options = fresh_dir(spark, "in"), si.import_tables(fresh_dir(spark, "out"), 8), ImportOptions(quantity=4)
    items(spark).coalesce(1).write.parquet(source)
    pages, none = _import(spark, tables, source, options)
    batch = import_run(items(spark), pages, spark.createDataFrame([], si.META_SCHEMA), none, NOW, options)
    columns = ["feed", "seq", "link", "status", "reason"]
    assert sorted(batch.results.select(columns).collect()) == sorted(tables.read(spark, "results").select(columns).collect())


def test_a_batch_that_breaks_off_leaves_nothing(spark, monkeypatch):
    tables, options = si.import_tables(fresh_dir(spark, "out"), 8), ImportOptions(quantity=0)
    pages, none = spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "domain string, name string")
    write, stop_at = CommittedTables.write, {"n": 0}

    def breaking(self, df, name, label="part"):
        part = write(self, df, name, label)
        stop_at["n"] -= 1
        if stop_at["n"] == 0:
            raise OSError("lost")
        return part

    monkeypatch.setattr(CommittedTables, "write", breaking)
    run = si.import_batch(tables, pages, none, lambda batch: NOW, options)
    for after in (1, 3, 5):   # five tables are written
        stop_at["n"] = after
        with pytest.raises(OSError):
            run(items(spark), 0)
        assert tables.read(spark, "posts").count() == 0 and tables.read(spark, "first_seen").count() == 0
    stop_at["n"] = -1
    run(items(spark), 0)
    assert tables.read(spark, "posts").count() == 7 and tables.read(spark, "first_seen").count() == 7
    assert len(tables.unreferenced(spark)) == 9 and tables.manifest(spark).number == 1


def test_an_import_fills_the_cache_and_asks_no_more(spark):
    asked = []
    tables, options = si.import_tables(fresh_dir(spark, "out"), 8), ImportOptions(quantity=0, translate=True, mode="force")
    pages, none = spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "domain string, name string")
    folder = fresh_dir(spark, "calls")

    def counted(texts, source, target):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(texts))
        return [f"[{target}] {t}" for t in texts]

    run = si.import_batch(tables, pages, none, lambda batch: NOW, options, rw.rework(translate_fn=counted))
    run(items(spark), 0)
    asked = os.listdir(folder)
    assert asked and tables.read(spark, "cache").count() > 0
    assert {r.post_content[:4] for r in tables.read(spark, "posts").collect()} == {"[pt]"}
    run(items(spark), 1)
    assert os.listdir(folder) == asked
    assert tables.read(spark, "posts").where("batch_id = 1").count() == tables.read(spark, "posts").where("batch_id = 0").count()


def test_parts_are_merged(spark):
    tables = CommittedTables(fresh_dir(spark, "t"), {"t": "key string, n long"}, {"t": Keyed("key", lambda df: df.groupBy("key").agg(F.max("n").alias("n")), 4)})
    for n in range(20):
        tables.append(spark.createDataFrame([(f"k{n % 3}", n), (f"only{n}", n)], "key string, n long"), "t")
        tables.compact(spark, "t", most=4)
    rows = tables.read(spark, "t").groupBy("key").agg(F.max("n").alias("n")).collect()
    assert {r.key: r.n for r in rows} == {**{f"only{n}": n for n in range(20)}, "k0": 18, "k1": 19, "k2": 17}
    assert len(tables.manifest(spark).tables["t"]) <= 5
    assert [r.n for r in tables.among("t", spark.createDataFrame([("only7",), ("none",)], "key string")).collect()] == [7]


RSS = "<rss><channel><title>T</title>{}</channel></rss>"


def _item(link, title="t"):
    return f"<item><title>{title}</title><link>{link}</link><description>{'long text ' * 30}</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>"


def test_feed_files_become_posts(spark, tmp_path):
    folder, tables = tmp_path / "feeds", si.import_tables(fresh_dir(spark, "out"), 8)
    folder.mkdir()
    files = {
        "https%3A%2F%2Fa.example%2Frss.xml": RSS.format(_item("https://a.example/1") + _item("https://a.example/2")),
        "https%3A%2F%2Fb.example%2Frss.xml": RSS.format(_item("https://a.example/1") + _item("https://b.example/1")),
        "https%3A%2F%2Fbroken.example%2Frss.xml": "<rss><channel><item></channel></rss>",
        "https%3A%2F%2Fempty.example%2Frss.xml": RSS.format(""),
        "https%3A%2F%2Foff.example%2Frss.xml": RSS.format(_item("https://off.example/1")),
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    pages, none = spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "domain string, name string")
    schedule = spark.createDataFrame([(k, f"https://{h}.example/rss", True, "09:00", "", 5, k, False, "publish") for k, h in enumerate(["a", "b", "empty"])],
                                     "feed_pos long, feed_url string, enabled boolean, time string, last_run string, quantity int, category int, translate boolean, post_status string")
    documents = fd.read_feed_documents(spark, str(folder), streaming=True, maxFilesPerTrigger=2)
    options = ImportOptions(quantity="quantity", max_quantity=20)
    si.stream_feed_import(documents, tables, pages, none, lambda batch: NOW, options, schedule=lambda: schedule).awaitTermination()
    posts = tables.read(spark, "posts")
    assert sorted(r.url for r in posts.collect()) == ["https://a.example/1", "https://a.example/2", "https://b.example/1"]
    assert tables.read(spark, "logs").select("batch_id").distinct().count() >= 3
    failed = tables.read(spark, "failed_documents").collect()
    assert [(r.feed, r.feed_error) for r in failed] == [("https://broken.example/rss", "malformed XML")]
    messages = {(r.level, r.message) for r in tables.read(spark, "logs").collect()}
    assert ("INFO", "Processando feed agendado: https://b.example/rss (qtd: 5, traduzir: não, categoria: 1)") in messages
    assert ("ERROR", "Erro ao buscar feed: malformed XML") in messages and ("INFO", "Iniciando importação diária automática") in messages


def _answers(spark, files, delay):
    source, out = fresh_dir(spark, "in"), fresh_dir(spark, "out")
    for rows in files:
        spark.createDataFrame(rows, "key string, value string, at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, value string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    sc.answer_available(stream, out, fresh_dir(spark, "progress"), delay).awaitTermination()
    return sorted((r.key, r.asked_at, r.hit, r.value or "") for r in spark.read.parquet(out).collect())


def test_cache_stream_goes_by_event_time(spark):
    day, minute = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    at = lambda n: day + dt.timedelta(days=n)
    rows = [("a", "A", at(0)), ("a", None, at(29)), ("a", None, at(30)), ("b", None, at(0)), ("c", "C1", at(5)), ("c", "C2", at(5)), ("c", None, at(5))]
    many = [("hot", f"v{k:04}", day + k * minute) for k in range(700)] + [("hot", None, day + k * minute + minute / 2) for k in range(700)]
    tick = [("", None, at(200))]
    want = sorted([("a", at(29), True, "A"), ("a", at(30), False, ""), ("b", at(0), False, ""), ("c", at(5), True, "C2")]
                  + [("hot", day + k * minute + minute / 2, True, f"v{k:04}") for k in range(700)])
    shuffled = random.Random(1).sample(rows + many, len(rows + many))
    assert _answers(spark, [shuffled[:500], shuffled[500:], tick], "100 days") == want
    assert _answers(spark, [rows + many, tick], "100 days") == want


def test_cache_stream_holds_values_by_slots(spark):
    """Many keys in few calls: copies, several batches of passed rows, null keys, requests without a time, expiry."""
    day = dt.datetime(2024, 1, 1)
    at = lambda n: day + dt.timedelta(days=n)
    keys = [None, "", *(f"k{n}" for n in range(300))]
    stores = [(k, f"v{i}", at(0)) for i, k in enumerate(keys)]
    asks = [(k, None, at(10)) for k in keys] * 2
    later = [("k1", "new", at(35)), ("k1", None, at(40)), ("k2", None, at(40)), ("k3", None, None), ("k4", "lost", None)]
    files = [stores, asks, [("tick", None, at(20))], later, [("tick", None, at(90))]]
    source, out = fresh_dir(spark, "in"), fresh_dir(spark, "out")
    for rows in files:
        spark.createDataFrame(rows, "key string, value string, at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string, value string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    query = sc.answer_available(stream, out, fresh_dir(spark, "progress"), "10 days")
    query.awaitTermination()
    found = [(r.key, r.asked_at, r.value) for r in spark.read.parquet(out).collect()]
    want = [(k, at(10), f"v{i}") for i, k in enumerate(keys)] * 2
    want += [("tick", at(20), None), ("k1", at(40), "new"), ("k2", at(40), None), ("k3", None, None)]
    named = lambda rows: sorted(map(repr, rows))
    assert named(found) == named(want)
    held = [op for progress in query.recentProgress for op in progress.stateOperators if op.operatorName.startswith("transformWithState")]
    assert held[-1].numRowsTotal < len(keys)  # slots, not keys; what expired is gone
