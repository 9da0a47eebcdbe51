"""Input columns that are called as the operators' own ones stay as they are."""

from pyspark.sql import functions as F

from newsloom.llm import linededup, quality, simhash, urlfilter

LINE = "one two three four five six seven eight nine ten eleven twelve"


def test_lines(spark):
    docs = spark.createDataFrame([(1, LINE, "d", "l", "g", "p"), (2, "own words here\n" + LINE, "d", "l", "g", "p"), (3, None, "d", "l", "g", "p")],
                                 "doc_id long, text string, _doc string, _left string, gone string, doc string")
    found = {r["doc_id"]: r for r in linededup.remove_lines(docs).collect()}
    assert {i: r["text"] for i, r in found.items()} == {1: LINE, 2: "own words here", 3: None}
    assert all((r["_doc"], r["_left"], r["gone"], r["doc"]) == ("d", "l", "g", "p") for r in found.values())


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "", "h", "k", "o", "t"), (2, None, None, "h", "k", "o", "t")],
                                  "page_id long, url string, html string, _host string, _known string, host string, trust string")
    found = urlfilter.judge(pages, urlfilter.rule_table(spark)).orderBy("page_id").collect()
    assert [r["_url"]["host"] for r in found] == ["a.com", ""] and [r["_url"]["rule"] for r in found] == ["com/", None]
    assert all((r["_host"], r["_known"], r["host"], r["trust"]) == ("h", "k", "o", "t") for r in found)


def test_rules_and_copies(spark):
    docs = spark.createDataFrame([(1, LINE, "s", "c", "l"), (2, LINE, "s", "c", "l"), (3, "short", "s", "c", "l")], "doc_id long, text string, _stats string, content string, label string")
    judged = quality.judge(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert judged.columns == [*docs.columns, "_quality"] and judged.filter(F.col("_stats") == "s").count() == 3
    assert {r["doc_id"] for r in judged.filter("not _quality.base_failed").collect()} == {1, 2}
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3] and all((r["content"], r["label"]) == ("c", "l") for r in kept)
