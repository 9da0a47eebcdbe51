"""Placeholders, chunks, translation and rewriting."""

import re
import sys
import time
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.basics import strip_all_tags, strip_tags
from newsloom.functions.urls import absolute_url, resolve_url
from newsloom.operators import markup as mk
from newsloom.plans import rewrite as rw
from newsloom.plans import translate as tr

# the workers do not have this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = "2024-01-15 10:00:00"
CACHE = "key string, value string, cached_at timestamp_ntz"
FEW = settings(max_examples=6, deadline=None)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first().o


def test_protected_parts_come_back(spark):
    texts = ["see http://a.b/x and http://a.b/xy http://a.b/x", "<code>u http://a.b/x me@b.cc</code><pre><code>n</code></pre>",
             "###URL_0### me.x+y@sub.b.co.uk", "", "no parts"]
    df = mk.protect(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    rows = df.select("t", "protected", mk.restore_protected("protected", "tokens").alias("back")).collect()
    assert all(r.back == r.t for r in rows)
    assert all("http" not in r.protected and "@" not in r.protected and "<code>" not in r.protected for r in rows)
    # restoring goes by token, not by place
    moved = df.withColumn("protected", F.array_join(F.reverse(F.split("protected", " ")), " "))
    assert moved.where("t like 'see%'").select(mk.restore_protected("protected", "tokens").alias("b")).first().b == \
        "http://a.b/x http://a.b/xy and http://a.b/x see"


@FEW
@given(st.lists(st.text(alphabet="ab<>/ p!-\n.é", max_size=40), min_size=1, max_size=30))
def test_tag_tokens_come_back(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", mk.restore_tags(mk.tags_to_tokens("t"), F.col("t")).alias("back")).collect():
        assert r.back == re.sub(r"(<[^>]+>)", r" \1 ", r.t)


@FEW
@given(st.lists(st.lists(st.integers(1, 14000), min_size=1, max_size=12), min_size=1, max_size=8))
def test_chunks_keep_every_part(spark, layouts):
    texts = ["\n\n".join(chr(97 + i % 26) * n for i, n in enumerate(sizes)) for sizes in layouts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", mk.text_chunks("t").alias("c")).collect():
        assert "\n\n".join(r.c) == r.t
        assert all(len(c) <= 10002 or "\n\n" not in c for c in r.c)


def test_chunk_cases(spark):
    first_long = "x" * 12000 + "\n\n" + "y"
    assert one(spark, first_long, mk.text_chunks) == ["x" * 12000, "y"]
    sentences = " ".join("s" * 900 + "." for _ in range(40))            # one paragraph above 30000 bytes
    out = one(spark, sentences, mk.text_chunks)
    assert len(out) > 3 and "".join(out).replace("\n\n", " ").count("s") == 36000 and max(map(len, out)) <= 10002
    block = "\n".join("t" * 999 + "." for _ in range(40))               # a chunk that is itself too long
    assert max(len(c) for c in one(spark, block + "\n\nend", mk.text_chunks)) <= 10002
    assert one(spark, " \n\n ", mk.text_chunks) == []


def test_restoring_grows_with_the_text_only(spark):
    n = 20_000
    tags = "".join(f"<b i={k}>{'x' * 220}" for k in range(n))
    links = " ".join(f"http://h.example/{k}/{'y' * 200}" for k in range(n))
    df = spark.createDataFrame([(tags, links)], "tags string, links string").cache()
    made = mk.protect(df.withColumn("tagged", mk.tags_to_tokens("tags")), "links").cache()
    made.count()
    start = time.perf_counter()
    row = made.select((mk.restore_tags("tagged", "tags") == F.regexp_replace("tags", "(<[^>]+>)", " $1 ")).alias("t"),
                      (mk.restore_protected("protected", "tokens") == F.col("links")).alias("l")).first()
    assert row.t and row.l and time.perf_counter() - start < 10   # token by token it takes minutes


def test_nested_protected_parts(spark):
    text = "<pre>a <code>http://u.example/1 b</code> me@x.example</pre> <code>http://u.example/1</code> ###URL_" + "0" * 32 + "###"
    out = mk.protect(spark.createDataFrame([(text,)], "t string"), "t").select("protected", mk.restore_protected("protected", "tokens").alias("back")).first()
    assert out.back == text and "example" not in out.protected


def test_sections(spark):
    html = "a<H2 x>b</H2><p>c</p><span>d</span><article>e"
    assert one(spark, html, mk.html_sections) == ["a", "<H2 x>b</H2>", "<p>c</p><span>d</span>", "<article>e"]


@pytest.mark.parametrize("text,plain", [
    ("a<b>c</b>", "ac"), ("1 < 2 > 1", "1 < 2 > 1"), ("x<!-- <b> -->y", "xy"), ("cut <a href", "cut "), ("<>x", "x"), ("", ""), (None, None)])
def test_strip_tags(spark, text, plain):
    assert one(spark, text, strip_tags) == plain


def test_strip_scripts(spark):
    assert one(spark, " <STYLE>a</style>b<script x>c<p></script> ", strip_all_tags) == "b"


@pytest.mark.parametrize("text,n", [("it's well-known", 2), ("-a- b", 2), ("ação", 2), ("", 0), ("--", 0), ("'x", 1)])
def test_word_count(spark, text, n):
    assert one(spark, text, tx.word_count) == n


@pytest.mark.parametrize("text,lang", [
    (None, "en"), ("", "en"), ("que não com mais para", "pt"), ("que não com", "en"), ("o a os as um de do da em no", "en"),
    ("the and for you with que não com mais", "en"), ("<que> QUE, NÃO; com1mais para", "pt")])
def test_language(spark, text, lang):
    assert one(spark, text, tx.detect_language) == lang


def test_urls(spark):
    def both(url, base):
        df = spark.createDataFrame([(url, base)], "u string, b string")
        return tuple(df.select(absolute_url("u", F.col("b")), resolve_url("u", F.col("b"))).first())

    base = "https://h.example:8080/a/b/c.html?q"
    assert both("i.png", base) == ("https://h.example/i.png", "https://h.example/a/b/i.png")
    assert both("//c.example/i", base) == ("https://c.example/i", "https://h.example//c.example/i")
    assert both("HTTP://x/i", base)[0] == "HTTP://x/i"
    assert both("i", "https://h.example")[1] == "https://h.example//i"
    once = both("i.png", base)[0]
    assert both(once, base)[0] == once


# --- translation ---------------------------------------------------------------

def empty_cache(spark):
    return spark.createDataFrame([], CACHE)


def rows_of(spark, texts, kind="text", source="en", target="pt"):
    return spark.createDataFrame([(i, kind, t, source, target) for i, t in enumerate(texts)],
                                 "i long, kind string, text string, source_lang string, target_lang string")


def upper(texts, source, target):
    return [None if "FAIL" in t else re.sub(r"###\S+###|[a-z]{2,}", lambda m: m.group() if m.group()[0] == "#" else m.group().upper(), t)
            for t in texts]


def test_translate_texts_once_and_from_cache(spark, tmp_path):
    log = tmp_path / "calls"

    def counted(texts, source, target):
        with open(log, "a") as out:
            out.writelines(t.replace("\n", " ")[:20] + "\n" for t in texts)
        return upper(texts, source, target)

    long = "\n\n".join(f"part {i} " + "z" * 5000 for i in range(10))
    texts = ["hello", "hello", "", "0", None, "FAIL here", long]
    first = tr.translate_rows(rows_of(spark, texts), empty_cache(spark), NOW, counted)
    out = {r.i: r.value for r in first.values.collect()}
    assert out[0] == out[1] == "HELLO" and out[2] == "" and out[3] == "0" and out[4] is None and out[5] == "FAIL here"
    assert out[6] == "\n\n".join(f"PART {i} " + "Z" * 5000 for i in range(10))
    sent = log.read_text().splitlines()
    assert sent.count("hello") == 1 and len(sent) == 2 + 10      # one text, one failing, ten chunks of one part each
    cache = tr.new_entries(first.entries, NOW)
    assert cache.where("value like '%FAIL%'").count() == 0
    log.unlink()
    again = tr.translate_rows(rows_of(spark, texts), cache, "2024-02-14 09:59:59", counted)
    assert {r.i: r.value for r in again.values.collect()} == out and log.read_text().splitlines() == ["FAIL here"]
    log.unlink()
    tr.translate_rows(rows_of(spark, texts), cache, "2024-02-14 10:00:01", counted)      # 30 days later
    assert "hello" in log.read_text()


def test_translate_html_keeps_markup(spark):
    small = '<p class="xx">see https://a.example/path me@host.example <code>keep me</code> text</p>'
    big = "".join(f"<h2>t{i}</h2><p>{'word ' * 1200}</p><div>{'x' * 50} <b>yy</b></div>" for i in range(5))
    huge = "<div>" + "plain " * 3000 + "<i>nn</i></div>"
    out = {r.i: r.value for r in tr.translate_rows(rows_of(spark, [small, big, small + big + huge], "html"), empty_cache(spark), NOW, upper).values.collect()}
    text = out[0]
    assert "https://a.example/path" in text and "me@host.example" in text and "<code>keep me</code>" in text
    assert '<p class="xx">' in text and "SEE" in text and "TEXT" in text
    assert out[1].count("<h2>") == 5 and out[1].count("<b>") == 5 and out[1].count("WORD") == 6000
    assert "<p>PLAIN PLAIN" in out[2] and "<i>" not in out[2] and out[2].count("PLAIN") == 3000


def test_failing_service_costs_only_its_own_texts(spark):
    def fails_on_bad(texts, source, target):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    done = tr.translate_rows(rows_of(spark, ["good", "bad", "fine"]), empty_cache(spark), NOW, fails_on_bad)
    assert sorted(r.value for r in done.values.collect()) == ["FINE", "GOOD", "bad"]
    assert [(r.text, r.error) for r in done.errors.collect()] == [("bad", "no")]
    assert sorted(r.text for r in done.entries.collect()) == ["fine", "good"]


def test_large_plain_piece_is_sent_in_chunks(spark):
    sizes = spark.sparkContext.accumulator(0)

    def measured(texts, source, target):
        sizes.add(sum(len(t.encode()) > 30000 for t in texts))
        return [t.upper() for t in texts]

    page = "<p>" + "Some <i>words</i> here. " * 3000 + "</p>"
    out = tr.translate_rows(rows_of(spark, [page], "html"), empty_cache(spark), NOW, measured).values.first().value
    assert sizes.value == 0
    assert out.startswith("<p>SOME") and out.endswith("HERE.</p>") and out.count("<p>") == 1
    assert out.split() == ("<p>" + "SOME WORDS HERE. " * 3000).strip().split()[:-1] + ["HERE.</p>"]


def test_same_language_is_left_alone(spark):
    out = tr.translate_rows(rows_of(spark, ["hello"], source="pt"), empty_cache(spark), NOW, upper).values.first()
    assert out.value == "hello"


def test_service_chain():
    def broken(texts, s, t):
        raise OSError("down")

    chain = tr.service_chain(broken, lambda x, s, t: [None if len(v) > 2 else v * 2 for v in x], lambda x, s, t: ["last"] * len(x))
    assert chain(["a", "long"], "en", "pt") == ["aa", "last"] and tr.service_chain(broken)(["a"], "en", "pt") == [None]


def test_translate_documents(spark):
    docs = spark.createDataFrame([
        (1, "hello", "<p>the and for you with text</p>", "short", True), (2, "oi", "<p>que não com mais para</p>", "x", True),
        (3, "hello", "<p>other</p>", "y", False)], "doc_id long, title string, content string, excerpt string, translate boolean")
    out, entries = tr.translate_content(docs, empty_cache(spark), NOW, upper)
    got = {r.doc_id: (r.title, r.excerpt, r.translated) for r in out.collect()}
    assert got == {1: ("HELLO", "SHORT", True), 2: ("oi", "x", False), 3: ("hello", "y", False)}
    assert entries.count() >= 3


# --- rewriting ---------------------------------------------------------------------

ARTICLE = "<p>" + "some words here " * 20 + '</p><img src="a"><iframe src="v"></iframe>'


def test_rewrite_with_media_and_failures(spark):
    docs = spark.createDataFrame([("a", "T", ARTICLE), ("b", "T", "<p>too short</p>"), ("c", "BOOM", ARTICLE), ("d", "BAD", ARTICLE)],
                                 "run_key string, title string, content string")

    def model(prompts):
        if any("BOOM" in p for p in prompts):
            raise OSError("no connection")
        return ["nonsense" if "BAD" in p else
                '```json\n{"title":"New","meta_description":"","content":"<p>x [[MEDIA_ITEM_1]] y [[MEDIA_ITEM_0]]</p>"}\n```' for p in prompts]

    out = {r.run_key: r for r in rw.rewrite_documents(docs, model).collect()}
    assert out["a"].rewritten and out["a"].title == "New" and out["a"].meta_description == ""
    assert out["a"].content == '<p>x \n\n<iframe src="v"></iframe>\n\n y \n\n<img src="a">\n\n</p>'
    assert not out["b"].rewritten and "curto" in out["b"].rewrite_error
    assert out["c"].rewrite_error == "no connection" and out["c"].content == ARTICLE
    assert "inválido" in out["d"].rewrite_error


def test_equal_prompts_are_asked_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, "T", ARTICLE if k % 2 else ARTICLE.replace("some", "other")) for k in range(40)], "run_key long, title string, content string")

    def model(prompts):
        (tmp_path / uuid.uuid4().hex).write_text(str(len(prompts)))
        return ['{"title":"R","content":"<p>c</p>"}'] * len(prompts)

    out = rw.rewrite_documents(docs, model).collect()
    assert len(out) == 40 and all(r.rewritten and r.title == "R" for r in out)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 2


def test_rework_falls_back_to_translation(spark):
    rows = spark.createDataFrame([("a", "title", ARTICLE, True), ("b", "title", "<p>short text</p>", True), ("c", "title", "<p>short text</p>", False)],
                                 "run_key string, title string, content string, translate boolean")
    step = rw.rework(lambda ps: ['{"title":"R","content":"<p>c</p>"}'] * len(ps), translate_fn=upper, cache=empty_cache(spark), now=NOW)
    out = {r.run_key: (r.title, r.translate) for r in step(rows).collect()}
    assert out == {"a": ("R", True), "b": ("TITLE", True), "c": ("title", False)}


def test_disabled_rewriter(spark):
    df = rw.prepare(spark.createDataFrame([(ARTICLE,)], "content string"))
    assert df.select(rw.eligibility(F.lit(True), F.lit("none"), F.lit(True)).alias("r")).first().r.startswith("Agente")
    assert not rw.RewriteOptions(has_key=False).usable


@pytest.mark.parametrize("raw,title,bad", [
    ('{"title":"a","content":"b"}', "a", False), ('text {"title":"a","content":"b"} more', "a", False), ("[1]", None, False),
    ('{"title":1}', "1", False), ("{", None, True), (None, None, True), ("", None, True)])
def test_parse_response(spark, raw, title, bad):
    out = one(spark, raw, lambda t: rw.parse_response(t))
    assert (out.answer.title if out.answer else None) == title and (out.error is not None) == bad


def test_translation_writes_each_text_few_times(spark, tmp_path, monkeypatch):
    """What is written for long texts stays below four times their size, whatever is asked of the result."""
    import pathlib
    import random

    deal = random.Random(5)
    texts = ["".join(deal.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(3000)) for _ in range(200)]
    written = []
    plain = tr.stage
    monkeypatch.setattr(tr, "stage", lambda df, name: written.append((name, plain(df, name))) or written[-1][1])
    out = tr.translate_rows(rows_of(spark, texts), empty_cache(spark), NOW, upper)
    assert sorted(r.value for r in out.values.collect()) == sorted(upper(texts, "", ""))
    files = [pathlib.Path(f.removeprefix("file://")) for _, df in written for f in df.inputFiles()]
    assert sum(f.stat().st_size for f in files) < 4 * sum(map(len, texts))
    assert sorted((r.text, r.value) for r in out.entries.collect()) == sorted(zip(texts, upper(texts, "", "")))


def test_translation_where_the_cache_holds_a_null(spark):
    rows = rows_of(spark, ["known", "fresh"])
    keyed = rows.select(tr.cache_key(F.col("text"), F.col("source_lang"), F.col("target_lang"), F.col("kind")).alias("key"), "text")
    cache = keyed.where("text = 'known'").select("key", F.lit(None).cast("string").alias("value"), F.lit(NOW).cast("timestamp_ntz").alias("cached_at"))
    out = tr.translate_rows(rows, cache, NOW, upper)
    assert sorted(r.value for r in out.values.collect()) == ["FRESH", "known"]
