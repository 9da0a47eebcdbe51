"""Language, translation, rewriting."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import derive as d
from checks.registry import check
from newsloom import fixed_values as fixed
from newsloom.functions import text as tx
from newsloom.operators import markup as mk
from newsloom.plans import rewrite as rw
from newsloom.plans import translate as tr
from newsloom.session import fresh_dir
from newsloom.sources.committed import CommittedTables, Keyed
from newsloom.sources.pages import spread


def _docs(spark, folder):
    return spread(d.table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars"))


def _word_list(words):
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words) if len(w.encode()) >= 3) + ")"


def _hits(words):
    return (f"len(list_filter(regexp_split_to_array(lower(regexp_replace({d.strip('text')}, '[0-9\\p{{P}}]', ' ', 'g')), '\\s+'), "
            f"lambda w: w IN {_word_list(words)}))")


_LANGUAGE = f"""(SELECT *, CASE WHEN pt > en AND pt > 3 THEN 'pt' ELSE 'en' END AS language FROM
  (SELECT *, {_hits(fixed.ENGLISH_WORDS)} AS en, {_hits(fixed.PORTUGUESE_WORDS)} AS pt FROM documents))"""


@check("language_detect", f"SELECT doc_id, en, pt, language FROM {_LANGUAGE}")
def language_detect(spark, folder):
    hits = _docs(spark, folder).select("doc_id", tx.language_hits("text").alias("hits"))
    return hits.select("doc_id", "hits.en", "hits.pt", tx.language_of(F.col("hits")).alias("language"))


@check("translate_needed", f"SELECT doc_id, language FROM {_LANGUAGE} WHERE language <> 'pt'")
def translate_needed(spark, folder):
    rows = _docs(spark, folder).select("doc_id", tx.detect_language("text").alias("language"))
    return rows.where(F.col("language") != "pt")


@check("word_count", f"SELECT doc_id, {d.words('text')} AS words FROM documents")
def word_count(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.word_count("text").alias("words"))


@check("translate_route", """
SELECT doc_id, CASE WHEN strlen(text) > 30000 THEN 'chunks' ELSE 'whole' END AS text_route, CASE WHEN strlen(text) > 20000 THEN 'sections' ELSE 'whole' END AS html_route,
  CASE WHEN strlen(text) > 15000 THEN 'pieces' ELSE 'tags' END AS section_route, CASE WHEN strlen(text) > 5000 THEN 'plain' ELSE 'tags' END AS piece_route FROM documents""")
def translate_route(spark, folder):
    return _docs(spark, folder).select(
        "doc_id", *[tx.translation_route("text", kind).alias(f"{kind}_route") for kind in ("text", "html", "section", "piece")])


@check("translate_cache_lookup", f"""
SELECT doc_id, f.value IS NOT NULL AS hit, md5(f.value) AS value_md5 FROM documents LEFT JOIN {d.FRESH} f ON f.key = md5(text || 'enpttext')""")
def translate_cache_lookup(spark, folder):
    keyed = _docs(spark, folder).withColumn("key", tr.cache_key(F.col("text"), F.lit("en"), F.lit("pt"), F.lit("text")))
    out = tr.cache_lookup(keyed, d.cache(spark, folder), d.NOW)
    return out.select("doc_id", F.col("cached").isNotNull().alias("hit"), F.md5("cached").alias("value_md5"))


_PENDING = f"""(SELECT DISTINCT md5(text || 'enpttext') AS key, text FROM documents WHERE md5(text || 'enpttext') NOT IN (SELECT key FROM {d.FRESH}))"""


def _pending(spark, folder):
    keyed = _docs(spark, folder).withColumn("key", tr.cache_key(F.col("text"), F.lit("en"), F.lit("pt"), F.lit("text")))
    return tr.pending_texts(keyed, d.cache(spark, folder), d.NOW, "text")


@check("translate_pending", f"SELECT key, md5(text) AS text_md5 FROM {_PENDING}")
def translate_pending(spark, folder):
    return _pending(spark, folder).select("key", F.md5("text").alias("text_md5"))


@check("translate_cache_merge", f"""
SELECT key, md5(value) AS value_md5, cached_at FROM (
  SELECT key, arg_max(value, cached_at) AS value, max(cached_at) AS cached_at FROM (
    SELECT * FROM {d.CACHE} UNION ALL SELECT key, '[pt] ' || text, TIMESTAMP '{d.NOW}' FROM {_PENDING} WHERE text NOT IN ('', '0') ) GROUP BY key)""")
def translate_cache_merge(spark, folder):
    """Everything pending goes through the (offline) service once and into the cache."""
    pending = _pending(spark, folder).withColumns({"source_lang": F.lit("en"), "target_lang": F.lit("pt")})
    done = tr.call_service(pending, tr.offline_translate)
    # the stored entries and the run's own are parts of a bucketed table; merging leaves the newest of each key
    tables = CommittedTables(fresh_dir(spark, "cache"), {"cache": tr.CACHE_SCHEMA}, {"cache": Keyed("key", tr.newest_entries, 16)})
    tables.append(d.cache(spark, folder), "cache")
    tables.append(tr.new_entries(done, d.NOW), "cache")
    tables.compact(spark, "cache", most=1)
    return tables.read(spark, "cache").select("key", F.md5("value").alias("value_md5"), "cached_at")


# --- markup set aside --------------------------------------------------------

_EXTRA = " see https://a.example/x and https://a.example/xyz, me@b.example <code>c https://a.example/x</code> <pre>p</pre>"


@check("protect_roundtrip", f"""
SELECT doc_id, md5(text || '{_EXTRA}') AS restored_md5, CAST(6 AS BIGINT) AS tokens_seen, true AS hidden FROM documents""")
def protect_roundtrip(spark, folder):
    docs = _docs(spark, folder).withColumn("text", F.concat("text", F.lit(_EXTRA)))
    out = mk.protect(docs, "text")
    kinds = F.transform("tokens", lambda t: F.regexp_extract(t["token"], "^###([A-Z]+)_", 1))
    extra_left = F.contains("protected", F.lit("a.example")) | F.contains("protected", F.lit("<code>")) | F.contains("protected", F.lit("me@b"))
    # two URLs, one e-mail, a code and a pre block of our own, and the text's own addresses
    own = F.size(F.filter("tokens", lambda t: F.contains(t["original"], F.lit("a.example")) | F.contains(t["original"], F.lit("b.example"))
                          | F.contains(t["original"], F.lit("<pre>p</pre>"))))
    code = F.when(F.array_contains(kinds, "CODE"), 1).otherwise(0)
    return out.select(
        "doc_id", F.md5(mk.restore_protected("protected", "tokens")).alias("restored_md5"),
        (own + code + 1).cast("long").alias("tokens_seen"), (~extra_left).alias("hidden"))


def _interleave(text, pattern, token):
    return (f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), "
            f"list_transform(regexp_extract_all({text}, '{pattern}', 0), lambda m, i: {token})), lambda z: z[1] || coalesce(z[2], '')), '')")


_URL, _EMAIL = (p.replace("'", "''") for p in (fixed.URL_PATTERN, fixed.EMAIL_PATTERN))


@check("protect_tokens", rf"""
SELECT page_id, md5({_interleave('t1', _EMAIL, "'###EMAIL_' || md5(m) || '###'")}) AS protected_md5 FROM (
  SELECT page_id, {_interleave('t0', _URL, "'###URL_' || md5(m) || '###'")} AS t1 FROM (
    SELECT page_id, regexp_replace(html, '<nav>.*</nav>', '<nav>https://h.example/' || page_id || ' me' || page_id || '@b.example</nav>') AS t0 FROM pages))""")
def protect_tokens(spark, folder):
    """Tokens are hashes of what they stand for, placed where it stood."""
    pid = F.col("page_id").cast("string")
    nav = F.concat(F.lit("<nav>https://h.example/"), pid, F.lit(" me"), pid, F.lit("@b.example</nav>"))
    old = F.regexp_extract("html", "<nav>.*</nav>", 0)
    pages = d.plain_pages(spark, folder).withColumn("html", F.replace(F.col("html"), old, nav))
    return mk.protect(pages, "html").select("page_id", F.md5("protected").alias("protected_md5"))


@check("tag_placeholders", f"""
SELECT page_id, md5({_interleave('html', '<[^>]+>', "' ###TAG_' || (i - 1) || '### '")}) AS tokens_md5,
  md5({_interleave('html', '<[^>]+>', "' ' || m || ' '")}) AS restored_md5 FROM pages""")
def tag_placeholders(spark, folder):
    p = d.plain_pages(spark, folder).withColumn("tokens", mk.tags_to_tokens("html"))
    return p.select("page_id", F.md5("tokens").alias("tokens_md5"), F.md5(mk.restore_tags("tokens", "html")).alias("restored_md5"))


_MEDIA = ('<video src="v"></video><img src="1"><iframe src="f"></iframe><blockquote class="quote">q</blockquote>'
          '<blockquote data-a="1" class="twitter-tweet" x>t <b>w</b></blockquote><IMG src="2">')
_MEDIA_TOKENS = " [[MEDIA_ITEM_3]]  [[MEDIA_ITEM_0]]  [[MEDIA_ITEM_2]] q [[MEDIA_ITEM_4]]  [[MEDIA_ITEM_1]] "


def _with_media(spark, folder):
    return d.plain_pages(spark, folder).withColumn("html", F.replace(F.col("html"), F.lit("</article>"), F.lit(_MEDIA + "</article>")))


_PLAIN_MEDIA = d.strip_all(f"replace(html, '</article>', '{_MEDIA_TOKENS}</article>')")


@check("media_placeholders", f"SELECT page_id, md5({_PLAIN_MEDIA}) AS text_md5, CAST(5 AS BIGINT) AS media FROM pages")
def media_placeholders(spark, folder):
    out = mk.media_placeholders(_with_media(spark, folder), "html")
    return out.select("page_id", F.md5("media_text").alias("text_md5"), F.size("media").cast("long").alias("media"))


def _nl(x):
    return f"chr(10) || chr(10) || '{x}' || chr(10) || chr(10)"


@check("media_roundtrip", f"""
SELECT page_id, md5(replace(replace(replace(replace(replace({_PLAIN_MEDIA}, '[[MEDIA_ITEM_0]]', {_nl('<img src="1">')}), '[[MEDIA_ITEM_1]]', {_nl('<IMG src="2">')}),
  '[[MEDIA_ITEM_2]]', {_nl('<iframe src="f"></iframe>')}), '[[MEDIA_ITEM_3]]', {_nl('<video src="v"></video>')}),
  '[[MEDIA_ITEM_4]]', {_nl('<blockquote data-a="1" class="twitter-tweet" x>t <b>w</b></blockquote>')})) AS text_md5 FROM pages""")
def media_roundtrip(spark, folder):
    out = mk.media_placeholders(_with_media(spark, folder), "html")
    return out.select("page_id", F.md5(mk.restore_media("media_text", "media")).alias("text_md5"))


@check("media_stats", """
SELECT page_id, 2 + page_id % 4 AS images, 1 + page_id % 3 AS iframes, CAST(1 AS BIGINT) AS videos, 1 + page_id % 2 AS embeds FROM pages""")
def media_stats(spark, folder):
    more = F.concat(*[F.repeat(F.lit(tag), (F.col("page_id") % n).cast("int")) for tag, n in (
        ("<img src=3>", 4), ('<iframe src="g"></iframe>', 3), ('<blockquote class="tiktok-embed">t</blockquote>', 2))])
    pages = _with_media(spark, folder).withColumn("html", F.concat("html", more))
    return pages.select("page_id", *[c.alias(n) for n, c in mk.media_counts("html").items()])


# --- long texts ----------------------------------------------------------------

# paragraphs (or sentences) numbered, then packed one after the other
_PARTS = f"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, part, strlen(part) AS n FROM (
  SELECT doc_id, unnest(range(len(parts))) AS i, {d.trim('unnest(parts)')} AS part FROM (
    SELECT doc_id, CASE WHEN len(string_split_regex(text, '\\n\\s*\\n')) > 1 THEN string_split_regex(text, '\\n\\s*\\n')
      ELSE string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS parts FROM {{docs}})) WHERE part NOT IN ('', '0'))"""
# documents as they come, and with every second line end turned into a blank line
_TEXTS = """(SELECT doc_id, CASE WHEN lang = 'en' THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE replace(text, chr(10), ' ') END AS text FROM documents)"""


@check("text_chunks", f"""
WITH RECURSIVE parts AS MATERIALIZED (SELECT * FROM {_PARTS.replace('{docs}', _TEXTS)}),
packed AS (SELECT doc_id, i, part, CAST(0 AS BIGINT) AS chunk, n AS size FROM parts WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.part, CASE WHEN q.size + p.n > 10000 THEN q.chunk + 1 ELSE q.chunk END,
    CASE WHEN q.size + p.n > 10000 THEN p.n ELSE q.size + 2 + p.n END FROM packed q JOIN parts p ON p.doc_id = q.doc_id AND p.i = q.i + 1)
SELECT doc_id, chunk, md5(string_agg(part, chr(10) || chr(10) ORDER BY i)) AS chunk_md5 FROM packed GROUP BY doc_id, chunk""")
def text_chunks(spark, folder):
    text = F.when(F.col("lang") == "en", F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    docs = _docs(spark, folder).withColumn("text", text)
    rows = docs.select("doc_id", F.posexplode(mk.text_chunks("text")).alias("chunk", "part"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.md5("part").alias("chunk_md5"))


@check("html_sections", """
SELECT page_id, CAST(i AS BIGINT) AS section, md5(part) AS part_md5 FROM (SELECT page_id, unnest(range(len(parts))) AS i, unnest(parts) AS part FROM (
  SELECT page_id, string_split(regexp_replace(html, '(?i)(<(?:h[1-6]|p|div|section|article)[^>]*>)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM pages))""")
def html_sections(spark, folder):
    rows = d.plain_pages(spark, folder).select("page_id", F.posexplode(mk.html_sections("html")).alias("section", "part"))
    return rows.select("page_id", F.col("section").cast("long").alias("section"), F.md5("part").alias("part_md5"))


# --- translation runs -------------------------------------------------------------

_LONG = "(SELECT doc_id, text FROM documents WHERE strlen(text) > 30000 AND lang <> 'de')"


@check("translate_text", f"""
WITH RECURSIVE parts AS MATERIALIZED (SELECT * FROM {_PARTS.replace('{docs}', _LONG)}),
packed AS (SELECT doc_id, i, part, CAST(0 AS BIGINT) AS chunk, n AS size FROM parts WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, p.part, CASE WHEN q.size + p.n > 10000 THEN q.chunk + 1 ELSE q.chunk END,
    CASE WHEN q.size + p.n > 10000 THEN p.n ELSE q.size + 2 + p.n END FROM packed q JOIN parts p ON p.doc_id = q.doc_id AND p.i = q.i + 1),
chunks AS (SELECT doc_id, chunk, '[de] ' || string_agg(part, chr(10) || chr(10) ORDER BY i) AS done FROM packed GROUP BY doc_id, chunk)
SELECT doc_id, CASE WHEN lang = 'de' OR text IN ('', '0') THEN md5(text) ELSE md5('[de] ' || text) END AS value_md5
  FROM documents WHERE strlen(text) <= 30000 OR lang = 'de'
UNION ALL SELECT doc_id, md5(string_agg(done, chr(10) || chr(10) ORDER BY chunk)) FROM chunks GROUP BY doc_id""")
def translate_text(spark, folder):
    """Whole documents; German ones are in the target language already, very long ones go in chunks."""
    rows = _docs(spark, folder).select("doc_id", F.lit("text").alias("kind"), "text", F.col("lang").alias("source_lang"), F.lit("de").alias("target_lang"))
    out = tr.translate_rows(rows, d.cache(spark, folder), d.NOW)
    return out.values.select("doc_id", F.md5("value").alias("value_md5"))


_ART = r"""regexp_extract(html, '(?is)<article>(.*?)</article>', 1)"""


# pages above 20,000 bytes go section by section
_SECTIONS = r"string_split(regexp_replace(content, '(?i)(<(?:h[1-6]|p|div|section|article)[^>]*>)', chr(1) || '\1', 'g'), chr(1))"
_BY_SECTION = (f"array_to_string(list_transform(list_filter(list_transform({_SECTIONS}, lambda p: {d.trim('p')}), lambda p: p <> ''), "
               f"lambda p: '[pt] ' || {_interleave('p', '<[^>]+>', "' ' || m || ' '")}), '')")


@check("content_translation", f"""
SELECT page_id, language = 'en' AS translated, CASE WHEN language = 'en' AND title <> '' THEN '[pt] ' || title ELSE title END AS title,
  CASE WHEN language = 'en' AND strlen(content) > 20000 THEN md5({_BY_SECTION}) WHEN language = 'en' THEN md5('[pt] ' || {_interleave('content', '<[^>]+>', "' ' || m || ' '")}) ELSE md5(content) END AS content_md5
FROM (SELECT *, CASE WHEN pt > en AND pt > 3 THEN 'pt' ELSE 'en' END AS language FROM (SELECT *, {_hits(fixed.ENGLISH_WORDS)} AS en, {_hits(fixed.PORTUGUESE_WORDS)} AS pt
  FROM (SELECT page_id, title, content, title || ' ' || {d.strip('content')} AS text FROM (SELECT page_id, {d.RAW_TITLE} AS title, '<p>' || {_ART} || '</p>' AS content FROM pages))))""")
def content_translation(spark, folder):
    """Title and article of every page; the stub puts its mark in front, tags keep their places."""
    p = d.plain_pages(spark, folder)
    article = F.concat(F.lit("<p>"), F.regexp_extract("html", "(?is)<article>(.*?)</article>", 1), F.lit("</p>"))
    docs = p.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), article.alias("content"))
    out, _ = tr.translate_content(docs, d.cache(spark, folder), d.NOW, key="page_id")
    return out.select("page_id", "translated", "title", F.md5("content").alias("content_md5"))


# --- rewriting ---------------------------------------------------------------------

@check("rewrite_eligible", f"""
SELECT doc_id, words, CASE WHEN lang = 'fr' THEN '{fixed.REWRITE_DISABLED_ERROR}' WHEN words < 30 THEN '{fixed.REWRITE_SHORT_ERROR}' END AS reason
FROM (SELECT doc_id, lang, {d.words(d.strip_all('text'))} AS words FROM documents)""")
def rewrite_eligible(spark, folder):
    ready = rw.prepare(_docs(spark, folder), "text")
    reason = rw.eligibility(F.col("lang") != "fr", F.lit("custom"), F.lit(True))
    return ready.select("doc_id", "words", reason.alias("reason"))


@check("rewrite_targets", f"""
SELECT doc_id, CAST(greatest(200, round(words * 0.85::DOUBLE)) AS BIGINT) AS min_words, CAST(greatest(800, round(words * 1.3::DOUBLE)) AS BIGINT) AS max_words
FROM (SELECT doc_id, {d.words('text')} AS words FROM documents)""")
def rewrite_targets(spark, folder):
    low, high = rw.word_targets(tx.word_count("text"))
    return _docs(spark, folder).select("doc_id", low.alias("min_words"), high.alias("max_words"))


def _prompt_sql() -> str:
    rule = fixed.LANGUAGE_RULE.replace("{language}", "inglês")
    slots = {
        "tone": f"CASE WHEN lang = 'de' THEN '{fixed.TONES['institucional']}' ELSE '{fixed.TONES['jornalistico']}' END",
        "language_rule": f"CASE WHEN lang = 'es' THEN '{rule}' ELSE '' END",
        "media_rule": f"CASE WHEN lang = 'fr' THEN '{fixed.MEDIA_RULE}' ELSE '' END",
        "min_words": "CAST(greatest(200, round(words * 0.85::DOUBLE)) AS BIGINT)",
        "max_words": "CAST(greatest(800, round(words * 1.3::DOUBLE)) AS BIGINT)",
        "title": "('Doc ' || doc_id)", "content": "text", "word_count": "words",
        "media_count": "CASE WHEN lang = 'fr' THEN 2 ELSE 0 END",
    }
    parts = re.split(r"\{(\w+)\}", fixed.PROMPT_TEMPLATE)
    return " || ".join(f"({slots[p]})" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


@check("rewrite_prompts", f"SELECT doc_id, md5({_prompt_sql()}) AS prompt_md5 FROM (SELECT *, {d.words('text')} AS words FROM documents)")
def rewrite_prompts(spark, folder):
    prompt = rw.build_prompt(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.col("text"), tx.word_count("text"),
        F.when(F.col("lang") == "fr", 2).otherwise(0), F.col("lang") == "es",
        F.when(F.col("lang") == "de", "institucional").otherwise("unknown"), F.lit("en"))
    return _docs(spark, folder).select("doc_id", F.md5(prompt).alias("prompt_md5"))


def _answers(docs):
    """Raw model answers: plain, fenced, wrapped in prose, broken, empty, without a title."""
    did = F.col("doc_id").cast("string")
    title = F.when(F.col("lang") == "es", "").otherwise(F.concat(F.lit("T"), did))
    body = F.concat(F.lit('{"title":"'), title, F.lit('","meta_description":"M'), did, F.lit('","content":"<p>C'), did, F.lit('</p>"}'))
    step = F.col("n_chars") % 6
    return docs.withColumn(
        "raw",
        F.when(step == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(step == 1, F.concat(F.lit("Sure: "), body, F.lit(" done")))
        .when(step == 2, F.concat(F.lit("{broken "), did)).when(step == 3, "").otherwise(body))


_ANSWER = """(SELECT doc_id, text, CASE n_chars % 6 WHEN 2 THEN 'A IA retornou um formato inválido. Tente novamente.' WHEN 3 THEN 'Resposta vazia da API.' END AS error,
  CASE WHEN n_chars % 6 NOT IN (2, 3) THEN CASE WHEN lang = 'es' THEN '' ELSE 'T' || doc_id END END AS title,
  CASE WHEN n_chars % 6 NOT IN (2, 3) THEN 'M' || doc_id END AS meta_description, CASE WHEN n_chars % 6 NOT IN (2, 3) THEN '<p>C' || doc_id || '</p>' END AS content FROM documents)"""


@check("rewrite_parse", f"SELECT doc_id, title, meta_description, content, error FROM {_ANSWER}")
def rewrite_parse(spark, folder):
    rows = _answers(_docs(spark, folder)).select("doc_id", rw.parse_response("raw").alias("p"))
    return rows.select("doc_id", "p.answer.title", "p.answer.meta_description", "p.answer.content", "p.error")


@check("rewrite_apply", f"""
SELECT doc_id, coalesce(nullif(title, ''), 'Old ' || doc_id) AS title, md5(coalesce(content, text)) AS content_md5, coalesce(meta_description, '') AS meta_description FROM {_ANSWER}""")
def rewrite_apply(spark, folder):
    rows = _answers(_docs(spark, folder)).select(
        "doc_id", F.concat(F.lit("Old "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), rw.parse_response("raw").alias("parsed"))
    return rw.apply_rewrite(rows).select("doc_id", "title", F.md5("content").alias("content_md5"), "meta_description")


@check("rewrite_run", f"""
SELECT doc_id, CASE WHEN words < 30 THEN '{fixed.REWRITE_SHORT_ERROR}' WHEN n % 5 = 0 THEN '{fixed.REWRITE_EMPTY_ERROR}' ELSE '' END AS rewrite_error,
  CASE WHEN words < 30 OR n % 5 = 0 THEN 'Doc ' || doc_id ELSE 'R' || n END AS title
FROM (SELECT doc_id, words, length({_prompt_sql().replace("CASE WHEN lang = 'de' THEN '" + fixed.TONES['institucional'] + "' ELSE", "CASE WHEN false THEN '' ELSE").replace("CASE WHEN lang = 'es'", "CASE WHEN false").replace("CASE WHEN lang = 'fr'", "CASE WHEN false")}) AS n
  FROM (SELECT doc_id, text, {d.words('text')} AS words FROM (SELECT doc_id, {d.strip_all('text')} AS text FROM documents)))""")
def rewrite_run(spark, folder):
    docs = _docs(spark, folder).select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"))
    return rw.rewrite_documents(docs, rw.offline_rewrite).select("doc_id", "rewrite_error", "title")
