"""Translation with a cache table and a user-supplied batch function.

Only distinct texts that the cache does not know reach the function, each once,
and its answers are stored before anything else uses them, so a lost executor
or a second output never calls the service again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import byte_len, is_blank, let, strip_tags, trimmed
from newsloom.functions.dates import moment
from newsloom.functions.text import detect_language
from newsloom.operators.markup import (
    html_sections,
    protect,
    restore_protected,
    restore_tags,
    section_pieces,
    tags_to_tokens,
    text_chunks,
)
from newsloom.session import spread_for_calls, stage

# (texts, source language, target language) -> translations, None where it failed
TranslateFn = Callable[[list[str], str, str], list[str | None]]


def offline_translate(texts: list[str], source: str, target: str) -> list[str | None]:
    """A stand-in without any service: marks the text with the target language."""
    return [f"[{target}] {text}" for text in texts]


def service_chain(*services: TranslateFn) -> TranslateFn:
    """Ask the services in order; each later one gets what the earlier ones failed on."""

    def ask(texts: list[str], source: str, target: str) -> list[str | None]:
        out: list[str | None] = [None] * len(texts)
        for service in services:
            open_places = [i for i, value in enumerate(out) if not value]
            if not open_places:
                break
            try:
                answers = service([texts[i] for i in open_places], source, target)
            except Exception:  # a service that is down hands over to the next one
                continue
            for place, answer in zip(open_places, answers, strict=True):
                out[place] = answer or None
        return out

    return ask


# --- cache -----------------------------------------------------------------

CACHE_SCHEMA = "key string, value string, cached_at timestamp_ntz"
# a table of entries, or what gives the entries of the asked keys (a table with the column ``key``)
Cache = DataFrame | Callable[[DataFrame], DataFrame]


def cache_key(text, source, target, kind) -> Column:
    return F.md5(F.concat(text, source, target, kind))


def newest_entries(cache: DataFrame) -> DataFrame:
    """One entry per key, the newest; of equally old ones the largest value."""
    newest = F.max(F.struct("cached_at", "value"))
    return cache.groupBy("key").agg(newest.alias("_e")).select("key", "_e.value", "_e.cached_at")


def _alive(now, days: int = fixed.CACHE_TTL_DAYS) -> Column:
    return F.col("cached_at") > moment(now) - F.make_dt_interval(F.lit(days))


def entries_among(cache: Cache, asked: DataFrame, now, key: str = "key") -> DataFrame:
    """(key, value) of the unexpired entries of the asked keys: the cache only grows, a run asks for little of it."""
    keys = asked.select(F.col(key).alias("key")).distinct()
    if callable(cache):
        entries = cache(keys)
    else:
        entries = cache.join(keys.select(F.col("key").alias("_asked")), F.col("key") == F.col("_asked"), "left_semi")
    return newest_entries(entries.where(_alive(now))).select("key", "value")


def cache_lookup(texts: DataFrame, cache: Cache, now, key: str = "key") -> DataFrame:
    """Add ``cached``, the stored translation or null."""
    found = entries_among(cache, texts, now, key).select(F.col("key").alias("_key"), F.col("value").alias("cached"))
    return texts.join(found, texts[key] == found["_key"], "left").drop("_key")


def unknown_texts(texts: DataFrame, known: DataFrame, *carried: str, key: str = "key") -> DataFrame:
    """Distinct keys that ``known(key)`` lacks, with their text.

    Copies are folded together before the join, so a text with very many copies
    is one row by the time anything is shuffled for it.
    """
    distinct = texts.groupBy(key).agg(*[F.any_value(c).alias(c) for c in carried])
    return distinct.join(known.select(F.col("key").alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def pending_texts(texts: DataFrame, cache: Cache, now, *carried: str, key: str = "key") -> DataFrame:
    """Distinct keys the cache does not know, with their text."""
    return unknown_texts(texts, entries_among(cache, texts, now, key), *carried, key=key)


def new_entries(translated: DataFrame, now) -> DataFrame:
    """The cache entries of (key, text, value) rows whose value is worth keeping: not blank, not the text itself."""
    worth = translated.where(~is_blank("value") & (F.col("value") != F.col("text")))
    return worth.select("key", "value", moment(now).alias("cached_at"))


# --- calling the service ---------------------------------------------------

def call_service(pending: DataFrame, fn: TranslateFn) -> DataFrame:
    """(key, text, source_lang, target_lang) -> the same with ``value`` and ``error``.

    Where the function fails on a batch, its texts are asked one by one; those it still fails on get an error.
    """

    def ask(texts: list[str], source: str, target: str) -> list[tuple[str | None, str | None]]:
        try:
            return [(value, None) for _, value in zip(texts, fn(texts, source, target), strict=True)]
        except Exception as error:  # the service's own failures are data here
            if len(texts) == 1:
                return [(None, str(error) or type(error).__name__)]
            return [ask([text], source, target)[0] for text in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (source, target), part in batch.groupby(["source_lang", "target_lang"], sort=False):
                values, errors = zip(*ask(part["text"].tolist(), source, target), strict=True)
                yield part.assign(
                    value=pd.Series(values, index=part.index, dtype=object), error=pd.Series(errors, index=part.index, dtype=object)
                )

    columns = "key string, text string, source_lang string, target_lang string"
    calls = spread_for_calls(pending.select("key", "text", "source_lang", "target_lang"), "key")
    return calls.mapInPandas(run, f"{columns}, value string, error string")


# --- units -----------------------------------------------------------------

def _no_markup() -> Column:
    """Only pieces that go with their tags need their markup again."""
    return F.lit(None).cast("string")


def _unit(kind: str, markup: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("unit_kind"), markup.alias("markup"), text.alias("unit_text"))


def text_units(text: Column) -> Column:
    """A text in the pieces that are sent: itself, or its chunks."""
    return F.when(
        byte_len(text) > fixed.LARGE_TEXT_BYTES,
        F.transform(text_chunks(text), lambda c: _unit("text", _no_markup(), c)),
    ).otherwise(F.array(_unit("text", _no_markup(), text)))


def html_units(markup: Column) -> Column:
    """A protected page text in the pieces that are sent, by size of the parts.

    The plain text of a large piece is cut into chunks like any other text; its parts are one paragraph again.
    """

    def by_tags(part: Column) -> Column:
        return _unit("tags", part, tags_to_tokens(part))

    def plain_units(plain: Column) -> Column:
        long = (byte_len(plain) > fixed.LARGE_TEXT_BYTES) & (trimmed(plain) != "")
        chunks = F.when(long, text_chunks(plain)).otherwise(F.array(plain))
        kind = lambda i, n: (
            F.when(n == 1, "plain").when(i == 0, "plain_first").when(i == n - 1, "plain_last").otherwise("plain_middle")
        )
        return let(chunks, lambda cs: F.transform(
            cs, lambda c, i: F.struct(kind(i, F.size(cs)).alias("unit_kind"), _no_markup().alias("markup"), c.alias("unit_text"))
        ))

    def piece(part: Column) -> Column:
        return F.when(byte_len(part) > fixed.LARGE_PIECE_BYTES, plain_units(strip_tags(part))).otherwise(F.array(by_tags(part)))

    def section(part: Column) -> Column:
        return F.when(
            byte_len(part) > fixed.LARGE_SECTION_BYTES,
            F.flatten(F.transform(F.filter(section_pieces(part), lambda p: p != ""), piece)),
        ).otherwise(F.array(by_tags(part)))

    parts = F.filter(F.transform(html_sections(markup), lambda p: trimmed(p)), lambda p: p != "")
    return F.when(
        byte_len(markup) > fixed.LARGE_HTML_BYTES, F.flatten(F.transform(parts, section))
    ).otherwise(F.array(by_tags(markup)))


def unit_result() -> Column:
    """A unit's translation in its place: tags back in, plain pieces as paragraphs."""
    value = F.coalesce(F.when(~is_blank("value"), F.col("value")), F.col("unit_text"))
    tagged = F.when(is_blank("value"), F.col("markup")).otherwise(
        restore_tags(value, "markup")
    )
    return (
        F.when(F.col("unit_kind") == "tags", tagged)
        .when(F.startswith("unit_kind", F.lit("plain")), F.concat(
            F.when(F.col("unit_kind").isin("plain", "plain_first"), "<p>").otherwise("\n\n"),
            value,
            F.when(F.col("unit_kind").isin("plain", "plain_last"), "</p>").otherwise(""),
        ))
        .otherwise(value)
    )


# --- whole tables ----------------------------------------------------------

@dataclass(frozen=True)
class Translation:
    values: DataFrame    # the input rows with ``value``
    entries: DataFrame   # new cache entries: key, text, value
    errors: DataFrame    # texts the service failed on: key, text, error


def translate_rows(rows: DataFrame, cache: Cache, now, fn: TranslateFn = offline_translate) -> Translation:
    """Translate (kind, text, source_lang, target_lang) rows; ``kind`` is ``text`` or ``html``.

    Blank texts and texts in the target language already come back as they are.
    """
    keyed = rows.withColumn("key", cache_key(F.col("text"), F.col("source_lang"), F.col("target_lang"), F.col("kind")))
    sought = ~is_blank("text") & (F.col("source_lang") != F.col("target_lang"))
    wanted = keyed.where(sought)
    carried = ("kind", "text", "source_lang", "target_lang")
    # the cache is asked for the run's own keys only, and what is known and what is missing is written once
    asked = stage(wanted.select("key").distinct(), "asked-keys")
    cached = stage(entries_among(cache, asked, now), "cached-texts")
    is_html = F.col("kind") == "html"
    missing = protect(unknown_texts(wanted, cached, *carried), "text")
    # each text is written once: plain texts have no protected form, answers and results no copy of their text
    missing = stage(missing.withColumns({c: F.when(is_html, F.col(c)) for c in ("protected", "tokens")}), "missing-texts")
    # a text that is sent as it is lies in ``missing`` already; only the pieces of the others are written
    as_it_is = (F.col("kind") == "text") & ~(byte_len("text") > fixed.LARGE_TEXT_BYTES)
    pieces = missing.where(~as_it_is).withColumn(
        "_units", F.when(is_html, html_units(F.col("protected"))).otherwise(text_units(F.col("text")))
    ).select("key", "source_lang", "target_lang", F.posexplode("_units").alias("place", "_unit"))
    pieces = stage(pieces.select("key", "source_lang", "target_lang", "place", "_unit.*"), "units")
    wholes = missing.where(as_it_is).select("key", "source_lang", "target_lang", F.lit(0).alias("place"), _unit("text", _no_markup(), F.col("text")).alias("_unit"))
    units = pieces.unionByName(wholes.select("key", "source_lang", "target_lang", "place", "_unit.*"))
    unit_kind = F.when(F.col("unit_kind") == "tags", "tags").otherwise("text")
    units = units.withColumn("unit_key", cache_key(F.col("unit_text"), F.col("source_lang"), F.col("target_lang"), unit_kind))
    cached_units = stage(entries_among(cache, units, now, "unit_key"), "cached-units")

    to_send = unknown_texts(
        units.where(~is_blank(trimmed("unit_text"))).select(
            F.col("unit_key").alias("key"), F.col("unit_text").alias("text"), "source_lang", "target_lang"
        ),
        cached_units, "text", "source_lang", "target_lang",
    )
    answers = stage(call_service(to_send, fn).select("key", "value", "error"), "translations")
    known = answers.select(F.col("key").alias("_key"), "value").unionByName(
        cached_units.select(F.col("key").alias("_key"), "value")
    )
    done = units.join(known, units["unit_key"] == known["_key"], "left").select("key", "place", "unit_kind", unit_result().alias("out"))
    joined = done.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("place", "out"))).alias("_parts"), F.max("unit_kind").alias("_kind")
    )
    pieces = F.transform("_parts", lambda p: p["out"])
    whole = joined.select(
        F.col("key").alias("_key"),
        F.when(F.col("_kind") == "text", F.array_join(pieces, "\n\n")).otherwise(F.array_join(pieces, "")).alias("_out"),
    )
    # a text that was sent as it is has come back whole
    bare = missing.withColumn("text", F.when(~as_it_is, F.col("text")))
    assembled = bare.join(whole, bare["key"] == whole["_key"], "left")
    unchanged = F.col("_out").isNull() | (F.col("_out") == F.col("protected"))
    assembled = assembled.select(
        "key",
        F.when(is_html & unchanged, F.col("text")).when(is_html, restore_protected(F.col("_out"), F.col("tokens")))
        .otherwise(F.coalesce("_out", "text")).alias("value"),
    )
    assembled = stage(assembled, "assembled")
    all_known = assembled.select(F.col("key").alias("_key"), "value").unionByName(cached.select(F.col("key").alias("_key"), "value"))
    # a wanted text has its value there and need not go along to meet it, unless the cache holds nulls
    has_value = F.lit(False) if cached.where(F.col("value").isNull()).take(1) else F.coalesce(sought & F.col("key").isNotNull(), F.lit(False))
    light = keyed.withColumn("_own", F.when(~has_value, F.col("text")))
    values = light.join(all_known, (light["key"] == all_known["_key"]) & (F.col("source_lang") != F.col("target_lang")), "left")
    values = values.select(*rows.columns, F.coalesce("value", "_own").alias("value"))
    sent = units.select(F.col("unit_key").alias("_key"), F.col("unit_text").alias("text"))
    texts = missing.select(F.col("key").alias("_key"), "text").unionByName(sent)
    found = assembled.unionByName(answers.select("key", "value")).where(~is_blank("value"))
    entries = (
        found.join(texts, F.col("key").eqNullSafe(F.col("_key"))).where(F.col("value") != F.col("text"))
        .groupBy("key").agg(F.any_value("text").alias("text"), F.any_value("value").alias("value"))
    )
    failed = answers.where(F.col("error").isNotNull()).select("key", "error")
    errors = failed.join(sent.dropDuplicates(["_key"]), F.col("key").eqNullSafe(F.col("_key"))).select("key", "text", "error")
    return Translation(values, entries, errors)


def translate_content(
    docs: DataFrame, cache: Cache, now, fn: TranslateFn = offline_translate,
    target: str = "pt", source: str | None = None, key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Title, content (HTML) and excerpt of documents; ``translated`` tells if title or content changed.

    The source language is found per document unless given.  ``docs`` may carry
    a ``translate`` flag.  Returns the documents and the new cache entries.
    """
    wanted = F.coalesce(F.col("translate"), F.lit(False)) if "translate" in docs.columns else F.lit(True)
    combined = F.concat_ws(" ", "title", strip_tags("content"))
    language = F.lit(source) if source else detect_language(combined)
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.col(name).alias("text"))
        for name, kind in (("title", "text"), ("content", "html"), ("excerpt", "text"))
    ])
    base = docs if "excerpt" in docs.columns else docs.withColumn("excerpt", F.lit(""))
    spoken = base.withColumn("source_lang", F.when(wanted, language).otherwise(target))
    rows = spoken.select(key, "source_lang", F.lit(target).alias("target_lang"), F.inline(fields))
    result = translate_rows(rows, cache, now, fn)
    wide = result.values.groupBy(key).agg(*[
        F.max(F.when(F.col("field") == name, F.col("value"))).alias(f"_{name}") for name in ("title", "content", "excerpt")
    ])
    out = base.join(wide, key, "left")
    changed = F.lit(False)
    for name in ("title", "content"):
        changed = changed | F.coalesce(F.col(f"_{name}") != F.col(name), F.lit(False))
    out = out.withColumn("translated", changed)
    for name in ("title", "content", "excerpt"):
        out = out.withColumn(name, F.coalesce(F.col(f"_{name}"), F.col(name)))
    return out.select(*base.columns, "translated"), result.entries
