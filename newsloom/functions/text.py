"""Text functions: entities, words, language, paragraphs."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import all_matches, as_col, byte_len, let, replace_matches, strip_tags

ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _entity_map() -> Column:
    """The public HTML5 entity table as one constant map."""
    table = {f"&{name}": text for name, text in html.entities.html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character for a code point; null outside the Unicode range."""
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_entities(value) -> Column:
    """Decode named, decimal and hexadecimal character references."""

    def decode(entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"&#[xX]?([0-9a-fA-F]+);", 1)
        numeric = F.when(
            entity.rlike("^&#[xX]"), _code_point(F.conv(digits, 16, 10).cast("long"))
        ).otherwise(_code_point(digits.cast("long")))
        named = F.try_element_at(_entity_map(), entity)
        return F.coalesce(F.when(entity.startswith("&#"), numeric).otherwise(named), entity)

    value = as_col(value)
    return F.when(F.contains(value, F.lit("&")), replace_matches(value, ENTITY, decode)).otherwise(value)


def word_count(value) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens.

    One apostrophe or hyphen at the start of the text and one hyphen at its end
    do not count.
    """
    text = F.regexp_replace(F.regexp_replace(as_col(value), r"^['\-]", ""), r"-\z", "")
    return F.size(all_matches(text, r"[A-Za-z'\-]+")).cast("long")


def language_hits(value, sample_chars: int | None = None) -> Column:
    """Struct (en, pt): how many words of the text are in each list, or of its first ``sample_chars`` characters.

    Very short words never count, so the lists are used without them.
    """

    def listed(words) -> list[str]:
        return [w for w in words if len(w.encode()) >= fixed.LANGUAGE_MIN_WORD_BYTES]

    def count(words: Column) -> Column:
        return F.struct(*[
            F.size(F.filter(words, lambda w: w.isin(known))).cast("long").alias(name)
            for name, known in (("en", listed(fixed.ENGLISH_WORDS)), ("pt", listed(fixed.PORTUGUESE_WORDS)))
        ])

    sample = strip_tags(value) if sample_chars is None else F.substring(strip_tags(value), 1, sample_chars)
    plain = F.lower(F.regexp_replace(sample, r"[0-9\p{P}]", " "))
    return let(F.split(plain, r"\s+"), count)


def language_of(hits: Column) -> Column:
    """``pt`` when Portuguese words clearly lead, otherwise ``en``."""
    leads = (hits["pt"] > hits["en"]) & (hits["pt"] > fixed.LANGUAGE_MIN_HITS)
    return F.when(leads, F.lit("pt")).otherwise(F.lit("en"))


def detect_language(value) -> Column:
    """The language of a text; null text is ``en``."""
    return F.coalesce(let(language_hits(value), language_of), F.lit("en"))


def paragraphs_to_html(value) -> Column:
    """Blank lines separate paragraphs; single line ends become breaks."""
    text = F.regexp_replace(as_col(value), "\r\n?", "\n")
    parts = F.filter(F.split(F.btrim(text, F.lit(" \t\n")), r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\n")) != "")
    wrapped = F.transform(
        parts,
        lambda p: F.concat(
            F.lit("<p>"), F.replace(F.btrim(p, F.lit("\n")), F.lit("\n"), F.lit("<br />\n")), F.lit("</p>\n")
        ),
    )
    return F.array_join(wrapped, "")


def escape_html(value) -> Column:
    out = as_col(value)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def contains_any_word(value, words) -> Column:
    """Case-insensitive keyword filter; an empty list keeps everything."""
    if not words:
        return F.lit(True)
    return F.exists(
        F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(as_col(value)), w)
    )


def translation_route(value, kind: str) -> Column:
    """Which way a text goes, judged by its size in bytes."""
    size = byte_len(value)
    if kind == "text":
        return F.when(size > fixed.LARGE_TEXT_BYTES, "chunks").otherwise("whole")
    if kind == "html":
        return F.when(size > fixed.LARGE_HTML_BYTES, "sections").otherwise("whole")
    if kind == "section":
        return F.when(size > fixed.LARGE_SECTION_BYTES, "pieces").otherwise("tags")
    if kind == "piece":
        return F.when(size > fixed.LARGE_PIECE_BYTES, "plain").otherwise("tags")
    raise ValueError(f"unknown kind: {kind}")
