"""Parts of a text set aside before it goes to a translator or rewriter, and put back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import (
    all_matches,
    as_col,
    byte_len,
    let,
    lookup_sorted,
    replace_found,
    replace_matches,
    restore_numbered,
    strip_all_tags,
    trimmed,
)


# --- addresses and code blocks --------------------------------------------

def _hash_token(kind: str) -> Callable[[Column], Column]:
    def token(match: Column) -> Column:
        return F.concat(F.lit(f"###{kind}_"), F.md5(match), F.lit("###"))

    return token


def _token_pairs(matches: Column, token: Callable[[Column], Column]) -> Column:
    return F.transform(matches, lambda m: F.struct(token(m).alias("token"), m.alias("original")))


# what a text has to hold for a pattern to match at all; looking for it is far cheaper than the pattern
_SIGNS = {"URL": "://", "EMAIL": "@", "CODE": "<code", "PRE": "<pre"}


def _matches_if(text: Column, sign: str, pattern: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.contains(F.lower(text), F.lit(sign)), all_matches(text, pattern)).otherwise(none)


def protect(df: DataFrame, column: str, text: str = "protected", tokens: str = "tokens") -> DataFrame:
    """Replace URLs, e-mail addresses, code and preformatted blocks by hash tokens.

    ``tokens`` is an array of (token, original), in the order they were made; the original of a code block may
    hold tokens of addresses, and that of a preformatted block those of code.
    """
    df = df.withColumn(text, F.col(column))
    found = []
    for step, (kind, pattern) in enumerate(fixed.PROTECTED):
        token = _hash_token(kind)
        name = f"_found{step}"
        df = df.withColumn(name, _matches_if(F.col(text), _SIGNS[kind], pattern))
        df = df.withColumn(text, replace_found(text, pattern, name, token))
        found.append(_token_pairs(F.array_distinct(name), token))
    df = df.withColumn(tokens, F.concat(*found))
    return df.drop(*[f"_found{i}" for i in range(len(fixed.PROTECTED))])


def restore_protected(value, tokens) -> Column:
    """Each token becomes its own original, wherever it ended up in the text.

    Originals that hold tokens themselves (code, preformatted blocks) are made whole first; then the text is cut at
    its tokens once.
    """

    def restored(text: Column, entries: Column) -> Column:
        return replace_matches(
            text, fixed.PROTECTED_TOKEN, lambda m: F.coalesce(lookup_sorted(entries, m, "token", "original"), m)
        )

    def whole(entries: Column) -> Column:
        return F.transform(entries, lambda t: F.struct(
            t["token"].alias("token"),
            F.when(F.contains(t["original"], F.lit("###")), restored(t["original"], entries)).otherwise(t["original"]).alias("original"),
        ))

    nested = lambda entries: F.exists(entries, lambda t: F.contains(t["original"], F.lit("###")))

    def by(entries: Column) -> Column:
        # a preformatted block may hold code that holds an address: two rounds
        done = F.when(nested(entries), let(whole(entries), whole)).otherwise(entries)
        return let(done, lambda e: restored(as_col(value), e))

    return F.when(F.size(as_col(tokens)) > 0, let(F.sort_array(as_col(tokens)), by)).otherwise(as_col(value))


# --- tags ------------------------------------------------------------------

def tags_to_tokens(value) -> Column:
    """Tags as numbered tokens with a space on both sides."""
    return replace_matches(
        value, fixed.ANY_TAG, lambda m, i: F.concat(F.lit(" ###TAG_"), i.cast("string"), F.lit("### "))
    )


def restore_tags(value, markup) -> Column:
    """Tag tokens back into the tags of the text they were made from."""
    return let(all_matches(markup, fixed.ANY_TAG), lambda tags: restore_numbered(value, fixed.TAG_TOKEN, tags))


# --- media -----------------------------------------------------------------

def _numbered_token(first: Column) -> Callable[[Column, Column], Column]:
    def token(match: Column, i: Column) -> Column:
        return F.concat(F.lit(" [[MEDIA_ITEM_"), (first + i).cast("string"), F.lit("]] "))

    return token


_MEDIA_SIGNS = ("<img", "<iframe", "<video", "<blockquote")


def media_placeholders(df: DataFrame, column: str, text: str = "media_text", media: str = "media") -> DataFrame:
    """Replace media by numbered placeholders, images first, and strip the other tags.

    ``media`` is an array of (token, original) in number order.
    """
    df = df.withColumn(text, F.col(column))
    count: Column = F.lit(0)
    names = []
    for step, (pattern, sign) in enumerate(zip(fixed.MEDIA_PATTERNS, _MEDIA_SIGNS, strict=True)):
        name = f"_media{step}"
        df = df.withColumn(name, _matches_if(F.col(text), sign, pattern))
        df = df.withColumn(text, replace_found(text, pattern, name, _numbered_token(count)))
        names.append(name)
        count = count + F.size(name)
    numbered = F.transform(
        F.concat(*[F.col(n) for n in names]),
        lambda m, i: F.struct(
            F.concat(F.lit("[[MEDIA_ITEM_"), i.cast("string"), F.lit("]]")).alias("token"), m.alias("original")
        ),
    )
    return df.withColumn(media, numbered).withColumn(text, strip_all_tags(F.col(text))).drop(*names)


def restore_media(value, media) -> Column:
    """Each placeholder becomes its media element on lines of its own."""
    originals = F.transform(as_col(media), lambda m: m["original"])
    return let(originals, lambda found: restore_numbered(value, fixed.MEDIA_TOKEN, found, "\n\n"))


def media_counts(value) -> dict[str, Column]:
    """Number of images, iframes, videos and embeds."""
    names = ("images", "iframes", "videos", "embeds")
    return {
        name: F.size(all_matches(value, pattern)).cast("long")
        for name, pattern in zip(names, fixed.MEDIA_PATTERNS, strict=True)
    }


# --- long texts ------------------------------------------------------------

def text_parts(value) -> Column:
    """Paragraphs, or sentences when there is one paragraph only; trimmed, blanks dropped."""

    def split_up(text: Column) -> Column:
        def usable(parts: Column) -> Column:
            return F.filter(F.transform(parts, lambda p: trimmed(p)), lambda p: ~p.isin("", "0"))

        return let(
            F.split(text, fixed.PARAGRAPH_END, -1),
            lambda paragraphs: F.when(F.size(paragraphs) > 1, usable(paragraphs)).otherwise(
                usable(F.split(text, fixed.SENTENCE_END, -1))
            ),
        )

    return let(value, split_up)


def pack_parts(parts, limit: int = fixed.CHUNK_BYTES) -> Column:
    """Parts joined by blank lines while current + next stay within ``limit`` bytes.

    A part above the limit becomes a chunk of its own.
    """

    def add(state: Column, part: Column) -> Column:
        full = byte_len(state["open"]) + byte_len(part) > limit
        return (
            F.when(state["open"] == "", F.struct(state["done"].alias("done"), part.alias("open")))
            .when(full, F.struct(F.array_append(state["done"], state["open"]).alias("done"), part.alias("open")))
            .otherwise(
                F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit("\n\n"), part).alias("open"))
            )
        )

    return F.aggregate(
        as_col(parts),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        add,
        lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])),
    )


def text_chunks(value) -> Column:
    """Chunks of a long text; a chunk that is itself very long is split by sentence again."""

    def again(chunk: Column) -> Column:
        return F.when(byte_len(chunk) > fixed.LARGE_TEXT_BYTES, pack_parts(text_parts(chunk))).otherwise(F.array(chunk))

    return F.flatten(F.transform(pack_parts(text_parts(value)), again))


def html_sections(value) -> Column:
    """Pieces cut before headings, paragraphs, divisions, sections and articles."""
    return F.split(as_col(value), fixed.SECTION_START, -1)


def section_pieces(value) -> Column:
    return F.split(as_col(value), fixed.PARAGRAPH_START, -1)
