"""Small building blocks shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIM_CHARS = " \t\n\r\0\x0b"

# a comment, a tag, or a tag left open at the end of the text
TAG = r"(?s)<!--.*?-->|<(?:[^\s>][^>]*)?(?:>|\z)"
SCRIPT_BODY = r"(?is)<script[^>]*>.*?</script>"
STYLE_BODY = r"(?is)<style[^>]*>.*?</style>"


def as_col(value) -> Column:
    """Strings name columns; Columns pass through."""
    return F.col(value) if isinstance(value, str) else value


def let(value, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times in ``body``."""
    return F.transform(F.array(as_col(value)), body).getItem(0)


def is_blank(value) -> Column:
    """Null, the empty string and ``'0'`` all count as empty."""
    value = as_col(value)
    return value.isNull() | value.isin("", "0")


def or_default(value, default) -> Column:
    """``default`` where the value is blank."""
    value = as_col(value)
    return F.when(is_blank(value), default).otherwise(value)


def byte_len(value) -> Column:
    return F.octet_length(as_col(value)).cast("long")


def trimmed(value) -> Column:
    return F.trim(as_col(value), F.lit(TRIM_CHARS))


def strip_tags(value) -> Column:
    """Text with the tags and comments taken out."""
    value = as_col(value)
    # most texts have no tag at all: looking for the bracket is far cheaper than the pattern
    return F.when(F.contains(value, F.lit("<")), F.regexp_replace(value, TAG, "")).otherwise(value)


def strip_all_tags(value) -> Column:
    """As ``strip_tags``, with script and style bodies gone too, then trimmed."""
    out = F.regexp_replace(as_col(value), SCRIPT_BODY, "")
    out = F.regexp_replace(out, STYLE_BODY, "")
    return trimmed(strip_tags(out))


def first_match(value, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null when nothing matches."""
    hit = F.regexp_extract(as_col(value), pattern, group)
    return F.when(as_col(value).rlike(pattern), hit)


def all_matches(value, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_col(value), F.lit(pattern), F.lit(group))


def replace_matches(value, pattern: str, token: Callable[..., Column]) -> Column:
    """Replace every match by ``token(match)`` or ``token(match, index)``.

    The text between matches and the matches themselves are laid side by side
    and joined again, so a match is replaced at its own place only, even where
    one match is a part of another.
    """

    def body(text: Column) -> Column:
        tokens = F.transform(all_matches(text, pattern), token)
        return F.array_join(
            F.zip_with(
                F.split(text, pattern, -1),
                tokens,
                lambda between, tok: F.concat(between, F.coalesce(tok, F.lit(""))),
            ),
            "",
        )

    return let(value, body)


def replace_found(text, pattern: str, found, token: Callable[..., Column]) -> Column:
    """``replace_matches`` where the matches are known already: ``found`` is ``all_matches(text, pattern)``."""
    text, found = as_col(text), as_col(found)
    laid = F.zip_with(
        F.split(text, pattern, -1), F.transform(found, token),
        lambda between, tok: F.concat(between, F.coalesce(tok, F.lit(""))),
    )
    return F.when(F.size(found) > 0, F.array_join(laid, "")).otherwise(text)


def restore_numbered(value, pattern: str, originals, around: str = "") -> Column:
    """Numbered tokens back into what they stand for: the number is the place in ``originals``.

    The text is cut at the tokens once, so the work grows with the text and not with text times tokens.  A token
    without an original stays.
    """

    def one(token: Column) -> Column:
        original = F.get(as_col(originals), F.regexp_extract(token, r"\d+", 0).try_cast("int"))
        return F.coalesce(F.concat(F.lit(around), original, F.lit(around)), token)

    return replace_matches(value, pattern, one)


_HALVES = [1 << k for k in reversed(range(24))]


def lookup_sorted(entries: Column, key: Column, name: str, value: str) -> Column:
    """``value`` of the entry (an array of structs, sorted by ``name``) whose ``name`` is ``key``; else null.

    By halving, as a map would be searched from end to end.
    """

    def step(at: Column, half: Column) -> Column:
        below = F.coalesce(F.get(entries, at + half - 1)[name] <= key, F.lit(False))
        return F.when(below, at + half).otherwise(at)

    steps = F.filter(F.array(*map(F.lit, _HALVES)), lambda half: half <= F.size(entries))
    found = F.get(entries, F.aggregate(steps, F.lit(0), step) - 1)
    return F.when(found[name] == key, found[value])


def hash_id(*parts) -> Column:
    """A repeatable 60-bit number for a row, for use where a counter cannot be had."""
    digest = F.md5(F.concat_ws("|", *[as_col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
