"""What can be read from a page's markup without building its tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.basics import all_matches, as_col, first_match, trimmed
from newsloom.functions.text import decode_entities, paragraphs_to_html
from newsloom.functions.urls import absolute_url, url_basename, url_path


def page_charset(html) -> Column:
    return F.coalesce(F.upper(trimmed(first_match(html, fixed.CHARSET_PATTERN))), F.lit("UTF-8"))


def title_from_url(url, default: str = fixed.DEFAULT_TITLE) -> Column:
    """Words of the last path part, first letters raised, the others as they are."""
    words = F.split(F.translate(url_basename(url), "-_", "  "), " ", -1)
    raised = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
    )
    return F.when(raised.isin("", "0"), default).otherwise(raised)


def page_title(html, url, default: str = fixed.DEFAULT_TITLE) -> Column:
    found = F.coalesce(first_match(html, fixed.TITLE_PATTERN), first_match(html, fixed.OG_TITLE_PATTERN))
    return F.coalesce(trimmed(decode_entities(found)), title_from_url(url, default))


def jsonld_body(html) -> Column:
    """The article body given in the first JSON-LD script, as paragraphs; else null."""
    script = first_match(html, fixed.JSONLD_PATTERN)
    return paragraphs_to_html(F.get_json_object(script, "$.articleBody"))


def featured_image(html, url) -> Column:
    return F.coalesce(absolute_url(first_match(html, fixed.OG_IMAGE_PATTERN), url), F.lit(""))


def page_images(html, url) -> Column:
    """Absolute image addresses in page order, each once, image file types only."""
    found = F.transform(all_matches(html, fixed.IMG_SRC_PATTERN, 1), lambda src: absolute_url(src, url))
    return F.array_distinct(F.filter(found, lambda u: url_path(u).rlike(fixed.IMAGE_PATH_PATTERN)))


def page_metadata(html) -> Column:
    found = first_match(html, fixed.DESCRIPTION_PATTERN)
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(found.isNotNull(), F.create_map(F.lit("description"), found)).otherwise(empty)


def clean_attributes(html) -> Column:
    """Inline styles and event handlers out, white space collapsed."""
    out = F.regexp_replace(as_col(html), fixed.STYLE_ATTR_PATTERN, "")
    out = F.regexp_replace(out, fixed.HANDLER_ATTR_PATTERN, "")
    return trimmed(F.regexp_replace(out, r"\s+", " "))
