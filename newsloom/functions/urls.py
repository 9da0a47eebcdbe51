"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.basics import as_col

# Parts are cut out by pattern: the strict URL parser gives up on the non-ASCII
# and otherwise sloppy links that feeds are full of.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def _part(url, pattern: str) -> Column:
    found = F.regexp_extract(as_col(url), pattern, 1)
    return F.when(found != "", found)


def url_scheme(url) -> Column:
    return _part(url, SCHEME)


def url_host(url) -> Column:
    return _part(url, HOST)


def url_path(url) -> Column:
    return _part(url, PATH)


def bare_host(url) -> Column:
    """The host without ``www.``, wherever in the host that stands."""
    return F.replace(url_host(url), F.lit("www."), F.lit(""))


def url_basename(url) -> Column:
    """Last part of the path; slashes at the end do not count."""
    path = F.regexp_replace(F.coalesce(url_path(url), F.lit("")), "/+$", "")
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _root(base) -> Column:
    return F.concat(
        F.coalesce(url_scheme(base), F.lit("https")), F.lit("://"), F.coalesce(url_host(base), F.lit(""))
    )


def absolute_url(url, base) -> Column:
    """Absolute form of ``url``; a relative one hangs on the host root."""
    url = as_col(url)
    return (
        F.when(url.isNull() | url.isin("", "0") | url.rlike("(?i)^https?://"), url)
        .when(url.startswith("//"), F.concat(F.coalesce(url_scheme(base), F.lit("https")), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(_root(base), url))
        .otherwise(F.concat(_root(base), F.lit("/"), url))
    )


def resolve_url(url, base) -> Column:
    """Absolute form of ``url``; a relative one hangs on the folder of the base path."""
    url = as_col(url)
    path = F.coalesce(url_path(base), F.lit("/"))
    # the folder of '/a/b/' is '/a'; the folder of '/a' and of '/' is '/'
    trimmed = F.regexp_replace(path, "(.)/+$", "$1")
    folder = F.regexp_replace(trimmed, "/+[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(url.rlike("^https?://"), url)
        .when(url.startswith("/"), F.concat(_root(base), url))
        .otherwise(F.concat(_root(base), folder, F.lit("/"), url))
    )
