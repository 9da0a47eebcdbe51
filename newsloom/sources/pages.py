"""Web pages: stored HTML tables and raw files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.basics import as_col
from newsloom.functions.page import page_charset

# charsets the JVM-side decoder knows, with their usual other names
_BUILT_IN = {
    "UTF-8": ("UTF-8", "UTF8"),
    "ISO-8859-1": ("ISO-8859-1", "LATIN1", "ISO8859-1"),
    "US-ASCII": ("US-ASCII", "ASCII"),
    "UTF-16": ("UTF-16", "UTF16"),
}


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan out to all cores when it has fewer splits than there are cores.

    A large table has far more splits than cores and is left as it is (no
    shuffle); a single small file would otherwise be parsed by one task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_pages(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A parquet page table, narrowed to ``columns`` and dealt out for parsing."""
    table = spark.read.parquet(path)
    return spread(table.select(*columns) if columns else table)


@F.pandas_udf(T.StringType())
def _decode_other(content: pd.Series, charset: pd.Series) -> pd.Series:
    def decode(raw, name):
        if raw is None or name is None:
            return None
        try:
            return bytes(raw).decode(name, "replace")
        except LookupError:
            return bytes(raw).decode("utf-8", "replace")

    return pd.Series([decode(r, n) for r, n in zip(content, charset, strict=True)], dtype=object)


def decode_page(content, charset) -> Column:
    """Bytes to text; only charsets without a built-in decoder go through Python."""
    content, charset = as_col(content), as_col(charset)
    out = None
    known = [name for names in _BUILT_IN.values() for name in names]
    for java_name, names in _BUILT_IN.items():
        # the decoder raises on bad input, so broken UTF-8 is mended first
        decoded = F.make_valid_utf8(content.cast("string")) if java_name == "UTF-8" else F.decode(content, java_name)
        out = F.when(charset.isin(*names), decoded) if out is None else out.when(charset.isin(*names), decoded)
    other = ~charset.isin(*known)
    return out.otherwise(_decode_other(F.when(other, content), F.when(other, charset)))


def decode_pages(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``charset`` (from the page's own meta tag) and ``html`` to raw page bytes."""
    # one byte is one character here, which is enough to read the ASCII meta tag
    as_latin = F.decode(F.col(content), "ISO-8859-1")
    return files.withColumn("charset", page_charset(as_latin)).withColumn(
        "html", decode_page(F.col(content), F.col("charset"))
    )


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw page files: ``url`` is the file path, ``html`` the decoded text."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content")
    return decode_pages(files).select("url", "charset", "html")
