"""The log table: append, page, count, keep, export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import fixed_values as fixed
from newsloom.functions.basics import as_col, hash_id, strip_all_tags
from newsloom.functions.dates import moment

LOG_FIELDS = ("id", "time", "level", "message", "context")


def log_rows(source: DataFrame, now, level, message, context=None, id_seed: str = "", position: Column | None = None) -> DataFrame:
    """Log rows from any table: level upper-cased, structured context as JSON text.

    Ids are hashes of the row, so writing the same rows twice gives equal ids.  Where equal messages may
    come more than once in a run, ``position`` (a value of the source that no two rows share) keeps their
    ids apart; retention counts on ids that differ.
    """
    if context is None:
        text: Column = F.lit(None).cast("string")
    else:
        context = as_col(context)
        kind = source.select(context.alias("c")).schema["c"].dataType
        nested = isinstance(kind, (T.StructType, T.MapType, T.ArrayType))
        text = F.to_json(context) if nested else strip_all_tags(context.cast("string"))
    rows = source.select(
        moment(now).alias("time"),
        F.upper(strip_all_tags(as_col(level))).alias("level"),
        strip_all_tags(as_col(message)).alias("message"),
        text.alias("context"),
        *([] if position is None else [F.to_json(F.struct(position.alias("p"))).alias("_position")]),
    )
    parts = [F.lit(id_seed), "time", "level", "message", "context", *([] if position is None else ["_position"])]
    return rows.select(hash_id(*parts).alias("id"), *LOG_FIELDS[1:])


def append_logs(rows: DataFrame, path: str) -> None:
    rows.select(*LOG_FIELDS).write.mode("append").parquet(path)


def filter_logs(logs: DataFrame, level: str = "", search: str = "") -> DataFrame:
    """Rows of one level whose message contains the text (in any case); '' switches a filter off."""
    if level:
        logs = logs.where(F.col("level") == level.upper())
    if search:
        pattern = re.sub(r"([\\%_])", r"\\\1", search)
        logs = logs.where(F.col("message").ilike(f"%{pattern}%"))
    return logs


def log_page(logs: DataFrame, paged: int = 1, per_page: int = fixed.LOG_PAGE, level: str = "", search: str = "") -> DataFrame:
    """One page, newest first (id decides between equal times)."""
    per_page, paged = max(1, int(per_page)), max(1, int(paged))
    return (
        filter_logs(logs, level, search)
        .orderBy(F.col("time").desc(), F.col("id").desc())
        .offset((paged - 1) * per_page)
        .limit(per_page)
    )


def log_page_info(logs: DataFrame, per_page: int = fixed.LOG_PAGE, level: str = "", search: str = "") -> DataFrame:
    total = F.count("*").cast("long")
    return filter_logs(logs, level, search).agg(
        total.alias("total"), F.ceil(total / F.lit(max(1, int(per_page)))).cast("long").alias("pages")
    )


def log_counts(logs: DataFrame) -> DataFrame:
    """Rows per level; the usual levels always appear, others when present."""
    zeros = logs.sparkSession.createDataFrame([(level, 0) for level in fixed.LOG_LEVELS], "level string, n long")
    counted = logs.groupBy("level").agg(F.count("*").alias("n"))
    return counted.unionByName(zeros).groupBy("level").agg(F.sum("n").alias("total"))


def _boundary(logs: DataFrame, keep: int) -> tuple[Column, Column, int]:
    """Conditions of the rows that are newer than the last kept one and equal to it in time and id, and how many of the latter stay.

    Each task keeps its own newest ``keep`` keys and only those are merged.  Rows that share an id are equal rows
    (ids are hashes of the row), so it does not matter which of them stay.
    """
    newest = logs.select("time", "id").orderBy(F.col("time").desc(), F.col("id").desc()).limit(keep)
    last = newest.agg(F.min(F.struct("time", "id")).alias("last")).first()["last"]
    if last is None:
        return F.lit(False), F.lit(False), 0
    key, edge = F.struct("time", "id"), F.struct(F.lit(last["time"]).cast(logs.schema["time"].dataType).alias("time"), F.lit(last["id"]).alias("id"))
    newer = newest.where(key > edge).count()
    return key > edge, key == edge, keep - newer


def log_retention(logs: DataFrame, keep: int = fixed.LOG_KEEP) -> DataFrame:
    """The newest ``keep`` rows exactly: a filter against one boundary, not a sort of the table."""
    newer, equal, places = _boundary(logs, keep)
    return logs.where(newer).union(logs.where(equal).limit(places))


def log_expired(logs: DataFrame, keep: int = fixed.LOG_KEEP) -> DataFrame:
    """The rows that ``log_retention`` leaves out."""
    newer, equal, places = _boundary(logs, keep)
    return logs.where(~newer & ~equal).union(logs.where(equal).offset(places))


def log_json(row_fields=LOG_FIELDS) -> Column:
    return F.to_json(
        F.struct(*[
            F.date_format(f, "yyyy-MM-dd HH:mm:ss").alias(f) if f == "time" else F.col(f) for f in row_fields
        ]),
        {"ignoreNullFields": "false"},
    )


def log_export(logs: DataFrame, now, version: str) -> DataFrame:
    """One JSON text per log row with the export's head beside it (for files of any size)."""
    total = logs.agg(F.count("*").alias("n")).scalar()
    return logs.select(
        F.date_format(moment(now), "yyyy-MM-dd HH:mm:ss").alias("export_date"),
        F.lit(version).alias("version"),
        total.alias("total_logs"),
        F.col("id"),
        log_json().alias("log"),
    )


def clear_table(path: str, spark) -> DataFrame:
    """Empty a stored table and return the number of rows it had."""
    table = spark.read.parquet(path)
    removed = table.agg(F.count("*").alias("removed")).first().removed
    spark.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
    return spark.createDataFrame([(removed,)], "removed long")
