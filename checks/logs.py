"""The log table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derive as d
from checks.registry import check
from newsloom.operators import logs as lg
from newsloom.session import fresh_dir


@check("log_append", f"""
SELECT upper(level) AS level, trim(message) AS message, '{{"user":' || user_id || ',"value":' || v || '}}' AS context, TIMESTAMP '{d.NOW}' AS time,
  CAST('0x' || left(md5('batch1|{d.NOW}|' || upper(level) || '|' || trim(message) || '|' || '{{"user":' || user_id || ',"value":' || v || '}}'), 15) AS BIGINT) AS id2
FROM (SELECT event_id AS id, event_type AS level, ' ' || event_type || ' seen ' AS message, user_id, user_id % 10 AS v FROM events)""")
def log_append(spark, folder):
    """Rows written by append and read back; ids are hashes, so a replay gives the same ones."""
    e = d.table(spark, folder, "events")
    source = e.withColumn("ctx", F.struct(F.col("user_id").alias("user"), (F.col("user_id") % 10).alias("value")))
    message = F.concat(F.lit(" <i>"), F.col("event_type"), F.lit("</i> seen "))
    rows = lg.log_rows(source, d.NOW, F.col("event_type"), message, F.col("ctx"), id_seed="batch1")
    path = fresh_dir(spark, "logs")
    lg.append_logs(rows, path)
    return spark.read.parquet(path).select("level", "message", "context", "time", F.col("id").alias("id2"))


@check("log_counts", f"""
SELECT level, CAST(sum(n) AS BIGINT) AS total FROM (SELECT replace(level, 'SUCCESS', 'AUDIT') AS level, 1 AS n FROM {d.LOGS}
  UNION ALL SELECT unnest(['INFO', 'WARNING', 'ERROR', 'SUCCESS']), 0) GROUP BY level""")
def log_counts(spark, folder):
    """All rows, none of them SUCCESS: that level has to appear all the same."""
    return lg.log_counts(d.logs(spark, folder).withColumn("level", F.replace("level", F.lit("SUCCESS"), F.lit("AUDIT"))))


@check("log_page_info", f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM {d.LOGS} WHERE level = 'ERROR' AND message ILIKE '%USER 1%'")
def log_page_info(spark, folder):
    return lg.log_page_info(d.logs(spark, folder), level="error", search="USER 1")


@check("log_page", f"SELECT id, time, level, message, context FROM {d.LOGS} WHERE level = 'ERROR' AND message ILIKE '%user 1%' ORDER BY time DESC, id DESC LIMIT 20 OFFSET 40")
def log_page(spark, folder):
    return lg.log_page(d.logs(spark, folder), paged=3, per_page=20, level="ERROR", search="user 1")


@check("log_retention", f"SELECT id, time, level FROM {d.LOGS} ORDER BY time DESC, id DESC LIMIT 1000")
def log_retention(spark, folder):
    return lg.log_retention(d.logs(spark, folder)).select("id", "time", "level")


@check("log_expired", f"SELECT id, time, level FROM {d.LOGS} ORDER BY time DESC, id DESC OFFSET 1000")
def log_expired(spark, folder):
    return lg.log_expired(d.logs(spark, folder)).select("id", "time", "level")


@check("log_export", f"""
SELECT '{d.NOW}' AS export_date, '1.0' AS version, CAST((SELECT count(*) FROM {d.LOGS}) AS BIGINT) AS total_logs, id,
  '{{"id":' || id || ',"time":"' || strftime(time, '%Y-%m-%d %H:%M:%S') || '","level":"' || level || '","message":"' || message || '","context":"' || replace(context, '"', '\\"') || '"}}' AS log
FROM {d.LOGS}""")
def log_export(spark, folder):
    return lg.log_export(d.logs(spark, folder), d.NOW, "1.0")


@check("log_clear", f"SELECT CAST(count(*) AS BIGINT) AS removed, CAST(0 AS BIGINT) AS remaining FROM {d.LOGS}")
def log_clear(spark, folder):
    path = fresh_dir(spark, "logs")
    lg.append_logs(d.logs(spark, folder), path)
    removed = lg.clear_table(path, spark)
    left = spark.read.schema(d.logs(spark, folder).schema).parquet(path).agg(F.count("*").alias("n")).scalar()
    return removed.withColumn("remaining", left)
