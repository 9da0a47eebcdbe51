"""Running log counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_log_counts(logs: DataFrame, path: str, trigger: dict | None = None):
    """Counts per level after every batch; the state is one number per level.

    Each batch overwrites the count table at ``path/counts``.
    """
    counts = logs.groupBy("level").agg(F.count("*").alias("total"))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(run)
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
