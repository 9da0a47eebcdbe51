"""Session settings and the shared folder for tables written between stages."""

from __future__ import annotations

import pathlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that the plans in this package count on.  Shuffle partition
# numbers and memory stay with whoever owns the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot key's partition is split even where that costs one more shuffle later
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a side is broadcast only when its known or estimated size is below this; larger ones are shuffled
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # files are compressed: judge a table's size by what it unpacks to
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # newest-N-per-feed filters are cut down before the shuffle up to this N
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # pages are large rows: bound the Arrow batches by bytes as well as by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = pathlib.Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="newsloom-py-")
        archive = shutil.make_archive(f"{folder}/newsloom", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and make the package known to its workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def build_session(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting (tests, a laptop) gets a local folder; on a cluster other
    machines would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="newsloom-")
    return _own_folders[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several outputs hang on one expensive input: the Python work is
    done once, and a lost executor costs a re-read instead of a re-parse.
    """
    return write_and_read(df, fresh_dir(df.sparkSession, name))


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Store ``df`` at ``path``, replacing what was there, and return the stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_for_calls(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over the shuffle partitions for a slow per-row function.

    An explicit number keeps adaptive execution from folding few but costly
    rows into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
