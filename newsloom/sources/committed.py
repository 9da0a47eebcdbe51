"""Tables that change together: parts are written first, one manifest then makes them visible.

A table is a folder of parts, ``part=<name>``; writing a part shows nothing.  A commit writes one manifest that
names every table's parts from then on, and readers follow the newest manifest, so a batch that stops between
two tables leaves nothing behind that anyone reads, and one that is run again after its commit changes nothing.
The manifest lists parts, never rows.  One writer at a time per root.

A keyed table is laid out by hash bucket of its key below each part.  Rows for some keys are then read from those
keys' buckets only.  Small parts are merged into larger ones as they pile up, the newest first and as far as
sizes are alike, so a row is rewritten about as often as its table doubles.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
MOST_PARTS = 8
_MANIFEST = re.compile(r"(\d{12})\.json")


@dataclass(frozen=True)
class Keyed:
    """How a keyed table is laid out; ``fold`` makes one row of the rows of a key when parts are merged."""

    key: str
    fold: Callable[[DataFrame], DataFrame]
    buckets: int = BUCKETS

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class Part:
    name: str
    rows: int   # counted for keyed tables, where it decides what is merged; else 1


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    tables: dict[str, list[Part]] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)   # the last batch of each writer

    def to_json(self) -> str:
        tables = {name: [[p.name, p.rows] for p in parts] for name, parts in self.tables.items()}
        return json.dumps({"tables": tables, "done": self.done})

    @staticmethod
    def from_json(number: int, text: str) -> Manifest:
        read = json.loads(text)
        return Manifest(number, {name: [Part(*p) for p in parts] for name, parts in read["tables"].items()}, read["done"])


@dataclass(frozen=True)
class CommittedTables:
    """The tables below ``root``: their schemas (DDL) by name, and which of them are keyed."""

    root: str
    schemas: dict[str, str]
    keyed: dict[str, Keyed] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    # --- manifests -----------------------------------------------------------

    def _files(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self, spark: SparkSession) -> Manifest:
        folder = self.path("_manifests")
        where, files = self._files(spark, folder)
        if not files.exists(where):
            return Manifest()
        found = [m for s in files.listStatus(where) if (m := _MANIFEST.fullmatch(s.getPath().getName()))]
        if not found:
            return Manifest()
        newest = max(found, key=lambda m: int(m[1]))
        return Manifest.from_json(int(newest[1]), spark.read.text(f"{folder}/{newest[0]}", wholetext=True).first()[0])

    def _publish(self, spark: SparkSession, manifest: Manifest) -> None:
        """Write the manifest beside its place and move it there, which is one step for readers."""
        final, files = self._files(spark, f"{self.path('_manifests')}/{manifest.number:012d}.json")
        if files.exists(final):
            raise RuntimeError(f"another writer has committed {final}")
        draft = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        if not files.rename(draft, final):
            raise RuntimeError(f"another writer has committed {final}")

    def is_done(self, spark: SparkSession, writer: str, batch: int) -> bool:
        last = self.manifest(spark).done.get(writer)
        return last is not None and batch <= last

    def commit(
        self, spark: SparkSession, add: dict[str, Part], drop: dict[str, list[str]] | None = None,
        writer: str | None = None, batch: int | None = None,
    ) -> Manifest:
        """Make written parts visible, and take others out of sight, in one step."""
        now = self.manifest(spark)
        gone = drop or {}
        tables = {name: [p for p in now.tables.get(name, []) if p.name not in gone.get(name, ())] for name in self.schemas}
        for name, part in add.items():
            if part.rows:
                tables[name].append(part)
        done = now.done if writer is None else {**now.done, writer: batch}
        made = Manifest(now.number + 1, tables, done)
        self._publish(spark, made)
        return made

    # --- parts ---------------------------------------------------------------

    def write(self, df: DataFrame, name: str, label: str = "part") -> Part:
        """Store rows as a new part of a table.  It is not visible before a commit names it."""
        spark = df.sparkSession
        part = f"{label}-{uuid.uuid4().hex}"
        path = f"{self.path(name)}/part={part}"
        rows = df.select(*self._columns(spark, name))
        layout = self.keyed.get(name)
        if layout is None:
            rows.write.parquet(path)
        else:
            bucketed = rows.withColumn("bucket", layout.bucket(layout.key)).hint("rebalance", "bucket")
            bucketed.write.partitionBy("bucket").parquet(path)
        return Part(part, 1 if layout is None else self._read(spark, name, [part]).count())

    def append(self, df: DataFrame, name: str, **by) -> None:
        """Write one part and commit it."""
        self.commit(df.sparkSession, {name: self.write(df, name)}, **by)

    def _columns(self, spark: SparkSession, name: str) -> list[str]:
        return spark.createDataFrame([], self.schemas[name]).columns

    def _read(self, spark: SparkSession, name: str, parts: list[str]) -> DataFrame:
        bucket = ", bucket int" if name in self.keyed else ""
        schema = f"{self.schemas[name]}{bucket}, part string"
        if not parts:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema).option("basePath", self.path(name))
        return reader.parquet(*[f"{self.path(name)}/part={p}" for p in parts])

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The committed rows of a table."""
        parts = self.manifest(spark).tables.get(name, [])
        return self._read(spark, name, [p.name for p in parts]).select(*self._columns(spark, name))

    # --- keyed tables --------------------------------------------------------

    def among(self, name: str, asked: DataFrame, column: str | None = None) -> DataFrame:
        """The committed rows whose key is in ``asked``, read from the buckets of those keys only.

        At most one number per bucket comes to the driver.  The asked keys are small beside the table: the
        planner sends them to it if they are below the broadcast threshold, and shuffles otherwise.
        """
        spark, layout = asked.sparkSession, self.keyed[name]
        keys = asked.select(F.col(column or layout.key).alias("_asked")).where("_asked IS NOT NULL").distinct()
        touched = sorted(r[0] for r in keys.select(layout.bucket("_asked")).distinct().collect())
        parts = [p.name for p in self.manifest(spark).tables.get(name, [])]
        rows = self._read(spark, name, parts).where(F.col("bucket").isin(touched))
        return rows.join(keys, F.col(layout.key) == F.col("_asked"), "left_semi").select(*self._columns(spark, name))

    def compact(self, spark: SparkSession, name: str, most: int = MOST_PARTS) -> bool:
        """Merge the newest parts where there are more than ``most``; tells whether it did.

        Parts are taken from the newest back, as long as the next is not above twice what is taken.
        """
        parts = self.manifest(spark).tables.get(name, [])
        if len(parts) <= most:
            return False
        taken, rows = [parts[-1]], parts[-1].rows
        for part in reversed(parts[:-1]):
            if len(taken) >= 2 and part.rows > 2 * rows:
                break
            taken, rows = [*taken, part], rows + part.rows
        names = [p.name for p in taken]
        merged = self.keyed[name].fold(self._read(spark, name, names).select(*self._columns(spark, name)))
        part = self.write(merged, name, "merged")
        # the merged rows take the place of the oldest part they come from
        now = self.manifest(spark)
        kept = [part if p.name == names[-1] else p for p in now.tables[name] if p.name == names[-1] or p.name not in names]
        self._publish(spark, Manifest(now.number + 1, {**now.tables, name: kept}, now.done))
        return True

    def unreferenced(self, spark: SparkSession) -> list[str]:
        """Folders of parts that the newest manifest does not name: merged ones and those of batches that broke off."""
        named, found = self.manifest(spark).tables, []
        for name in self.schemas:
            where, files = self._files(spark, self.path(name))
            if files.exists(where):
                live = {f"part={p.name}" for p in named.get(name, [])}
                found += [str(s.getPath()) for s in files.listStatus(where) if s.getPath().getName().startswith("part=") and s.getPath().getName() not in live]
        return found


def one_row_per_key(key: str) -> Callable[[DataFrame], DataFrame]:
    """Fold for tables whose rows of a key are equal."""
    return lambda df: df.dropDuplicates([key])
