"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Null texts and texts without words have fingerprint zero and are linked like any other; shorter texts than
a shingle are one shingle of all their words.  Copies have equal fingerprints and are folded together
before anything is compared.  A row without an id still has a fingerprint and a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components
from newsloom.session import ship_package, stage

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42


def fingerprint_of(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash over word shingles, repeats included; A-Z lower-cased."""
    found = (text or "").encode("utf-8", "replace").translate(LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D
    if not found:
        return 0
    joined, n = b" ".join(found), max(len(found) - width + 1, 1)
    length = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(length + 1) - 1
    first, last = (ends - length)[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # very long texts in pieces: a byte per bit and shingle
        codes = [xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(first[at:at + 65536], last[at:at + 65536], strict=True)]
        bits = np.unpackbits(np.array(codes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column, width: int = 4) -> Column:
    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(x, width) for x in texts], dtype="int64")

    return each(text)


def block_masks(blocks: int, shared: int) -> list[int]:
    """Masks over 64 bits (signed): all choices of ``shared`` out of ``blocks`` runs of bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    runs = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(edges)]
    masks = [sum(some) for some in itertools.combinations(runs, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _close_in_group(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within a group: at most one per member, never all pairs."""
    rest, found = prints, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                hit, rest = rest[near], rest[~near]
                found.append((np.full(len(hit), at), hit))
                front.extend(hit)
    return found


def _links(batches: Iterator[pa.RecordBatch], keys: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Verified links within runs of equal keys (the first ``keys`` columns; the last is the fingerprint)."""

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        prints = columns[-1].view(np.uint64)
        change = np.zeros(len(prints), bool)
        for c in columns[:-1]:
            change[1:] |= c[1:] != c[:-1]
        group = np.cumsum(change)
        starts = np.flatnonzero(np.r_[True, change[1:]]) if len(prints) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(prints)])
        pairs = []
        for step in range(1, min(int(sizes.max(initial=0)), 16)):
            here = np.flatnonzero((group[step:] == group[:-step]) & (sizes[group[:-step]] <= 16))
            near = here[np.bitwise_count(prints[here] ^ prints[here + step]) <= distance]
            pairs.append((prints[near], prints[near + step]))
        for k in np.flatnonzero(sizes > 16):
            pairs += _close_in_group(prints[starts[k]:starts[k] + sizes[k]], distance)
        a = np.concatenate([p for p, _ in pairs] or [np.zeros(0, np.uint64)])
        b = np.concatenate([q for _, q in pairs] or [np.zeros(0, np.uint64)])
        seen = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(seen[:, k].astype(np.uint64).view(np.int64)) for k in (0, 1)], ["a", "b"])

    kept: list[np.ndarray] | None = None
    for batch in batches:
        columns = [np.asarray(c.to_numpy(zero_copy_only=False), np.int64) for c in batch.columns]
        if kept is not None:
            columns = [np.concatenate(p) for p in zip(kept, columns, strict=True)]
        if not len(columns[0]):
            continue
        same = np.ones(len(columns[0]), bool)
        for c in columns[:keys]:
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on in the next batch
        kept = [c[cut:] for c in columns]
        if cut:
            yield found([c[:cut] for c in columns])
    if kept is not None:
        yield found(kept)


def hamming_links(prints: DataFrame, distance: int = 4, blocks: int | None = None, group_limit: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``distance`` bits apart, enough to connect all that are.

    64 bits are cut into ``blocks`` runs.  Fingerprints that differ in at most ``distance`` bits agree in at
    least ``blocks - distance`` runs, so each choice of that many runs is a key to meet on; every pair that
    meets is verified.  More blocks make longer keys: by default the number follows the number of
    fingerprints, so that unrelated ones seldom meet.  A group above ``group_limit`` is dealt into slices,
    and every two slices meet in a task of their own: no group is cut off and none grows in one task.
    """
    spark = prints.sparkSession
    if blocks is None:
        n = prints.count()
        blocks = next(b for b in range(distance + 2, 17) if 64 * (b - distance) / b > np.log2(max(n, 2)) - 3 or b == 16)
    choices = block_masks(blocks, blocks - distance)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in choices])).alias("choice", "bits"))
    crowded = stage(keyed.groupBy("choice", "bits").count().filter(F.col("count") > group_limit)
                    .select("choice", "bits", F.ceil(F.col("count") / group_limit).alias("slices")), "crowded")
    none = F.lit(0).cast("long")
    if crowded.isEmpty():
        keyed = keyed.select(F.col("choice").cast("long").alias("choice"), "bits", none.alias("i"), none.alias("j"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("slices"))
        every = F.explode(F.when(F.col("slices").isNull(), F.array(none)).otherwise(F.sequence(none, F.col("slices") - 1))).alias("other")
        keyed = (keyed.join(crowded, ["choice", "bits"], "left").select("choice", "bits", "fp", F.coalesce(own, none).alias("own"), every)
                 .select(F.col("choice").cast("long").alias("choice"), "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))
    keys = ["choice", "bits", "i", "j"]
    ship_package(spark)
    met = keyed.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return met.mapInArrow(lambda batches: _links(batches, len(keys), distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` light: id, ``content`` (hash of the text), ``fp`` and ``label``, equal for all rows of a component."""
    ship_package(docs.sparkSession)
    light = stage(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), fingerprint(F.col(text), width).alias("fp")), "fingerprints")
    prints = light.select("fp").distinct()
    groups = components(hamming_links(prints, distance))
    return light.join(groups, light["fp"] == groups["node"], "left").select("id", "content", "fp", F.coalesce("root", "fp").alias("label"))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: (id, fingerprint in hex, component_id = smallest id of its component)."""
    labelled = stage(near_duplicates(docs, id_col, text, width, distance), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    return labelled.join(smallest, "label").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The documents without later near copies: of each component the row with the smallest id stays.

    Rows without an id come last; of rows equal in id and text one stays.  All columns are kept, whatever their names.
    """
    labelled = stage(near_duplicates(docs, id_col, text, width, distance), "labelled")
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "content")).alias("first"))
    keep = first.select(F.col("first.id").alias("keep_id"), F.col("first.content").alias("keep_content"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"), F.struct(*docs.columns).alias("row"))
    met = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("content") == F.col("keep_content")), "left_semi")
    return met.dropDuplicates(["id", "content"]).select("row.*")
