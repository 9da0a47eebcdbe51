"""Best-fit packing: documents into sequences of fixed room, tightest compatible bin first.

A document longer than a sequence is cut into whole sequences and a rest.  Pieces are placed by falling size:
the bins of a group are kept in order of what room is left, and from the first that is large enough the search
goes on until one holds neither the piece's source nor its cluster of duplicates.  Documents are dealt by hash
into groups of about ``group_rows``, each packed by itself, so no task's work grows with the input; a group's
last bins are all that this can leave half empty.  Documents without words take no room but do get a place;
null sources and null clusters are a source, and no cluster.  Equal rows are placed one by one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import word_count, words
from newsloom.session import ship_package, stage

OUT = "seq long, piece int, first_word long, n_words long, bin long, offset long"


def pack(sizes: list[int], sources: list[int], clusters: list[int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, first_word, n_words, bin, offset); negative clusters conflict with none."""
    found, rests, bins = [], [], 0
    for k, size in enumerate(sizes):
        whole = size // room
        for p in range(whole):
            found.append((k, p, p * room, room, bins, 0))
            bins += 1
        if size % room or not whole:
            rests.append((size % room, k, whole))
    open_bins: list[tuple[int, int]] = []  # (room left, bin), in order
    held: dict[int, tuple[int, int]] = {}  # bin to its bitmaps of sources and clusters
    for rest, k, piece in sorted(rests, key=lambda r: (-r[0], r[1])):
        source, cluster = 1 << sources[k], 1 << clusters[k] if clusters[k] >= 0 else 0
        at = bisect_left(open_bins, (rest, -1))
        while at < len(open_bins) and (held[open_bins[at][1]][0] & source or held[open_bins[at][1]][1] & cluster):
            at += 1
        if at < len(open_bins):
            left, bin_ = open_bins.pop(at)
        else:
            left, bin_ = room, bins
            held[bin_] = (0, 0)
            bins += 1
        found.append((k, piece, piece * room, rest, bin_, room - left))
        held[bin_] = (held[bin_][0] | source, held[bin_][1] | cluster)
        if left > rest:
            insort(open_bins, (left - rest, bin_))
    return found


def _group(rows: pd.DataFrame, room: int) -> pd.DataFrame:
    rows = rows.sort_values("seq")
    source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    cluster = pd.factorize(rows["cluster"])[0]
    placed = pack(rows["size"].tolist(), source.tolist(), cluster.tolist(), room)
    out = pd.DataFrame(placed, columns=["item", "piece", "first_word", "n_words", "bin", "offset"])
    out["bin"] += int(rows["group"].iloc[0]) << 32 if len(rows) else 0
    out["seq"] = rows["seq"].to_numpy()[out["item"]]
    return out[["seq", "piece", "first_word", "n_words", "bin", "offset"]]


def packed(docs: DataFrame, room: int = 1024, id_col: str = "doc_id", source: str = "source", text: str = "text", cluster: Column | None = None,
           group_rows: int = 4096) -> DataFrame:
    """One row per piece: id, source, size, piece, first_word, n_words, bin, offset.

    ``cluster``: the document's group of duplicates; by default the hash of its text in lower case, null for null texts.
    """
    ship_package(docs.sparkSession)
    own = F.when(F.col(text).isNotNull(), F.xxhash64(F.lower(text))) if cluster is None else cluster
    light = stage(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), own.cast("string").alias("cluster"), word_count(F.col(text)).alias("size")),
                  "pack-light").withColumn("seq", F.monotonically_increasing_id())
    groups = max(1, -(-light.count() // group_rows))
    dealt = light.withColumn("group", F.pmod(F.xxhash64("id", "cluster", "seq"), F.lit(groups)))
    placed = dealt.groupBy("group").applyInPandas(lambda rows: _group(rows, room), OUT)
    return light.join(placed, "seq").select("id", "source", "size", "piece", "first_word", "n_words", "bin", "offset")


def piece_text(text: Column, first_word: Column, n_words: Column) -> Column:
    """The words of a piece, space-joined."""
    return F.array_join(F.slice(words(text), first_word.cast("int") + 1, n_words.cast("int")), " ")
