"""Sharding: the laws it has to keep, hot keys and repeated rows included."""

import collections
import random
import zlib

from newsloom.llm import shards

ROWS = "doc_id long, text string, shard string, slot string, size string"


def laws(found, rows, n, slack):
    assert collections.Counter(r["id"] for r in found) == collections.Counter(r[0] for r in rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in found:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / n
    assert all(abs(size[k] - mean) <= slack for k in range(n))


def test_sizes_near_equal(spark):
    deal = random.Random(8)
    rows = [(deal.choice([7, i]), "é" * deal.choice([0, 1, 50, 400])) for i in range(4000)]  # half of all rows share a key
    rows += [(None, None), (None, "x"), (5000, "z" * 20000)]
    docs = spark.createDataFrame([(i, t, "s", "s", "s") for i, t in rows], ROWS)
    found = shards.assign(docs, 24).collect()
    laws(found, rows, 24, 20008)
    by = {(r["id"], r["tie"]): (r["size"], r["text_crc32"]) for r in found}
    assert set(by.values()) == {(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows}
    assert sorted(map(str, shards.assign(docs, 24).collect())) == sorted(map(str, found))


def test_equal_rows(spark):
    rows = [(1, "same")] * 3000
    laws(shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect(), rows, 7, 13)


def test_files_hold_every_row_in_order(spark, tmp_path):
    rows = [(i // 2, "t%d" % (i // 2 % 50), "s", "s", "s") for i in range(600)]
    shards.write_shards(spark.createDataFrame(rows, ROWS), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter(r[:2] for r in rows)
    assert len({(r["shard"], r["slot"]) for r in back}) == 600


def test_empty(spark):
    assert shards.assign(spark.createDataFrame([], ROWS)).count() == 0
