"""Mixing: targets against water filling done step by step, whole quotas, laws of the draws."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing, queries

ROWS = "doc_id long, text string, source string, size string, passes string, nr long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "mine", "mine", 1) for i, t, s in rows], ROWS)


def filled(sizes, cap=3):
    """Targets by resharing what overflows until nothing does."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        parts = sum(weight[s] for s in sizes if s not in full)
        goal = {s: cap * sizes[s] if s in full else rest * weight[s] / parts for s in sizes}
        more = {s for s in sizes if s not in full and goal[s] > cap * sizes[s] + 1e-9}
        if not more:
            return goal
        full |= more


def corpus():
    deal = random.Random(2)
    rows = []
    for i in range(900):
        source = deal.choice(["a"] * 10 + ["b", "B", "é", "z", None])
        rows.append((i, " ".join("w" * deal.randrange(1, 4) for _ in range(deal.choice([0, 3, 30, 60]))), source))
    return rows + [(901, None, "a"), (902, "", "only empty"), (None, "no id at all", "a"), (903, " \t ", None)]


def test_targets_and_takings(spark):
    rows = corpus()
    sizes = collections.defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    goal = filled(sizes)
    found = mixing.dealt(docs_of(spark, rows)).collect()
    again = mixing.dealt(docs_of(spark, rows).repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    taken = collections.defaultdict(int)
    for r in found:
        assert math.isclose(r["target"], goal[r["src"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["src"]]
        assert len(r["shards"]) <= 3 and r["shards"] == sorted(r["shards"])
        taken[r["src"]] += len(r["shards"]) * r["size"]
    least = min(len(t.split()) for _, t, _ in rows if (t or "").split())
    assert all(abs(taken[s] - goal[s]) <= least / 2 for s in goal)  # each source has some of the smallest documents left


def test_long_documents_are_passed_over(spark):
    """Sources whose sizes differ widely: what lacks is less than any document left, or the nearest one was taken."""
    deal = random.Random(9)
    rows = [(i, "w " * deal.choice([1, 2, 5, 40, 300, 5000]), deal.choice("aaabc")) for i in range(150)] + [(999, "w " * 40_000, "a"), (998, "w " * 9000, "d")]
    rows += rows[:20]  # rows equal in id and text go together
    size = {i: len(t.split()) for i, t, _ in rows}
    found = mixing.dealt(docs_of(spark, rows), shards=8).collect()
    assert len(found) == len(rows) and max(len(r["shards"]) for r in found) <= 3
    times = collections.Counter(r["id"] for r in found)
    for source in "abcd":
        of = [r for r in found if r["src"] == source]
        lack = of[0]["target"] - sum(len(r["shards"]) * r["size"] for r in of)
        passes = int(of[0]["target"] // of[0]["source_size"])
        assert all(len(r["shards"]) in (passes, passes + 1) for r in of)
        spare = [times[r["id"]] * size[r["id"]] for r in of if len(r["shards"]) == passes]
        assert lack < min(spare, default=1) and -lack <= 40_000
        if spare:
            assert abs(lack) <= min(spare) or lack < 0
        if lack > 0:
            assert not spare or min(spare) >= 2 * lack


def test_shards_split_the_mix_disjointly(spark):
    docs = docs_of(spark, corpus())
    mix = mixing.mixture(docs, shards=8)
    assert mix.columns == [*docs.columns, "shard", "shard_order"]
    draws = collections.Counter((r["id"], r["src"], shard) for r in mixing.dealt(docs, shards=8).collect() for shard in r["shards"])
    rows = mix.collect()
    assert collections.Counter((r["doc_id"], r["source"], r["shard"]) for r in rows) == draws
    per = collections.Counter(r["shard"] for r in rows)
    assert set(per) == set(range(8)) and max(per.values()) < 1.5 * min(per.values())


@pytest.mark.parametrize("n,k,d", [(10, 4, 5), (50, 20, 25), (7, 7, 3), (9, 0, 4), (2000, 900, 1000), (1, 1, 0), (0, 0, 0)])
def test_hypergeometric_law(spark, n, k, d):
    draws = 4000
    frame = spark.range(draws).select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), (F.col("id") + 0.5) / draws).alias("x"))
    found = collections.Counter(r["x"] for r in frame.collect())
    law = {x: math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) for x in range(max(0, d - n + k), min(k, d) + 1)}
    assert all(abs(found[x] / draws - p) < 1e-3 for x, p in law.items()) and sum(found[x] for x in law) == draws


def test_quotas_are_met_exactly(spark):
    quotas = {1: 8192, 2: 5000, 3: 0, 4: 1, 5: 12289}
    ends = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "nr long, quota long"), 16, 3).collect()
    assert {r["nr"]: r["ends"][-1] for r in ends} == quotas
    shares = [[b - a for a, b in zip([0, *r["ends"]], r["ends"])] for r in ends]
    assert all(x >= 0 for row in shares for x in row)
    sums = [sum(col) for col in zip(*shares)]
    assert max(sums) - min(sums) <= 4  # halves of halves, at most one apart each time


def test_empty_and_wordless(spark):
    assert mixing.dealt(docs_of(spark, [])).count() == 0 and mixing.mixture(docs_of(spark, [])).count() == 0
    assert [r["shards"] for r in mixing.dealt(docs_of(spark, [(1, None, None), (2, "", None)])).collect()] == [[], []]


def test_names_and_files(spark, tmp_path):
    """Input columns named as the operator's own; written shards hold the mix, in random order."""
    names = ["shard", "shard_order", "src", "place", "ends", "shards", "extra", "extra_src", "pass", "doc", "nr", "s"]
    docs = docs_of(spark, corpus()).drop("size", "passes", "nr").withColumns({n: F.lit(f"own {n}") for n in names})
    mix = mixing.mixture(docs, shards=4)
    assert mix.columns == [*[c for c in docs.columns if c not in ("shard", "shard_order")], "shard", "shard_order"]
    mixing.write_mixture(mix, f"{tmp_path}/mix")
    wrote = spark.read.parquet(f"{tmp_path}/mix")
    key = lambda r: (r["shard"], r["doc_id"], r["text"], r["place"], r["ends"])
    assert collections.Counter(map(key, wrote.collect())) == collections.Counter(map(key, mix.collect()))
    ids = [r["doc_id"] for r in wrote.filter("shard = 1").collect() if r["doc_id"] is not None]
    assert ids != sorted(ids)


def test_registered_query(spark, tmp_path):
    docs_of(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op1_mixing"](spark, str(tmp_path)).collect()
    assert len(found) == len(corpus())
    for r in found:
        assert r["taken"] == r["size"] * len(list(filter(None, r["shards"].split(",")))) and r["taken"] <= 3 * r["size"]
