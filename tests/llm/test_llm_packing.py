"""Packing: best fit against a plain search, and the laws of every packing."""

import collections
import random

from newsloom.llm import packing

ROWS = "doc_id long, text string, source string, bin string, size string"


def plain(sizes, sources, clusters, room):
    """Best fit, every bin looked at: the fullest that has room and no conflict."""
    bins, where = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(b["left"], n) for n, b in enumerate(bins) if b["left"] >= max(sizes[k], 1) and sources[k] not in b["s"] and (clusters[k] < 0 or clusters[k] not in b["c"])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": room, "s": set(), "c": set()})
        bins[n]["left"] -= sizes[k]
        bins[n]["s"].add(sources[k]), bins[n]["c"].add(clusters[k])
        where[k] = n
    return where


def test_best_fit():
    deal = random.Random(4)
    for _ in range(200):
        n = deal.randrange(1, 60)
        sizes, sources = [deal.randrange(0, 40) for _ in range(n)], [deal.randrange(4) for _ in range(n)]
        clusters = [deal.choice([-1, 0, 1, 2, 3]) for _ in range(n)]
        found = packing.pack(sizes, sources, clusters, 41)
        assert {r[0]: r[4] for r in found} == plain(sizes, sources, clusters, 41)


def test_laws(spark):
    deal = random.Random(5)
    rows = [(i, "w " * deal.choice([3, 40, 200, 1500]), deal.choice(["hot"] * 3 + ["a", "b", None])) for i in range(1500)]
    rows += [(2000, "dup text here", s) for s in "abcdefgh"] + [(2001, None, None), (2002, "", "a"), (None, "x " * 5000, "a")] + [(3000, "equal row", "z")] * 40
    docs = spark.createDataFrame([(*r, "b", "s") for r in rows], ROWS)
    found = packing.packed(docs, 512, group_rows=300).collect()
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in found:
        total[r["id"]] += r["n_words"]
        bins[r["bin"]].append(r)
    want = collections.Counter()
    for i, text, _ in rows:
        want[i] += len((text or "").split())
    assert total == want
    for members in bins.values():
        assert sum(r["n_words"] for r in members) <= 512
        at = sorted((r["offset"], r["n_words"]) for r in members if r["n_words"])
        assert all(a + n <= b for (a, n), (b, _) in zip(at, at[1:]))
        assert len({r["source"] for r in members}) == len(members)
    assert sum(r["id"] == 3000 for r in found) == 40
    assert packing.packed(docs.limit(0)).count() == 0


def test_null_texts_are_no_cluster(spark):
    found = packing.packed(spark.createDataFrame([(1, None, "a", "b", "s"), (2, None, "b", "b", "s"), (3, "same", "c", "b", "s"), (4, "same", "d", "b", "s")], ROWS)).collect()
    bins = {r["id"]: r["bin"] for r in found}
    assert bins[1] == bins[2] and bins[3] != bins[4]
