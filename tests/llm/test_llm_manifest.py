"""Merkle manifest against a tree built in memory."""

import hashlib
import random
import zlib

import pytest
from newsloom.llm import manifest
from newsloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and per node its siblings level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[k:k + 3] for k in range(0, len(level), 3)]
        for n, way in enumerate(ways):
            run, slot = runs[at[n] // 3], at[n] % 3
            way.append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at[n] //= 3
        level = [h(*run) for run in runs]
    return level[0], ways


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    out, roots = [], []
    for s in names:
        group = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, ways = tree([leaf(r) for r in group])
        roots.append(root)
        out.append((group, root, ways))
    root, tops = tree(roots)
    found = []
    for (group, subroot, ways), top in zip(out, tops, strict=True):
        for r, way in zip(group, ways, strict=True):
            changed = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else (*r[:4], r[4] and r[4].replace("\n", ""))
            now = leaf(changed)
            for left, right in way + top:
                now = h(left, now, right)
            found.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in way + top)), now, now == root))
    return sorted(found, key=str)


def rows(n, seed=3):
    deal = random.Random(seed)
    texts = ["a\nb", "no break", None, "", "é\n\n漢", "x" * 5000 + "\n"]
    sources = ["big"] * 6 + ["a", "é", "z", None]
    return [(k, deal.choice(sources), deal.choice(["en", None]), deal.randrange(99), deal.choice(texts)) for k in range(n)]


@pytest.mark.parametrize(("levels", "n"), [(1, 12), (2, 400), (7, 40), (7, 2)])
def test_against_a_tree_in_memory(spark, tmp_path, monkeypatch, levels, n):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    some = rows(n) + [(500, "alone", "en", 1, "lone\n"), (501, "", None, None, None)]
    docs = spark.createDataFrame(some, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "hash", "place", "size", "s0", "h0", "way")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_manifest"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute(some)
    assert n < 12 or {r[-1] for r in got} == {True, False}


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    some = rows(30) + rows(30) + [(None, "a", None, None, "t\n"), (None, "a", None, None, "t\n"), (4, "a", "en", 1, "other")]
    spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op12_manifest"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute(some)


def test_one_row_and_no_rows(spark, tmp_path):
    one = [(5, None, None, None, None)]
    spark.createDataFrame(one, SCHEMA).write.parquet(f"{tmp_path}/one/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert [tuple(r) for r in QUERIES["op12_manifest"](spark, f"{tmp_path}/one").collect()] == brute(one)
    assert QUERIES["op12_manifest"](spark, f"{tmp_path}/none").collect() == []
