"""Spelling variants against comparing every two words."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from newsloom.llm import spelling
from newsloom.llm.queries import QUERIES

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = collections.Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{id_}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    found, form = {}, {}
    for w in n:
        by = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = by[0] if by and n[by[0]] >= 2 * n[w] else None
        found[w] = (n[w], len(by), n[by[0]] if form[w] else None)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, *found[w]))
    return sorted(out)


def corpus(seed=1):
    deal = random.Random(seed)
    stems = ["house", "mouse", "horse", "strasse", "écoles", "Ñandús", "letter", "lettre", "abcde", "aaaaa", "naïveté", "listen", "silent", "x" * 300]
    words = []
    for stem in stems:
        words += [stem] * 40
        for times in (20, 10, 5, 3, 2):
            k = deal.randrange(len(stem))
            words += [deal.choice([stem[:k] + stem[k + 1:], stem[:k] + deal.choice("aeszéÿ") + stem[k:], stem[:k] + deal.choice("aeszà") + stem[k + 1:]])] * times
    deal.shuffle(words)
    return [(k, deal.choice([" ", ", ", "\n", "1"]).join(words[k::37])) for k in range(37)] + [(90, None), (91, ""), (92, "× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"), (93, "word")]


@pytest.mark.parametrize("block", [1024, 3])
def test_against_every_two_words(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = corpus()
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_spelling"](spark, str(tmp_path))
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows) and len([r for r in got if r[1]]) > 10


def test_chains_ties_and_nothing(spark):
    chain = [("aaaaaaaa"[:k] + "b" * (8 - k), 3 * 2 ** k) for k in range(9)]
    words = spark.createDataFrame([*chain, ("tieee", 9), ("tieec", 9), ("tieed", 4)], "word string, n long")
    got = {r["word"]: r for r in spelling.variants(words).collect()}
    assert {got[w]["root"] for w, _ in chain} == {"aaaaaaaa"}
    assert got["tieed"]["form"] == "tieec" and got["tieed"]["n_near"] == 2 and got["tieee"]["form"] is None
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_pairs_in_blocks():
    deal = random.Random(2)
    for short, long in ((5, 5), (5, 6), (6, 7)):
        a = np.array(sorted({"".join(deal.choice("abé") for _ in range(short)) for _ in range(80)}), object)
        b = np.array(sorted({"".join(deal.choice("abé") for _ in range(long)) for _ in range(80)}), object)
        i, j = spelling.near_pairs(a, b, False)
        assert set(zip(a[i], b[j], strict=True)) == {(x, y) for x in a for y in b if near(x, y)}
        i, j = spelling.near_pairs(a, a, True)
        assert {frozenset(p) for p in zip(a[i], a[j], strict=True)} == {frozenset((x, y)) for x in a for y in a if near(x, y)}
