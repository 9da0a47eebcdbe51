"""SimHash against a brute-force version."""

import random

import pytest
import xxhash

from newsloom.llm import simhash

ROWS = "doc_id long, text string, extra string, fp string"


def brute(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_classes(rows, distance=4, width=4):
    prints = {i: brute(t, width) for i, t in rows}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(i, f"{prints[i]:016x}", label[i]) for i in prints}


def corpus():
    deal = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ünï", "Ça", "UPPER"]
    rows = [(i, " ".join(deal.choices(vocabulary, k=deal.choice([1, 3, 5, 40, 200])))) for i in range(60)]
    for i in range(60, 130):  # near and exact copies of earlier ones, and a chain
        words = rows[deal.randrange(20, 60)][1].split(" ") if i < 100 else rows[-1][1].split(" ")
        if deal.random() < 0.8:
            words[deal.randrange(len(words))] = deal.choice(vocabulary)
        rows.append((i, " \t".join(words)))
    return rows + [(200, ""), (201, None), (202, " \n\x0b "), (203, "x " * 30000), (204, "nbsp inside"), (205, "UPPERİ")]


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "e", "clash") for i, t in rows], ROWS)
    found = {tuple(r) for r in simhash.duplicate_classes(docs).collect()}
    assert found == brute_classes(rows)


@pytest.mark.parametrize("limit", [3, 4096])
@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_links_connect_all_close_pairs(spark, blocks, limit):
    deal = random.Random(1)
    centre = deal.getrandbits(63)
    prints = {centre ^ sum(1 << deal.randrange(63) for _ in range(deal.randrange(3))) for _ in range(80)} | {deal.getrandbits(63) for _ in range(200)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.hamming_links(frame, 4, blocks, limit).collect()
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def groups(pairs):
        label = {p: p for p in prints}

        def top(x):
            while label[x] != x:
                x = label[x]
            return x
        for a, b in pairs:
            label[top(a)] = top(b)
        return {frozenset(p for p in prints if top(p) == r) for r in map(top, prints)}

    assert groups(links) == groups([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])


def test_one_of_each_stays(spark):
    long = " ".join("t%d" % i for i in range(6000))
    rows = [(2, long, "a", "x"), (2, long, "a", "x"), (1, long.replace("t7 ", "q "), "b", "x"), (None, long, "c", "x"),
            (3, "something else altogether here now", "d", "x"), (None, "an unlike text without any id", "e", "x")]
    kept = simhash.keep_one(spark.createDataFrame(rows, ROWS))
    assert kept.columns == ["doc_id", "text", "extra", "fp"]
    assert sorted(r["extra"] for r in kept.collect()) == ["b", "d", "e"]


def test_what_stays_matches_brute_force_whatever_the_columns(spark):
    rows = corpus()
    clash = "doc_id long, text string, _content string, _copy string, content string, id string, row string, label string, keep_id string, fp string"
    docs = spark.createDataFrame([(i, t, *"abcdefgh") for i, t in rows], clash)
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, label in brute_classes(rows) if i == label)


def test_empty(spark):
    docs = spark.createDataFrame([], ROWS)
    assert simhash.duplicate_classes(docs).count() == 0 and simhash.keep_one(docs).count() == 0
