"""Line de-duplication against all pairs."""

import random
import zlib

import pytest

from newsloom.llm import linededup

ROWS = "doc_id long, text string, n int, key string, line string"


def token_set(line, width=5):
    w = line.encode().split()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows):
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    lines = [(d, k, token_set(x)) for d in order if d[1] is not None for k, x in enumerate(d[1].split("\n"))]
    gone = {(d, k) for n, (d, k, s) in enumerate(lines) if s and any(t and 5 * len(s & t) >= 4 * len(s | t) for _, _, t in lines[:n])}
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if ((i, t), k) not in gone)) for i, t in rows]


def corpus(n=120):
    deal = random.Random(11)
    pool = [" ".join(f"w{deal.randrange(40)}" for _ in range(deal.choice([1, 2, 4, 6, 12, 40, 90]))) for _ in range(60)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(deal.randrange(1, 6)):
            w = deal.choice(pool).split(" ")
            for _ in range(deal.choice([0, 0, 1, 2])):
                w[deal.randrange(len(w))] = f"w{deal.randrange(40)}"
            lines.append(deal.choice([" ", "  "]).join(w))
        rows.append((i, "\n".join(lines)))
    base = [f"h{k}" for k in range(60)]
    for i in range(200, 240):  # one large group of near copies
        w = list(base)
        w[deal.randrange(60)] = "changed%d" % i
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, "\n \n\n"), (303, "a b\na b\n\na  b"), (None, "unlike all the others here"), (None, base[0]), (304, "long " + "x y z " * 20000), (303, "a b\na b\n\na  b")]


def test_matches_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k", "l") for i, t in rows], ROWS)
    found = linededup.remove_lines(docs)
    assert found.columns == [*docs.columns, "_lines"]
    got = found.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, zlib.crc32((r[1] or "").encode()))
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(brute(rows), key=key)
    for r in got:
        if r["doc_id"] == 303:
            assert tuple(r["_lines"]) == (4, 2)


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_and_positions_lose_no_match(n):
    """Over all sizes: two sets that match meet within their prefixes, and could_match says so."""
    for m in range(n, 75):
        for same in range(1, n + 1):
            if 9 * same >= 4 * (n + m):
                p, q = n - (4 * n + 4) // 5 + 1, m - (4 * m + 4) // 5 + 1
                assert same > n - p and same > m - q and 5 * n >= 4 * m


def test_lines_that_share_no_token_are_not_counted(spark, monkeypatch):
    """Only sets that share a key with a different one are hashed again, counted and ordered by rarity."""
    counted, rarity = [], linededup.rarity
    monkeypatch.setattr(linededup, "rarity", lambda sets, *more: counted.append(sets.count()) or rarity(sets, *more))
    alone = [(i, " ".join(f"own{i}_{k}" for k in range(30))) for i in range(50)]
    near = [" ".join(f"near{k}" for k in range(40)), " ".join(f"near{k}" for k in range(41))]
    rows = alone + [(60, near[0]), (61, near[1]), (62, alone[3][1])]
    got = linededup.remove_lines(spark.createDataFrame([(i, t, 1, "k", "l") for i, t in rows], ROWS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute(rows)
    assert counted == [2]


def test_all_blanks_part_words(spark):
    words = [f"v{k}" for k in range(12)]
    rows = [(1, " ".join(words)), (2, "\t" + "\t".join(words) + " \r"), (3, "  " + "\x0b \f".join(words) + "\n\t\r\x0b\f\n"), (4, "\u00a0" + " ".join(words[:4])),
            (5, " ".join(words[:4])), (6, "a\x1cb"), (7, "a b"), (8, "\x1c"), (9, "\x1c \n "), (10, "")]
    got = linededup.remove_lines(spark.createDataFrame([(i, t, 1, "k", "l") for i, t in rows], ROWS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute(rows)


def test_empty(spark):
    assert linededup.remove_lines(spark.createDataFrame([], ROWS)).count() == 0


def test_lines_without_a_copy_or_a_shared_token_are_not_sorted_or_joined(spark, monkeypatch):
    """Only copied sets are ordered by line, only keys that are shared meet, and lines are numbered from a staged table."""
    staged, stage = {}, linededup.stage

    def kept(df, name):
        done = stage(df, name)
        staged[name] = done.count()
        return done

    monkeypatch.setattr(linededup, "stage", kept)
    alone = [(i, " ".join(f"own{i}_{k}" for k in range(30))) for i in range(50)]
    near = [" ".join(f"near{k}" for k in range(40)), " ".join(f"near{k}" for k in range(41))]
    rows = alone + [(60, near[0]), (61, near[1]), (62, alone[3][1]), (63, near[0])]
    got = linededup.remove_lines(spark.createDataFrame([(i, t, 1, "k", "l") for i, t in rows], ROWS)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == brute(rows)
    assert (staged["first-copies"], staged["equal"], staged["places"]) == (2, 2, 2)
    assert 0 < staged["centres"] <= staged["met"] / 2
