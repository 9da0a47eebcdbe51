"""Quality rules against brute force."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))


def texts():
    deal = random.Random(3)
    made = [None, "", " \n\t", "a", "a\na\n \n \na b\x0bc\x1cd", "nb sp  x", "é" * 9 + " # *** <b>"]
    for _ in range(80):
        body = [deal.choice("abcdefgh") * deal.choice([1, 1, 2]) for _ in range(deal.randrange(120))]
        made.append("".join(w + deal.choice(" \n\t  ") for w in body))
    return made


def test_counts_match_brute_force():
    for text in texts():
        assert quality.statistics(text)[:5] == brute(text)
    many = np.arange(30000) % 20000
    assert quality.repeated_words(many) == 20000 and quality.repeated_words(np.r_[np.arange(50000), 7]) == 0


def prose(deal, n=60):
    return " ".join(deal.choice(["river", "stone", "walks", "under", "light", "paper", "seven"]) + str(deal.randrange(9999)) for _ in range(n)) + "."


def test_verdicts(spark):
    deal = random.Random(4)
    rows = [(i, prose(deal), None) for i in range(300)]
    rows += [(i, re.sub(" ", "### ", prose(deal)) + "$$$", 1) for i in range(300, 340)]
    rows += [(400, "too short", None), (401, None, None), (402, "", None), (None, prose(deal), None), (403, "a b c d e " * 9, None), (7, prose(deal), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(300, 320)] + [(None, 1, 0), (5, 0, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    found = quality.judge(docs.withColumn("score", F.lit("mine")), labels).select("doc_id", "stats", "_quality.*").toPandas()
    assert len(found) == len(rows)
    kept = found.groupby(found["doc_id"].fillna(-1))["kept"].all()
    assert kept[kept.index < 300].all() and not kept[(kept.index >= 300)].any()
    again = quality.judge(docs, labels).select("_quality.*").toPandas()
    assert sorted(again["score"].round(12)) == sorted(found["score"].round(12))


def test_score_is_that_of_path_lengths():
    x = np.random.default_rng(1).normal(size=(400, 3))
    forest = quality.fit(x, trees=5, rows=64)

    def path(row, t):
        at = depth = 0
        while forest.feature[t][at] >= 0:
            at = forest.left[t][at] + (row[forest.feature[t][at]] >= forest.cut[t][at])
            depth += 1
        return depth + float(forest.expected(forest.size[t][at]))
    means = np.array([np.mean([path(r, t) for t in range(5)]) for r in x])
    assert np.allclose(forest.scores(x), 2 ** (-means / float(forest.expected(64))))


def test_held_out_labels():
    deal = random.Random(9)
    good, bad = [prose(deal) for _ in range(300)], [prose(deal).replace(" ", " | ") for _ in range(60)]
    stats = pd.DataFrame([quality.statistics(t) for t in good + bad], columns=[*quality.COUNTS, *quality.SHAPE])
    x, kind = quality.features(stats), np.array([True] * 300 + [False] * 60)
    forest = quality.calibrated(x[::2], kind[::2])
    wrong = (forest.scores(x[1::2]) <= forest.threshold) != kind[1::2]
    assert wrong.mean() < 0.02


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 3), (2, " ".join(map(str, range(40))))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["_quality"]["kept"] for r in quality.judge(docs, labels).orderBy("doc_id").collect()] == [False, True]
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_every_labelled_row_counts(spark):
    """Of 400 labelled rows 40 are drawn for the cuts; the counts and the threshold are those of all."""
    deal = random.Random(12)
    rows = [(i, prose(deal)) for i in range(360)]
    rows += [(i, re.sub(" ", " # ", prose(deal), count=8 + i % 30)) for i in range(360, 380)]      # odd, but good
    rows += [(i, re.sub(" ", "### ", prose(deal)) + "$$$") for i in range(380, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 380)) for i in range(400)], "doc_id long, quality int")
    judged = quality.judge(docs, labels, "doc_id", "text", 40, rows=16).select("doc_id", "_quality.*").toPandas().set_index("doc_id")
    assert judged["kept"][judged.index < 380].all() and not judged["kept"][judged.index >= 380].any()
    stats = pd.DataFrame([quality.statistics(t) for _, t in rows], columns=[*quality.COUNTS, *quality.SHAPE])
    x, good = quality.features(stats), np.arange(400) < 380
    table = spark.createDataFrame(pd.DataFrame(x, columns=[*quality.FEATURES]).assign(id=np.arange(400), good=good)).repartition(5)
    few = quality.learned(table, 40, rows=16)
    assert few.rows == 400 and (few.size.sum(1) == 400).all() and few.threshold >= few.scores(x)[good].max()
    every, want = quality.learned(table, 1000), quality.calibrated(x[np.lexsort(x.T[::-1])], good[np.lexsort(x.T[::-1])])
    assert (every.size == want.size).all() and np.isclose(every.threshold, want.threshold)
