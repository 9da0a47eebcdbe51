"""Spelling variants: pairs of words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted over all texts; those of at least ``shortest`` code points and ``least`` occurrences take part.
Two words are near if one inserted, deleted or replaced code point makes one the other.  Then their letter counts
differ by a squared distance of one (lengths differ by one) or two (equal lengths), and every squared distance
between two blocks of words is one NumPy product of their letter-count matrices.  Pairs at such a distance are
verified on the code points, so anagrams and the like go.

Blocks hold words of one length; an edit also moves the count of each of the letter groups ``GROUPS`` by one at
most, so a length is split into cells by those counts, and only the eleven kinds of neighbouring cells are
multiplied.  A cell above ``BLOCK`` words (or ``PART`` code points) is dealt into blocks by hash and every two blocks
meet in a group of their own, so no task holds a whole length.

A word's form is the near word that occurs most (ties: the smallest in code-point order), if it occurs at least
twice as often as the word; following forms always leads to more frequent words, so to a root.  Null and empty
texts have no words.  Repeated rows count again.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import ship_package, stage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = ("aeiou", "bcdfghjklm", "npqrs")  # the other letters are a fourth group
BLOCK = 4096
PART = 1 << 22  # code points held or compared at once
STRIP = 512  # words of a block multiplied at once

# how an edit moves (length, count of group 1, 2, 3); one of each pair of opposite moves
MOVES = ((0, 0, 0, 0),
         (0, 1, -1, 0), (0, 1, 0, -1), (0, 0, 1, -1), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1),  # replaced
         (1, 0, 0, 0), (1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1))  # inserted
CELL = ("length", "g1", "g2", "g3")


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run): the runs of letters of every text, A-Z lower-cased."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), 0)).alias("run"))


def counted(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words that take part, from a column ``word``."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def cell_of(word: Column) -> list[Column]:
    """Length and the counts of the letter groups, as the columns CELL."""
    in_group = lambda letters: (F.length(word) - F.length(F.translate(word, letters, ""))).cast("int")
    return [F.length(word).cast("int").alias("length"), *(in_group(g).alias(c) for g, c in zip(GROUPS, CELL[1:], strict=True))]


def code_points(words: np.ndarray) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int32)


def letter_counts(*codes: np.ndarray) -> list[np.ndarray]:
    """How often each word has each of the letters that occur; single precision where that is exact."""
    letters = np.unique(np.concatenate([c.ravel() for c in codes]))
    exact = np.float32 if max(c.shape[1] for c in codes) <= 1024 else np.float64

    def counts(words: np.ndarray) -> np.ndarray:
        place = np.arange(len(words))[:, None] * len(letters) + np.searchsorted(letters, words)
        return np.bincount(place.ravel(), minlength=len(words) * len(letters)).reshape(len(words), -1).astype(exact)

    return [counts(c) for c in codes]


def at_distance(x: np.ndarray, y: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` at a squared distance: |x|^2 + |y|^2 - 2xy as one product, strip by strip."""
    squares, ones = (y * y).sum(axis=1, keepdims=True), np.ones((len(y), 1), y.dtype)
    other = np.ascontiguousarray(np.concatenate([y, ones, squares], axis=1).T)
    found = []
    for k in range(0, len(x), STRIP):
        strip = x[k:k + STRIP]
        own = np.concatenate([-2 * strip, (strip * strip).sum(axis=1, keepdims=True), np.ones((len(strip), 1), x.dtype)], axis=1)
        hit = np.flatnonzero(own @ other == wanted)
        found.append((k + hit // len(y), hit % len(y)))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are one edit from those of ``b``, of equal length or one longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= n


def near_pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words in two blocks of one length each, the second equal or one longer."""
    a, b = code_points(left), code_points(right)
    i, j = at_distance(*letter_counts(a, b), 2 if a.shape[1] == b.shape[1] else 1)
    if same:
        i, j = i[i < j], j[i < j]
    part = max(1, PART // b.shape[1])
    good = [one_edit(a[i[k:k + part]], b[j[k:k + part]]) for k in range(0, len(i), part)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def _meeting(rows: pd.DataFrame) -> pd.DataFrame:
    """One meeting of two blocks: near words, both ways round."""
    first = rows["first"].to_numpy(bool)
    left, right = rows[first], rows[~first]
    same = not len(right)  # a block with itself
    right = left if same else right
    i, j = near_pairs(left["word"].to_numpy(object), right["word"].to_numpy(object), same) if len(left) else (np.zeros(0, int), np.zeros(0, int))
    a, b = (left["word"].to_numpy(object)[i], left["n"].to_numpy(np.int64)[i]), (right["word"].to_numpy(object)[j], right["n"].to_numpy(np.int64)[j])
    return pd.DataFrame({"word": pd.Series(np.r_[a[0], b[0]], dtype=object), "near": pd.Series(np.r_[b[0], a[0]], dtype=object), "near_n": np.r_[b[1], a[1]]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of near words, both ways round, from staged (word, n)."""
    celled = words.select("word", "n", *cell_of(F.col("word")))
    cells = stage(celled.groupBy(*CELL).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.count("*") * F.col("length") / PART)).alias("blocks")), "cells")
    dealt = celled.join(cells, list(CELL)).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    there = cells.select(*(F.col(c).alias(f"to_{c}") for c in CELL), F.col("blocks").alias("others"))
    steps = F.array(*(F.struct(F.lit(move).alias("move"), F.lit(side).alias("side"),
                               *(F.lit(d if side else -d).alias(f"d_{c}") for c, d in zip(CELL, MOVES[move], strict=True)))
                      for move in range(len(MOVES)) for side in (True, False) if move or side))
    # side: whether this word's block is the first of the two
    moved = dealt.withColumn("s", F.explode(steps)).select("word", "n", *CELL, "block", "s.move", "s.side", *((F.col(c) + F.col(f"s.d_{c}")).alias(f"to_{c}") for c in CELL))
    met = moved.join(there, [f"to_{c}" for c in CELL])
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    own_first = F.when(F.col("move") == 0, F.col("block") <= F.col("other")).otherwise(F.col("side"))
    met = met.withColumn("first", own_first).select(
        "word", "n", "first", "move", *(F.when(F.col("side"), F.col(c)).otherwise(F.col(f"to_{c}")).alias(c) for c in CELL),
        F.when(F.col("first"), F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("first"), F.col("other")).otherwise(F.col("block")).alias("j"))
    ship_package(words.sparkSession)
    return met.groupBy("move", *CELL, "i", "j").applyInPandas(_meeting, "word string, near string, near_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: forms followed to the last, doubling the way each round."""
    ways = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = stage(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ways.filter("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n)."""
    words = stage(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = stage(near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near")
    good = F.col("near_n") >= 2 * F.col("n")
    formed = stage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                           F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    roots = followed(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
