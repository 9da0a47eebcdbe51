"""Quality rules: statistics of whole texts, a base rule, and an isolation forest over the statistics.

Null texts and texts without words fail the base rule.  Labels are joined by id; of several labels of an
id any "good" one counts as good.  Without good labels the forest rejects nothing.

The forest comes from all labelled rows that pass the base rule: an isolation tree cuts at random, by the method
between the extremes of a draw of 256 rows (from the ``draws`` rows of smallest hash), but then every labelled row
goes down every tree, the counts at the nodes are those of all rows, and the threshold lies above all good ones.
Every document is scored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import unused
from newsloom.session import ship_package, stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = ("n_chars", "n_lines", "n_upper", "n_runs", "n_marked")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more; ``codes`` numbers the words."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    ranks, top = codes.astype(np.int64), int(codes.max()) + 1
    key, bound = ranks[:n], top
    for k in range(1, window):
        if bound > (1 << 62) // top:  # renumber, so that the combined number stays exact
            _, key = np.unique(key, return_inverse=True)
            bound = int(key.max()) + 1
        key, bound = key * top + ranks[k:n + k], bound * top
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS and SHAPE of one text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()  # at \x20 and \x09-\x0D only
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    repeated = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            lines += 1
            repeated += line in seen
            seen.add(line)
    upper = sum(map(data.count, (bytes([c]) for c in range(65, 91))))
    marked = sum(data.count(m) for m in (b"!", b"?", b"...", b"{", b"}"))
    return (len(words), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), repeated, repeated_words(codes),
            len(text), lines, upper, int((codes[1:] == codes[:-1]).sum()), marked)


def with_statistics(docs: DataFrame, text: str = "text", name: str = "_stats") -> DataFrame:
    """``docs`` with a struct column ``name``."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{name} long" for name in (*COUNTS, *SHAPE)))
    def each(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=[*COUNTS, *SHAPE], dtype="int64")

    return docs.withColumn(name, each(text))


def features(stats: pd.DataFrame) -> np.ndarray:
    """Rates of what marks junk, above what any prose has.

    A few words or lines more in the divisors keep short texts from extreme rates.  Repeated passages are
    the base rule's; of repeated lines only a share that headings and refrains do not reach counts.
    """
    s = {c: stats[c].to_numpy(float) for c in stats.columns}
    n, chars, lines = s["n_words"] + 20, s["n_chars"] + 100, s["n_lines"] + 5
    return np.stack([
        s["n_symbols"] / n, s["n_marked"] / n, np.maximum(s["n_upper"] / chars - 0.15, 0),
        np.maximum(s["n_dup_lines"] / lines - 0.3, 0), np.maximum(s["word_chars"] / n - 15, 0),
        np.maximum(s["n_runs"] / n - 0.1, 0),
    ], axis=1)


@dataclasses.dataclass
class Forest:
    """Isolation trees as flat arrays; a row's score is 2 ** (- mean path length / expected path length)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    size: np.ndarray
    rows: int
    threshold: float = 1.0

    @staticmethod
    def expected(n: np.ndarray) -> np.ndarray:
        n = np.asarray(n, float)
        inner = np.maximum(n - 1, 1)
        return np.where(n > 2, 2 * (np.log(inner) + np.euler_gamma) - 2 * inner / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def places(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each tree the leaf of every row, and its depth."""
        rows = np.arange(len(x))
        for feature, cut, left in zip(self.feature, self.cut, self.left, strict=True):
            at, depth = np.zeros(len(x), np.int64), np.zeros(len(x))
            while (inner := feature[at] >= 0).any():
                step = left[at] + (x[rows, np.maximum(feature[at], 0)] >= cut[at])
                at, depth = np.where(inner, step, at), depth + inner
            yield at, depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for size, (at, depth) in zip(self.size, self.places(x), strict=True):
            total += depth + self.expected(size[at])
        return 2.0 ** (-total / len(self.feature) / max(float(self.expected(self.rows)), 1e-9))

    def counts(self, x: np.ndarray) -> np.ndarray:
        """How many of the rows end at each node of each tree."""
        return np.stack([np.bincount(at, minlength=self.size.shape[1]) for at, _ in self.places(x)])

    def weighed(self, counts: np.ndarray, rows: int) -> Forest:
        """The trees with other counts at their nodes: a leaf stands for the tree its rows would still make."""
        return dataclasses.replace(self, size=counts, rows=rows)


def fit(x: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7) -> Forest:
    """A forest over ``x``: each tree splits a draw of ``rows`` rows at random until it isolates them."""
    deal, depth = np.random.default_rng(seed), int(np.ceil(np.log2(max(rows, 2)))) + 4
    parts = []
    for _ in range(trees):
        feature, cut, left, size = [-1], [0.0], [0], [0]
        work = [(0, x[deal.choice(len(x), min(rows, len(x)), replace=False)], 0)]
        while work:
            node, part, level = work.pop()
            size[node] = len(part)
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
            if level >= depth or not len(spread):
                continue
            f = int(deal.choice(spread))
            c = float(deal.uniform(part[:, f].min(), part[:, f].max()))
            feature[node], cut[node], left[node] = f, c, len(feature)
            for side in (part[part[:, f] < c], part[part[:, f] >= c]):
                work.append((len(feature), side, level + 1))
                feature.append(-1), cut.append(0.0), left.append(0), size.append(0)
        parts.append((np.array(feature), np.array(cut), np.array(left), np.array(size)))
    width = max(len(p[0]) for p in parts)
    stack = [np.stack([np.pad(p[k], (0, width - len(p[k])), constant_values=-1 if k == 0 else 0) for p in parts]) for k in range(4)]
    return Forest(*stack, min(rows, len(x)))


def between(inside: float, beyond: float | None) -> float:
    """The threshold: above every good row, halfway to the next bad row beyond them (to 1 if there is none)."""
    return (inside + (1.0 if beyond is None else beyond)) / 2


def calibrated(x: np.ndarray, good: np.ndarray, **how: int) -> Forest:
    """The forest of labelled rows in memory, its threshold set by their labels; the definition ``learned`` has to meet."""
    forest = fit(x, **how)
    forest = forest.weighed(forest.counts(x), len(x))
    scores = forest.scores(x)
    inside = float(scores[good].max())
    beyond = scores[~good & (scores > inside)]
    forest.threshold = between(inside, float(beyond.min()) if len(beyond) else None)
    return forest


FEATURES = tuple(f"x{k}" for k in range(6))
CHUNK = 8192  # rows that go down the trees together


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in larger pieces."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def learned(known: DataFrame, draws: int, **how: int) -> Forest | None:
    """The forest of all labelled rows (id, FEATURES, good); none without a good row and another one.

    The driver holds ``draws`` rows and one count per node.
    """
    spark = known.sparkSession
    total = known.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    if not total["good"] or total["n"] < 2:
        return None
    few = known.orderBy(F.xxhash64("id"), "id", *FEATURES).limit(draws).select(*FEATURES).toPandas().to_numpy(float)
    forest = fit(few[np.lexsort(few.T[::-1])], **how)  # the same forest whatever order the rows came in
    given = spark.sparkContext.broadcast(forest)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(given.value.size.shape, np.int64)
        for part in chunks(batches):
            found += given.value.counts(part.to_numpy(float))
        tree, node = np.nonzero(found)
        yield pd.DataFrame({"tree": tree, "node": node, "n": found[tree, node]})

    counts = np.zeros(forest.size.shape, np.int64)
    nodes = known.select(*FEATURES).mapInPandas(count, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
    for r in nodes.collect():  # at most one row per node
        counts[r["tree"], r["node"]] = r["n"]
    forest = forest.weighed(counts, total["n"])
    weighed = spark.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(batches):
            yield pd.DataFrame({"good": part["good"].to_numpy(bool), "score": weighed.value.scores(part[[*FEATURES]].to_numpy(float))})

    # a task's scores: its best good row and all bad ones, folded to distinct values
    scored = stage(known.select(*FEATURES, "good").mapInPandas(score, "good boolean, score double").groupBy("good", "score").count(), "label-scores")
    inside = scored.filter("good").agg(F.max("score")).first()[0]
    beyond = scored.filter(~F.col("good") & (F.col("score") > inside)).agg(F.min("score")).first()[0]
    forest.threshold = between(inside, beyond)
    return forest


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, FEATURES, good) of all labelled rows that pass the base rule.  Texts stay where they are: only counts meet the labels."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg((F.max("quality") == 1).alias("good"))
    stats = with_statistics(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text), text, "_stats").select("id", "_stats.*")

    @F.pandas_udf(", ".join(f"{name} double" for name in FEATURES))
    def each(stats: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(features(stats), columns=[*FEATURES])

    met = stats.join(known, F.col("id") == F.col("label_id")).withColumn("_x", each(F.struct(*COUNTS, *SHAPE)))
    # filtered after it is written: a condition on the statistics would have them worked out twice
    return stage(met.select("id", "_x.*", "good", base_failed("n_words", "n_repeat_words").alias("failed")), "labelled").filter("not failed")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", draws: int = 20_000,
          **how: int) -> DataFrame:
    """``docs`` with a struct column ``_quality`` (COUNTS, base_failed, score, kept); an input column of that name is replaced."""
    spark = docs.sparkSession
    forest = learned(labelled(docs, labels, id_col, text), draws, **how)
    given = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(given.value.scores(features(stats)) if given.value else np.zeros(len(stats)))

    limit = forest.threshold if forest else 1.0
    own = unused("_stats", docs)
    failed_col = base_failed(f"{own}.n_words", f"{own}.n_repeat_words")
    scored = with_statistics(docs, text, own).withColumn("_quality", F.struct(failed_col.alias("failed"), score(own).alias("score")))
    verdict = ~F.col("_quality.failed") & (F.col("_quality.score") <= limit)
    return scored.withColumn("_quality", F.struct(*(f"{own}.{c}" for c in COUNTS), F.col("_quality.failed").alias("base_failed"),
                                                  "_quality.score", verdict.alias("kept"))).drop(own)


def base_failed(n_words: str, n_repeat_words: str) -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))
