"""Search against the formula over all documents."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import search

ROWS = "doc_id long, text string, score string, id string"


def corpus():
    deal = random.Random(13)
    rows = [(i, " ".join(deal.choices([f"w{int(deal.paretovariate(0.7)) % 400}" for _ in range(50)], k=deal.choice([1, 20, 200])))) for i in range(400)]
    return rows + [(i, "the same Text three times") for i in range(500, 560)] + [(600, None), (601, ""), (None, "the same text"), (602, "zz " * 5000)]


@pytest.mark.parametrize("piece,block", [(8192, 64), (50, 4)])
def test_best_are_those_of_the_formula(spark, monkeypatch, piece, block):
    monkeypatch.setattr(search, "PIECE_DOCS", piece)
    monkeypatch.setattr(search, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], ROWS).repartition(3)
    asked = [(i, t) for i, t in rows if i is not None and (i % 40 == 0 or i > 598)]
    found = search.top_k(spark.createDataFrame([(i, t, "x", "y") for i, t in asked], ROWS), docs, block_bytes=1500 if block == 4 else 32 << 20).collect()
    for i, text in asked:
        scores = search.bm25(text or "", [t for _, t in rows])
        want = sorted(((-round(s, 9), d is None, d or 0) for s, (d, _) in zip(scores, rows) if s > 0))[:10]
        got = [(-round(r["score"], 9), r["doc_id"] is None, r["doc_id"] or 0) for r in sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])]
        assert got == pytest.approx(want) if not want else [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want])


def test_repeated_query_rows(spark):
    rows = [(i, f"common word{i % 7} " + "x " * i) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], ROWS)
    asked = [(0, "common word3"), (0, "common word3"), (5, "common word3"), (5, "word4 x"), (6, None), (6, None)]
    found = search.top_k(spark.createDataFrame([(i, t, "x", "y") for i, t in asked], ROWS), docs).collect()
    for query, texts in ((0, ["common word3"]), (5, ["common word3", "word4 x"])):
        want = []
        for text in texts:
            scores = search.bm25(text, [t for _, t in rows])
            want += [(d, rank) for rank, (_, d) in enumerate(sorted((-round(s, 9), d) for s, (d, _) in zip(scores, rows) if s > 0)[:10], 1)]
        assert sorted((r["doc_id"], r["rank"]) for r in found if r["query_id"] == query) == sorted(want)
    assert {r["query_id"] for r in found} == {0, 5}


def test_blocks_are_skipped():
    import numpy as np

    numbers = [np.array([0] * 5 + [1]) if d < 64 else np.array([2]) for d in range(640)]
    piece = search.Piece(list(range(640)), numbers, [len(x) for x in numbers], 2.0, 3)
    found, scores = piece.search(np.zeros(640), np.array([0, 2]), np.array([5.0, 0.1]), 10, 0.0)
    assert len(found) == 64 and scores.min() > 5  # the other nine blocks are below the tenth best


def test_postings_of_skipped_blocks_are_not_read(monkeypatch):
    import numpy as np

    numbers = [np.array([0] * 5 + [1]) if d < 64 else np.array([2]) for d in range(640)]
    piece = search.Piece(list(range(640)), numbers, [len(x) for x in numbers], 2.0, 3)
    gather, read = search.Piece.gather, []
    monkeypatch.setattr(search.Piece, "gather", staticmethod(lambda *a: read.append(len(gather(*a)[0])) or gather(*a)))
    piece.search(np.zeros(640), np.array([0, 2]), np.array([5.0, 0.1]), 10, 0.0)
    assert sum(read) <= 10 + 2 * 64  # of 640 postings: one bound per block, then the two blocks looked at


def test_words_are_looked_up_as_terms_are_cut():
    import pyarrow as pa

    texts = [None, "", " \t", " The\x0bthe\x1cend\u00a0x \u00c4b\u0085c\r\n", "\u00c4B the", "un known the\fTHE "]
    queries = search.Queries([(1, 1)], ["the the\x1cend\u00a0x \u00c4b\u0085c \u00c4b"])
    found = list(queries.numbers(iter([pa.record_batch({"text": texts[:3]}), pa.record_batch({"text": pa.array(texts[3:])})])))
    words = list(queries.vocabulary)
    got = [([words[k] for k in a], n) for numbers, lengths, _ in found for a, n in zip(numbers, lengths)]
    assert got == [([w for w in search.terms(t) if w in words], len(search.terms(t))) for t in texts]


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert search.top_k(none, none).count() == 0


def test_texts_are_cut_once(spark):
    cut = spark.sparkContext.accumulator(0)

    def seen(text):
        cut.add(1)
        return text

    rows = [(i, " ".join(f"w{i * j % 91}" for j in range(1, 40))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], ROWS).repartition(2).localCheckpoint()
    asked = docs.filter("doc_id % 10 = 0")
    found = search.top_k(asked, docs.withColumn("text", F.udf(seen)("text")), block_bytes=500).collect()  # several blocks of queries
    assert len({r["query_id"] for r in found}) == 20 and cut.value == 200


@functools.cache
def asked_and_best():
    rows, want = corpus(), {}
    asked = [(i, t) for i, t in rows if i is not None and (i % 20 == 0 or i > 598)]
    for i, text in asked:
        scores = search.bm25(text or "", [t for _, t in rows])
        want[i] = sorted(((-round(s, 9), d is None, d or 0) for s, (d, _) in zip(scores, rows) if s > 0))[:10]
    return rows, asked, want


@pytest.mark.parametrize("settings", [{}, {"PIECE_DOCS": 50, "BLOCK": 4, "GROUP": 7, "HELD_DOCS": 128}, {"BLOCK": 4, "ADDED": 50, "FREQUENT": 2},
                                      {"BLOCK": 4, "PIECE_POSTINGS": 900, "SKIPPING": 2.0, "WORTH": 0}])
@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_shard_finds_the_best(monkeypatch, settings, floor):
    import numpy as np
    import pyarrow as pa

    for name, value in settings.items():
        monkeypatch.setattr(search, name, value)
    rows, asked, want = asked_and_best()
    queries = search.Queries([(i, 0) for i, _ in asked], [t for _, t in asked])
    n_terms = len(queries.words)
    batches = [pa.record_batch({"id": pa.array([i for i, _ in some], pa.int64()), "text": [t for _, t in some]}) for some in (rows[:300], rows[300:])]
    index = list(search.forward(iter(batches), queries.words))
    counts = next(search.frequencies(iter(index), n_terms)).to_pydict()
    counts = dict(zip(counts["term"], counts["n"]))
    assert counts[-1] == len(rows) and counts[-2] == sum(len(search.terms(t)) for _, t in rows)
    df = np.array([counts.get(t, 0) for t in range(n_terms)], float)
    block = search.Block(queries, np.log1p((len(rows) - df + 0.5) / (df + 0.5)))
    names = block.ids[:, 0].tolist()
    block.floor[:] = [-want[i][9][0] * floor if len(want[i]) == 10 else 0 for i in names]  # the score of the tenth reaches its floor
    found = {}
    for batch in search.shard(iter(index), block, counts[-2] / counts[-1], 10):
        for r in batch.to_pylist():
            assert names[r["place"]] == r["query"]
            found.setdefault(r["query"], []).append((-r["score"], r["id"] is None, r["id"] or 0))
    for i, best in want.items():
        assert [g[1:] for g in found.get(i, [])] == [w[1:] for w in best] and [g[0] for g in found.get(i, [])] == pytest.approx([w[0] for w in best])


def test_postings_of_a_group_are_skipped(monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "FREQUENT", 1)  # no term has a row
    numbers = [np.array([0] * 5 + [1]) if d < 64 else np.array([2] + [1] * (d % 2)) for d in range(640)]
    piece = search.Piece(list(range(640)), numbers, [len(x) for x in numbers], 2.0, 3)
    add, read = search.Piece.add, []
    monkeypatch.setattr(search.Piece, "add", lambda self, *a: read.append(int((a[3] - a[2]).sum())) or add(self, *a))
    found = dict(piece.candidates(np.array([0, 0]), np.array([0, 2]), np.array([0, 1]), np.array([5.0, 0.1]), np.array([4.0]), np.array([1e-6]), 10,
                                  np.empty(640, np.float32)))
    assert len(found[0]) == 64 and sum(read) <= 64  # of 640 postings


def test_scores_are_those_of_double_precision():
    import numpy as np
    import pyarrow as pa

    rows = corpus()
    queries = search.Queries([(0, 0)], [rows[7][1]])
    (numbers, lengths, _), = queries.numbers(iter([pa.record_batch({"text": [t for _, t in rows]})]))
    doc, term, times = search.counted(numbers, len(queries.words))
    lengths = np.array(lengths)
    piece = search.Piece.of(doc, term, times, lengths, lengths.sum() / len(rows), len(queries.words))
    df = np.bincount(term, minlength=len(queries.words))
    weights = np.log1p((len(rows) - df + 0.5) / (df + 0.5))[queries.term] * queries.times
    assert piece.exact(np.arange(len(rows)), queries.term, weights) == pytest.approx(search.bm25(rows[7][1], [t for _, t in rows]), abs=2e-9)
