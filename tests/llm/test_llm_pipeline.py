"""The pipeline: its stages one after the other, each against brute force on what the one before kept."""

import collections
import random

import corpus_pipeline
from test_llm_linededup import brute as brute_lines
from test_llm_simhash import brute_classes


def corpus():
    deal = random.Random(21)
    fill = lambda n: " ".join(f"w{deal.randrange(3000)}" for _ in range(n))
    rows = [(i, "\n".join(fill(20) for _ in range(4)), deal.choice("aaab")) for i in range(120)]
    shared = fill(60)
    rows += [(200 + i, fill(40) + "\n" + shared, "b") for i in range(10)]
    rows += [(300 + i, rows[i][1].replace("w1", "v1", 1), "c") for i in range(10)] + [(400, fill(30).replace(" ", "### "), "a"), (401, "short", "a"), (402, None, None)]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(400, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near copies", "mix sources", "pack sequences"]
    kept, now = docs, {r[0]: r[1] for r in rows}
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = step(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        if k == 0:
            now = {i: t for i, t in now.items() if i not in (400, 401, 402)}
        elif k == 1:
            now = {i: t for i, t in brute_lines(list(now.items())) if t.split()}
        elif k == 2:
            now = {i: now[i] for i, _, label in brute_classes(list(now.items())) if i == label}
        if k < 3:
            assert dict(got) == now and len(got) == len(now)
        else:
            assert set(got) <= set(now.items()) and max(collections.Counter(i for i, _ in got).values()) <= 3
    packed = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path)).collect()
    assert sum(r["n_words"] for r in packed) == sum(len(t.split()) for _, t in got)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["n_words"]) for r in whole) == collections.Counter((r["doc_id"], r["piece"], r["n_words"]) for r in packed)
