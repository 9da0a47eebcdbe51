"""Token counts against the library itself, text by text."""

import random

import public_tokenizers
import pytest
from newsloom.llm import tokencount
from newsloom.llm.queries import QUERIES
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n\t ", "Hello  WORLD's it'll 'twas <|endoftext|><|startoftext|>x<|endoftext|", "xİΣς ΟΔΟΣ ǅ ﬁ", "é ̈a ẛ̣ å̧", "日本語のテキスト 😀👍🏽 ​ z",
       "a\x1cb\x1f!\x85c\xa0d　e", "1234567 ½ ² Ⅷ", "don't WON'T 'S''s", "x" * 3000, "!?" * 500, "\x00\x01 ﻿�", "<|endoftext|>" * 3, "a <|ENDOFTEXT|> b", "́lead", "naïve café Ünïcode", "ÀÉÿ×ß÷ŒÞ", "".join(map(chr, range(0x20, 0x180)))]


def whole(text, tokenizer):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_sum_of_pre_tokens_is_the_library_s_count(name):
    path = public_tokenizers.path(name)
    tokens, library = tokencount.Tokens(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    deal = random.Random(5)
    assert all(tokens.parts(c)[1].keys() == set(tokens._split(c)) for c in tokencount.LETTERS)
    alphabet = "aAbBéÉ'stlm 12.,!?<|>\n\t\xa0́̈ßİΣ漢字😀"
    assert (tokens.plain is not None) == (name == "word_bpe_49k.json")
    texts = ODD + ["".join(deal.choice(alphabet) for _ in range(deal.randrange(80))) for _ in range(500)]
    for text in texts:
        added, found = tokens.parts(text)
        assert added + sum(n * tokens.pieces(p) for p, n in found.items()) == whole(text, library), repr(text)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "FREQUENT", 12)  # most pre-tokens take the join
    monkeypatch.setattr(tokencount, "ROWS", 3)
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (99, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, row long, piece string")
    got = sorted(tokencount.token_counts(docs, PATH).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), whole(t, library), whole(t, library) > 2048) for i, t in rows), key=lambda r: str(r[0]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_and_query(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.token_counts(docs, PATH).collect() == []
    rows = [(1, "a b c"), (2, None), (7, "It's <|endoftext|>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_tokens"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(map(tuple, out.collect())) == [(1, 5, 3, False), (2, 0, 0, False), (7, 18, 3, False)]
