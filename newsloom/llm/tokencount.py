"""Token counts of whole texts: pieces are counted once per distinct pre-token, then summed over each document.

A document becomes its pre-tokens with their frequencies; the tokenizer's own normalizer and pre-tokenizer make
them.  Every distinct pre-token of the corpus is cut into pieces once, and only the number of pieces is kept; a
document's count is the sum of frequency times that number.  No token ids are made for documents.  The most used
pre-tokens (``FREQUENT`` at most, of ``SHORT`` bytes at most, so some megabytes) are sent to all tasks, which sum
them in place; the others meet their counts in a join, where none is frequent enough to be a hot key.

Supported are tokenizer files in JSON whose added tokens match exactly (no stripping, not normalized).  Such a
token found in a text counts as one, as the library does by default; none are added at begin or end, and nothing
is truncated or padded.  Where a tokenizer drops blanks, a text is taken word by word, and what holds only printable
ASCII and the letters from U+00C0 to U+00FF is split by the file's own pattern without calling the library.

Null and empty texts have no bytes and no tokens.  Every input row gives a row: rows equal in id are counted by
themselves, rows without an id too.  A word without blanks may be as long as it likes.  Other columns of the input
are not read.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.session import fresh_dir, ship_package, stage

FREQUENT, SHORT = 1 << 18, 128
STEPS = 8  # frequency classes per doubling
HELD, HELD_LENGTH = 50_000, 64  # words beyond ASCII whose pre-tokens a worker remembers
ROWS, BYTES = 256, 1 << 20  # of documents split before their rows are handed on
LETTERS = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())
PLAIN = re.compile(rf"[\t-\r\x20-\x7e{LETTERS}]*")

_loaded: dict[str, Tokens] = {}


def plain_pattern(definition: dict) -> re.Pattern[str] | None:
    """The pattern that splits PLAIN texts, where that and lower case are all the tokenizer does to them."""
    normalizer, before = definition.get("normalizer") or {}, definition.get("pre_tokenizer") or {}
    normal = normalizer.get("normalizers", [normalizer])
    to_blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    known = all(n == to_blank or n.get("type") in ("NFC", "Lowercase") for n in normal) and any(n.get("type") == "Lowercase" for n in normal)
    steps = before.get("pretokenizers", [])
    if not known or len(steps) != 2 or steps[0].get("type") != "Split" or steps[1].get("type") != "ByteLevel":
        return None
    if "Regex" not in steps[0]["pattern"] or re.search(r"(?<!\[)(?<!\^\\s)(?<!\\p\{L\})\\p", steps[0]["pattern"]["Regex"]):
        return None  # classes have to stand in brackets
    if not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    # what \p{L} and \p{N} are among the characters of PLAIN, in lower case
    return re.compile(steps[0]["pattern"]["Regex"].replace(r"\p{L}", "a-z" + LETTERS).replace(r"\p{N}", "0-9"))


class Tokens:
    """A tokenizer as two functions: a text to its pre-tokens, a pre-token to its number of pieces."""

    def __init__(self, definition: str) -> None:
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation(), self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        if any(a.normalized or a.single_word or a.lstrip or a.rstrip for a in added):
            raise ValueError("only added tokens that match exactly are supported")
        longest = sorted((a.content for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, longest)) or r"(?!)")
        # a tokenizer that drops blanks never lets a pre-token reach over one
        self.drops_blanks = self._split("a b") == ["a", "b"]
        self.plain = plain_pattern(json.loads(definition)) if self.drops_blanks else None
        # how the library writes the letters beyond ASCII
        self.written = {ord(c): "".join(self._split(c)) for c in LETTERS}
        self.held: dict[bytes, list[str]] = {}

    def _split(self, text: str) -> list[str]:
        """By the library."""
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        before = self.library.pre_tokenizer
        return [p for p, _ in before.pre_tokenize_str(normal)] if before else [normal]

    def _written(self, pre_token: str) -> str:
        return pre_token if pre_token.isascii() else pre_token.translate(self.written)

    def _word(self, word: bytes) -> list[str]:
        text = word.decode()
        if self.plain and PLAIN.fullmatch(text):
            return [self._written(p) for p in self.plain.findall(text.lower())]
        if word in self.held:
            return self.held[word]
        found = self._split(text)
        if len(word) <= HELD_LENGTH:
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[word] = found
        return found

    def parts(self, text: str | None) -> tuple[int, Counter[str]]:
        """How many added tokens a text holds, and its pre-tokens with their frequencies."""
        segments = self.added.split(text or "")
        found: Counter[str] = Counter()
        for segment in segments:
            if self.plain and PLAIN.fullmatch(segment):
                counts = Counter(self.plain.findall(segment.lower()))
                found.update(counts if segment.isascii() else {self._written(p): n for p, n in counts.items()})
            elif self.drops_blanks:
                for word, times in Counter(segment.encode().split()).items():  # at \x20 and \x09-\x0D only
                    for p in self._word(word):
                        found[p] += times
            elif segment:
                found.update(self._split(segment))
        return len(segments) - 1, found

    def pieces(self, pre_token: str) -> int:
        return len(self.library.model.tokenize(pre_token))


def loaded(name: str, definition: Broadcast[str]) -> Tokens:
    """The tokenizer, built once per worker."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Tokens(definition.value)
    return _loaded[name]


def _split_rows(batches: Iterator[pa.RecordBatch], name: str, definition: Broadcast[str]) -> Iterator[pa.RecordBatch]:
    """(row, id, n_bytes, text) to (row, id, n_bytes, added, pieces, times), some documents at a time."""
    tokens = loaded(name, definition)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            end, size = at, 0
            added, offsets, pieces, times = [], [0], [], []
            while end < batch.num_rows and end - at < ROWS and size < BYTES:
                text = batch.column(3)[end].as_py()
                n, found = tokens.parts(text)
                added.append(n), pieces.extend(found), times.extend(found.values()), offsets.append(len(pieces))
                end, size = end + 1, size + len(text or "")
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(at, end - at) for k in range(3)), pa.array(added, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(pieces, pa.string())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))],
                ["row", "id", "n_bytes", "added", "pieces", "times"])
            at = end


def _counter(name: str, definition: Broadcast[str]) -> Callable:
    @F.pandas_udf("long")
    def count(pre_tokens: pd.Series) -> pd.Series:
        tokens = loaded(name, definition)
        return pd.Series([tokens.pieces(p) for p in pre_tokens], dtype="int64")

    return count


def most_used(vocabulary: DataFrame) -> DataFrame:
    """The pre-tokens above the lowest frequency class down to which they are ``FREQUENT`` at most, all of a class."""
    step = F.floor(STEPS * F.log2("docs")).cast("int")
    short = vocabulary.filter(F.octet_length("piece") <= SHORT)
    classes = short.groupBy(step.alias("step")).count().collect()  # some hundred rows, whatever the input
    room, lowest = FREQUENT, None
    for r in sorted(classes, reverse=True):
        room -= r["count"]
        if room < 0:
            break
        lowest = r["step"]
    return short.filter(step >= lowest if lowest is not None else F.lit(False)).select("piece", "n")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens and over_limit (above ``limit`` tokens).

    ``tokenizer``: path of the file on the driver; its content is sent to the workers.
    """
    spark = docs.sparkSession
    ship_package(spark)
    content = pathlib.Path(tokenizer).read_text(encoding="utf-8")
    name, definition = hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kept = f"row long, id {rows.schema['id'].dataType.simpleString()}, n_bytes long"
    parts = rows.mapInArrow(lambda batches: _split_rows(batches, name, definition), f"{kept}, added long, pieces array<string>, times array<long>")
    path = fresh_dir(spark, "pre-tokens")
    parts.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(parts.schema).parquet(path)
    used = rows.select(F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count("*").alias("docs"))
    vocabulary = stage(used.withColumn("n", _counter(name, definition)("piece")), "vocabulary")
    frequent = stage(most_used(vocabulary), "frequent")
    each = rows.select("row", F.explode(F.arrays_zip("pieces", "times")).alias("p")).select("row", F.col("p.pieces").alias("piece"), F.col("p.times").alias("times"))
    there = each.join(F.broadcast(frequent), "piece")  # FREQUENT short strings at most
    others = each.join(F.broadcast(frequent.select("piece")), "piece", "left_anti").join(vocabulary.select("piece", "n"), "piece")
    summed = [part.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("n")) for part in (there, others)]
    none = F.lit(None)
    sums = [part.select("row", none.cast(rows.schema["id"].dataType).alias("id"), none.cast("long").alias("n_bytes"), "n") for part in summed]
    whole = rows.select("row", "id", "n_bytes", F.col("added").alias("n")).union(sums[0]).union(sums[1])
    total = whole.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
