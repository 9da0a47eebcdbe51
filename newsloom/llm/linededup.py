"""Line de-duplication: an exact set-similarity join of lines, later matches removed.

A line's tokens are its distinct five-word shingles (a line with fewer words is one token).  Two lines match if
the Jaccard similarity of their token sets is at least 4/5.  A line is removed if any earlier line matches it,
kept or not; earlier is by document id, then line number (documents without an id come last, and documents of
one id go by the hash of their text).  Lines without a word are never removed.  Rows equal in id and text are
one document and lose the same lines.  Null texts stay null.

The join: a set of n tokens is looked up by the first n - ceil(4n/5) + 1 in any one order of tokens, for sets that
match share one of those.  Equal sets are folded together first.  It goes by two orders.  By that of the hashes, which
costs no count, all sets are looked up; those that share no token there match nothing and are done with.  For the
others tokens are ordered by rarity (counted over their lines in hash buckets; any order is right, a rare-first one is
fast).  Lengths and positions rule out most others, and what is left is verified on the whole sets.
Within a group that shares a token each line is compared with the earliest;
only lines that this does not settle are compared with the others, so a group of copies never yields all pairs.
Tokens are 64-bit hashes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import let, unused
from newsloom.session import stage

BUCKETS = 1 << 16
FILTER_WORDS = 1 << 17  # of 64 bits: a fixed megabyte


def tokens(line: Column, width: int) -> Column:
    """Hashes of the shingles of a line whose only blanks are spaces, none at its ends; in order, repeats included."""
    def shingles(hashed: Column) -> Column:
        starts = F.slice(hashed, F.lit(1), F.size(hashed) - (width - 1))
        each = F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(hashed, i + k) for k in range(1, width))))
        return F.when(F.size(hashed) < width, F.array(F.xxhash64(hashed))).otherwise(each)

    found = F.split(line, " ")
    found = F.when(F.contains(line, F.lit("  ")), F.array_remove(found, "")).otherwise(found)
    return let(F.transform(found, lambda w: F.xxhash64(w)), shingles)


def document(id_col: str, text: str) -> Column:
    """The place of a document in the order of all, without nulls."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("content"))


def text_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, line, body) of the lines with a word, all blanks as spaces, without those at their ends."""
    other = "\t\x0b\f\r"
    has_other = functools.reduce(lambda a, b: a | b, (F.contains(F.col(text), F.lit(c)) for c in other))
    spaced = F.when(has_other, F.translate(text, other, " " * len(other))).otherwise(F.col(text))
    lines = docs.select(document(id_col, text).alias("doc"), F.posexplode_outer(F.split(spaced, "\n")).alias("line", "body"))
    # outer: else Spark first filters by the size of the array and so splits each text twice
    return lines.select("doc", "line", F.trim("body").alias("body")).filter("body <> ''")


def rarity(sets: DataFrame) -> Column:
    """For each hash bucket of the sets' ``tokens`` one of 16 classes, by its count against the mean.

    An array of fixed size, so it can be part of the plan.
    """
    bucket = F.col("t").bitwiseAND(F.lit(BUCKETS - 1))
    counts = stage(sets.select(F.explode_outer("tokens").alias("t")).groupBy(bucket.alias("bucket")).count(), "token-counts")
    mean = counts.agg(F.sum("count") / BUCKETS).scalar()
    classed = counts.select("bucket", F.least(F.lit(15), F.floor(2 * F.log2(1 + F.col("count") / mean))).cast("long").alias("class"))
    held = {r["bucket"]: r["class"] for r in classed.collect()}  # at most BUCKETS rows
    return F.split(F.lit(",".join(str(held.get(k, 0)) for k in range(BUCKETS))), ",").cast("array<long>")


def ordered(token: Column, classes: Column) -> Column:
    """The token as a number that sorts by rarity class first."""
    place = (token.bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")
    return F.shiftleft(F.element_at(classes, place), 59).bitwiseOR(F.shiftrightunsigned(token, 5))


def seen_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row: a fixed-size bit table of hashed longs; may say yes wrongly, never no."""
    word, bit = F.shiftright(spread(F.col(key)), 6), spread(F.col(key)).bitwiseAND(F.lit(63)).cast("int")
    bits = keys.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    every = keys.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word").join(bits, "word", "left")
    return stage(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bits")), "filter")


def spread(key: Column) -> Column:
    return F.xxhash64(key, F.lit(3)).bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))


def maybe_seen(table: DataFrame, key: Column) -> Column:
    at = spread(key)
    word = F.element_at(table.scalar(), (F.shiftright(at, 6) + 1).cast("int"))
    return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def needed(n: Column) -> Column:
    """ceil(4n/5)"""
    return F.floor((4 * n + 4) / 5).cast("int")


def could_match(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and position: sets of n and m tokens that first meet at their places i and j (from 0)."""
    most = F.least(n - i, m - j)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (n + m))


def first_of(sorted_tokens: Column) -> Column:
    """What a set is looked up by."""
    n = F.size(sorted_tokens)
    return F.slice(sorted_tokens, F.lit(1), n - needed(n) + 1)


def later_matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(doc, line) of every line to remove."""
    codes = F.sort_array(F.array_distinct(tokens(F.col("body"), width)))
    coded = text_lines(docs, id_col, text).select(F.struct("doc", "line").alias("at"), codes.alias("codes"))
    keyed = stage(coded.select("at", F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit(7), "codes").alias("h2"), first_of(F.col("codes")).alias("prefix")), "line-keys")
    # equal sets: h1 and h2 together name a set; only sets that come twice are ordered by line
    copied = stage(keyed.groupBy("h1", "h2").count().filter("count > 1").select("h1"), "copied")
    copies = keyed.select("at", "h1", "h2").filter(maybe_seen(seen_filter(copied, "h1"), F.col("h1")))
    firsts = copies.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("lines")).filter("lines > 1").select("h1", "h2", "first")
    equal = stage(copies.join(stage(firsts, "first-copies"), ["h1", "h2"]).filter(F.col("at") != F.col("first")).select("at"), "equal")

    # sets that share a key with a different one; only the first lines of these go on
    keys = keyed.select("at", "h1", F.explode_outer("prefix").alias("key"))
    shared = stage(keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("key"), "shared-keys")
    common = keys.filter(maybe_seen(seen_filter(shared, "key"), F.col("key"))).join(shared, "key", "left_semi").select("at").distinct()
    places = stage(common.join(equal, "at", "left_anti"), "places")  # staged, for the range partitioner reads it twice
    # numbers that rise with the order of the lines
    first = stage(places.repartitionByRange("at").sortWithinPartitions("at").withColumn("nr", F.monotonically_increasing_id()), "first-lines")
    tokens_of = line_sets(docs, id_col, text, width, first)

    classes = rarity(tokens_of)
    rare_first = tokens_of.select("nr", F.size("tokens").alias("n"), F.sort_array(F.transform("tokens", lambda t: ordered(t, classes))).alias("codes"))
    numbered = stage(rare_first.select("nr", "n", F.posexplode_outer(first_of(F.col("codes"))).alias("i", "key")), "numbered")
    centres = stage(numbered.groupBy("key").agg(F.min("nr").alias("centre"), F.max("nr").alias("last")).filter("centre < last").select("key", "centre"), "centres")
    met = stage(numbered.filter(maybe_seen(seen_filter(centres, "key"), F.col("key"))).join(centres, "key"), "met")

    a, b = met.alias("a"), met.alias("b")
    fits = could_match(F.col("a.n"), F.col("a.i"), F.col("b.n"), F.col("b.i"))
    star = a.filter("nr = centre").join(b.filter("nr > centre"), F.col("a.key") == F.col("b.key")).filter(fits)
    settled = stage(verified(star.select(F.col("a.nr").alias("x"), F.col("b.nr").alias("y")).distinct(), tokens_of), "settled")
    open_rows = met.filter("nr > centre").join(settled, met["nr"] == settled["y"], "left_anti").alias("b")
    rest = a.filter("nr > centre").join(open_rows, (F.col("a.key") == F.col("b.key")) & (F.col("a.nr") < F.col("b.nr"))).filter(fits)
    more = verified(rest.select(F.col("a.nr").alias("x"), F.col("b.nr").alias("y")).distinct(), tokens_of)
    near = first.select("nr", "at").join(settled.union(more), F.col("nr") == F.col("y"), "left_semi").select("at.doc", "at.line")
    return stage(equal.select("at.doc", "at.line").union(near), "later-matches")


def line_sets(docs: DataFrame, id_col: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(nr, tokens) of the wanted lines, read from their documents again; only those lines are hashed."""
    seen = seen_filter(wanted.select(F.xxhash64("at").alias("p")), "p")
    place = F.struct("doc", "line")
    lines = text_lines(docs, id_col, text).filter(maybe_seen(seen, F.xxhash64(place)))
    found = lines.select(place.alias("place"), F.array_distinct(tokens(F.col("body"), width)).alias("tokens")).join(wanted, F.col("place") == F.col("at"))
    return stage(found.dropDuplicates(["nr"]).select("nr", "tokens"), "line-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(y) of the pairs whose sets match."""
    left, right = sets.select(F.col("nr").alias("x"), F.col("tokens").alias("s")), sets.select(F.col("nr").alias("y"), F.col("tokens").alias("t"))
    both = pairs.join(left, "x").join(right, "y")
    return both.filter(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("y").distinct()


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with the later matches taken out of ``text``, and ``_lines`` (before, removed); a column of that name is replaced.

    Only documents that may lose a line are shuffled; the others pass through.
    """
    gone = stage(later_matches(docs, id_col, text, width).groupBy("doc").agg(F.collect_set("line").alias("gone")), "gone")
    table = seen_filter(gone.select(F.xxhash64("doc").alias("d")), "d")
    plain = docs.drop("_lines")
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    count = F.coalesce(ends + 1, F.lit(0)).cast("long")
    may = maybe_seen(table, F.xxhash64(document(id_col, text)))
    untouched = plain.filter(~may).withColumn("_lines", F.struct(count.alias("before"), F.lit(0).cast("long").alias("removed")))
    own, new = unused("_doc", plain), unused("_left", plain)
    touched = plain.filter(may).withColumn(own, document(id_col, text))
    joined = touched.join(gone, touched[own] == gone["doc"], "left")
    body = F.split(joined[text], "\n")
    left = F.array_join(F.filter(body, lambda x, k: ~F.array_contains(gone["gone"], k)), "\n")
    made = joined.withColumn("_lines", F.struct(count.alias("before"), F.coalesce(F.size(gone["gone"]), F.lit(0)).cast("long").alias("removed")))
    made = made.withColumn(new, F.when(gone["gone"].isNull(), touched[text]).otherwise(left))
    kept = [F.col(new).alias(c) if c == text else touched[c] for c in plain.columns]
    return untouched.union(made.select(*kept, "_lines"))
