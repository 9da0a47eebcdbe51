"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

The documents of a source are dealt into blocks by a hash, which is their random order.  A source's target
decides how many of its blocks the mix draws: whole passes over all blocks and a part of one more pass.  A
binary tree over the output shards then splits the sources' block quotas at random: at each node the left
half's share of every source is a hypergeometric draw, given what the sources before it took, so every shard
gets a random sample of the mix and all quotas are met exactly.  A source's draws go to the shards in order,
so no two shards share one; inside a shard rows are ordered by a hash of their own.

Null sources are a source of their own, the last.  Null and wordless texts have size 0: they are taken as
often as their source has whole passes.  Documents equal in id and text share a hash and are taken together.
The number of sources is that of a catalogue (each has an entry in one array of a plan row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import let, word_count
from newsloom.session import stage

BLOCKS = 4096
BLOCK_BITS = 12


def permuted(seed: int, *columns: Column | str) -> Column:
    """A document's place in its source's random order: 63 bits."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 63) - 1))


def light_rows(docs: DataFrame, source: str, id_col: str, text: str, seed: int, size: Column | None = None) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("src"), (word_count(F.col(text)) if size is None else size).alias("size"),
                       permuted(seed, F.col(id_col), F.xxhash64(text)).alias("place"))


def block(place: Column) -> Column:
    return F.shiftrightunsigned(place, 63 - BLOCK_BITS).cast("int")


def targets(light: DataFrame, cycle: Sequence[float], cap: float) -> DataFrame:
    """(src, nr, source_size, target): shares of all sizes by weight, none above ``cap`` times its source.

    With sources in order of cap / weight, those that overflow come first.  The share per unit of weight
    once the first k are full is (all - their caps) / (other weights); it rises while full ones are passed
    and falls after, so its maximum is the final one.  One row per source from here on.
    """
    sizes = light.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.col("nr") - 1, F.lit(len(cycle))) + 1).cast("int"))
    given = sizes.withColumn("nr", F.row_number().over(order)).withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    filling, all_rows = Window.orderBy(F.col("most") / F.col("weight"), "nr"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    per_weight = given.withColumn("unit", (F.sum("source_size").over(all_rows) - full) / open_weight)
    return per_weight.withColumn("unit", F.max("unit").over(all_rows)).select(
        "src", "nr", "source_size", F.least(F.col("most"), F.col("weight") * F.col("unit")).alias("target"))


def fill(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """(src, room, cut_block, cut_place): each source's rows (src, place, words) taken in order while its room lasts.

    Rows up to ``cut_place`` are taken; ``room`` is what they leave.  Blocks are summed per source (at most BLOCKS
    rows each), and only the block in which the room ends is entered row by row.  Rows of one place go together.
    """
    blocks = rows.groupBy("src", block(F.col("place")).alias("block")).agg(F.sum("words").alias("words"))
    room_of = rooms.select(F.col("src").alias("s"), "room")
    upto = Window.partitionBy("src").orderBy("block")
    summed = blocks.join(room_of, F.col("src").eqNullSafe(F.col("s"))).withColumn("upto", F.sum("words").over(upto))
    over = F.when(F.col("upto") > F.col("room"), F.struct("block", (F.col("room") - F.col("upto") + F.col("words")).alias("left")))
    ends = summed.groupBy(F.col("src").alias("s")).agg(F.min(over).alias("end"), F.sum("words").alias("all"))
    ends = stage(ends.select("s", "all", F.col("end.block").alias("cut_block"), F.col("end.left").alias("left")), "ends")
    entered = rows.join(ends.filter("cut_block is not null"), F.col("src").eqNullSafe(F.col("s")) & (block(F.col("place")) == F.col("cut_block")))
    entered = entered.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy("place")))
    inside = entered.filter("upto <= left").groupBy(F.col("src").alias("t")).agg(F.max("place").alias("last"), F.max("upto").alias("used"))
    met = rooms.join(ends, F.col("src").eqNullSafe(F.col("s")), "left").join(inside, F.col("src").eqNullSafe(F.col("t")), "left")
    whole, none = F.col("cut_block").isNull(), F.lit(0)
    before = F.shiftleft(F.col("cut_block").cast("long"), 63 - BLOCK_BITS) - 1
    return met.select("src", F.when(whole, F.col("room") - F.coalesce("all", none)).otherwise(F.col("left") - F.coalesce("used", none)).alias("room"),
                      F.coalesce("cut_block", F.lit(BLOCKS - 1)).alias("cut_block"),
                      F.when(whole, F.lit((1 << 63) - 1)).otherwise(F.coalesce("last", before)).alias("cut_place"))


def cuts(light: DataFrame, goals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, ..., passes, cut_block, cut_place) and (extra_src, extra): where the last, partial pass over a source ends.

    The pass goes on behind documents that do not fit, with those that do, round by round until what lacks is
    less than the smallest document left; that one is taken too if it brings the source nearer to its target.
    Each round's candidates are among those of the round before and no larger than what lacks, which falls
    below a document that did not fit.  ``extra`` are the places of documents taken behind the cut; their words
    are fewer than those of one document per source.
    """
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = stage(goals.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "goals")
    rooms = goals.filter("rest > 0").select("src", F.col("rest").alias("room"))
    first = stage(fill(light.select("src", "place", F.col("size").alias("words")), rooms), "first-cut")

    def spare(rows: DataFrame, state: DataFrame, most: Column) -> DataFrame:
        need = state.select(F.col("src").alias("s"), "room", "cut_place")
        return rows.join(need, F.col("src").eqNullSafe(F.col("s"))).filter((F.col("place") > F.col("cut_place")) & (F.col("words") <= most) & (F.col("words") > 0))

    behind = spare(light.withColumnRenamed("size", "words"), first, 2 * F.col("room")).groupBy("src", "place").agg(F.sum("words").alias("words"))
    behind = stage(behind, "behind")  # documents of one place are taken together
    extra, state = behind.select(F.col("src").alias("extra_src"), F.col("place").alias("extra")).limit(0), first.select("src", "room")
    open_rows = stage(spare(behind, first, F.col("room")).select("src", "place", "words"), "open")
    while not open_rows.isEmpty():
        now = stage(fill(open_rows, state), "next-cut")
        bound = now.select(F.col("src").alias("s"), "room", "cut_place")
        met = open_rows.join(bound, F.col("src").eqNullSafe(F.col("s")))
        extra = extra.union(stage(met.filter("place <= cut_place").select(F.col("src").alias("extra_src"), F.col("place").alias("extra")), "extra"))
        open_rows = stage(met.filter("place > cut_place and words <= room").select("src", "place", "words"), "open")
        state = now.select("src", "room")
    left = behind.join(extra, F.col("src").eqNullSafe(F.col("extra_src")) & (F.col("place") == F.col("extra")), "left_anti")
    nearest = left.join(state.select(F.col("src").alias("s"), "room"), F.col("src").eqNullSafe(F.col("s"))).filter("words < 2 * room")
    nearest = nearest.groupBy("src").agg(F.min(F.struct("words", "place")).alias("best")).select(F.col("src").alias("extra_src"), F.col("best.place").alias("extra"))
    cut = first.select(F.col("src").alias("s"), "cut_block", "cut_place")
    plans = goals.join(cut, F.col("src").eqNullSafe(F.col("s")), "left").select(
        "src", "nr", "source_size", "target", "passes", F.coalesce("cut_block", F.lit(-1)).alias("cut_block"), F.coalesce("cut_place", F.lit(-1)).alias("cut_place"))
    return plans, stage(extra.union(nearest), "extras")


def hypergeometric(total: Column, marked: Column, drawn: Column, even: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a random ``drawn``, from ``even`` in (0, 1).

    Inverse of the exact distribution: log ratios of neighbouring probabilities, summed over the values
    within ten standard deviations of the mode (beyond them a double holds no probability).
    """
    n, k, d = F.greatest(total, F.lit(1)).cast("double"), marked.cast("double"), drawn.cast("double")
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    reach = F.ceil(10 * F.sqrt(F.greatest(d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))) + 2
    low = F.greatest(F.lit(0), drawn - (total - marked), mode - reach).cast("long")
    high = F.least(drawn, marked, mode + reach).cast("long")

    def pick(ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        logs = F.aggregate(F.sequence(a + 1, b), F.array(F.lit(0.0)), lambda done, x: F.array_append(
            done, F.element_at(done, -1) + F.log((k - x + 1) * (d - x + 1) / (x * (n - k - d + x)))))
        scaled = let(logs, lambda v: F.transform(v, lambda y: F.exp(y - F.array_max(v))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        return let(scaled, lambda w: F.aggregate(w, start, lambda s, y: F.struct(
            (s["sum"] + y).alias("sum"), (s["below"] + F.when(s["sum"] + y < even * F.aggregate(w, F.lit(0.0), lambda p, q: p + q), 1).otherwise(0)).alias("below")),
            lambda s: F.least(a + s["below"], b)))

    return F.when((total <= 0) | (low >= high), F.greatest(low, F.lit(0))).otherwise(let(F.struct(low.alias("a"), high.alias("b")), pick)).cast("long")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(nr, quota) to (nr, ends): per source the running sum of its quotas over the shards in order."""
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("nr", "quota"))).alias("all")).select(F.lit(0).alias("node"), "all")
    level = shards
    while level > 1:
        start = F.struct(F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["quota"]).alias("total"),
                         F.floor((F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["quota"]) + F.pmod(F.xxhash64(F.lit(seed), "node", F.lit(level)), F.lit(2))) / 2).alias("room"),
                         F.array().cast("array<bigint>").alias("left"))

        drawn_by = F.lit(level)

        def deal(s: Column, x: Column) -> Column:
            even = (F.pmod(F.xxhash64(F.lit(seed), F.col("node"), drawn_by, x["nr"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)  # noqa: B023
            return let(hypergeometric(s["total"], x["quota"], s["room"], even), lambda got: F.struct(
                (s["total"] - x["quota"]).alias("total"), (s["room"] - got).alias("room"), F.array_append(s["left"], got).alias("left")))

        dealt = nodes.select("node", "all", F.aggregate("all", start, deal, lambda s: s["left"]).alias("left"))
        half = lambda q: F.zip_with("all", "left", lambda x, y: F.struct(x["nr"].alias("nr"), q(x["quota"], y).alias("quota")))
        nodes = dealt.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), half(lambda x, y: y).alias("all")),
            F.struct((F.col("node") * 2 + 1).alias("node"), half(lambda x, y: x - y).alias("all")))).alias("n")).select("n.*")
        level //= 2
    each = nodes.select("node", F.explode("all").alias("x")).select("node", "x.nr", "x.quota")
    sums = each.withColumn("end", F.sum("quota").over(Window.partitionBy("nr").orderBy("node")))
    return sums.groupBy("nr").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def plan(light: DataFrame, shards: int, seed: int, cycle: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """One row per source (target, passes, where the partial pass ends, its block quotas' running sums), and the extras."""
    plans, extras = cuts(light, targets(light, cycle, cap))
    plans = stage(plans, "mix-plan")
    ends = split_quotas(plans.select("nr", (F.col("passes") * BLOCKS + F.col("cut_block") + 1).cast("long").alias("quota")), shards, seed)
    return stage(plans.join(ends, "nr"), "mix-shards"), extras


def drawn(rows: DataFrame, plans: DataFrame, extras: DataFrame) -> DataFrame:
    """``rows`` (with src and place) with their source's plan and ``shards``: the shard of each time the mix takes them.

    The plan has one row per source, and the extras hold fewer words than one document per source; both are
    read from files, so the planner knows whether they are small enough to be sent to all tasks.
    """
    met = rows.join(plans.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    met = met.join(extras, F.col("src").eqNullSafe(F.col("extra_src")) & (F.col("place") == F.col("extra")), "left")
    once_more = (F.col("place") <= F.col("cut_place")) | F.col("extra").isNotNull()
    own = F.when(F.col("extra").isNotNull(), F.col("cut_block")).otherwise(block(F.col("place")))
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda k: k * BLOCKS + block(F.col("place"))))
    draws = F.concat(F.coalesce(whole, F.array().cast("array<int>")),
                     F.when(once_more, F.array(F.col("passes") * BLOCKS + own)).otherwise(F.array().cast("array<int>")))
    shard = lambda draw: F.size(F.filter("ends", lambda end: end <= draw))
    return met.withColumn("shards", F.transform(draws, shard)).drop("extra_src", "extra")


def dealt(docs: DataFrame, shards: int = 64, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 17, **how: object) -> DataFrame:
    """One row per document: id, src, size, source_size, target and ``shards``, one entry for each time the mix takes it."""
    light = stage(light_rows(docs, source, id_col, text, seed), "mix-light")
    return drawn(light, *plan(light, shards, seed, **how)).select("id", "src", "size", "source_size", "target", "shards")


def mixture(docs: DataFrame, shards: int = 64, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: int = 17, **how: object) -> DataFrame:
    """The mix: rows of ``docs``, repeated as their source's target asks, with ``shard`` and ``shard_order``.

    Input columns of these two names are replaced.
    """
    light = stage(light_rows(docs, source, id_col, text, seed), "mix-light")
    kept = [c for c in docs.columns if c not in ("shard", "shard_order")]
    row = docs.select(F.struct(*kept).alias("doc"), F.col(source).alias("src"), permuted(seed, F.col(id_col), F.xxhash64(text)).alias("place"))
    taken = drawn(row, *plan(light, shards, seed, **how)).select("doc", "place", F.posexplode("shards").alias("pass", "shard"))
    return taken.select("doc.*", "shard", F.xxhash64("place", "pass", F.lit(seed)).alias("shard_order"))


def write_mixture(mix: DataFrame, path: str) -> None:
    """Write a mixture below ``path`` as shard=0, 1, ..., each shuffled."""
    mix.repartition("shard", F.pmod("shard_order", F.lit(16))).sortWithinPartitions("shard", "shard_order").write.partitionBy("shard").parquet(path)
