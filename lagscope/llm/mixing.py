"""Mixing sources to target weights, in fixed-length blocks of words.

DataFrame functions only.  Each source's words are packed end to end into blocks of
``block`` words.  The mix is a row of slots, cut into output shards.  A shard's source counts
are a multinomial draw: each of its slots draws a source.  The draws of all shards together
miss the sources' totals a little; what a source has drawn too much is given up evenly over
its shards, and the slots so freed go to the sources that have drawn too little.  The slots of
a source are mapped to its blocks through a pseudorandom permutation of the block numbers,
pass by pass, and slots and documents meet in a join on (source, block).  The last slot of a
source takes a part of its block, so its taken words are its target, rounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, shuffle_width

#: Slots of one partition.
SLOTS = 1 << 18
#: Rows of one source that share a bucket of the running word count.
BUCKET_ROWS = 256
#: Steps of a running sum that one window takes.
RUN = 4096


def permuted(x: Column, n: Column, key: Column, rounds: int = 3, walk: int = 32) -> Column:
    """The image of x under a pseudorandom permutation of 0..n-1 that ``key`` chooses.

    A Feistel network on pairs (x div b, x mod b) with a * b just above n; images of n or more are mapped
    again until they fall below (``walk`` times: always enough for n up to 900, and beyond that all but
    certain, as at most one image in sqrt(n) lies above).
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n / a).cast("bigint")

    def once(v: Column) -> Column:
        left, right = F.floor(v / b).cast("bigint"), v % b
        for i in range(rounds):
            left = F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(2 * i)), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(2 * i + 1)), b), b)
        return left * b + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``target`` words of each (source, source_size): shares by weight, none above ``most`` times its size.

    Sources are numbered by code point, null last; weights repeat.  What a capped source leaves is shared
    among the others by weight until none is above its cap: with sources ordered by cap per weight, one is
    capped if what is left for it and those after it would give it its cap or more.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("double"), "cap": (F.col("source_size") * most).cast("double")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    capped = ranked.withColumn("capped", F.col("cap") / F.col("weight") <= left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    share = F.col("weight") * free / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return capped.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(share, F.col("cap")))).drop("cap", "capped", "weight")


def running(rows: DataFrame, keys: list[str], step: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the smaller ``step`` of the same ``keys``.

    Sums of runs of ``RUN`` steps come first, so that no window holds all the steps of a key.
    """
    rows = rows.withColumn("run", F.expr(f"{step} div {RUN}"))
    before = lambda own, order: Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*keys, "run").agg(F.sum(value).alias("of_run"))
    runs = runs.withColumn("of_runs", F.coalesce(F.sum("of_run").over(before(keys, "run")), F.lit(0))).drop("of_run")
    inside = F.coalesce(F.sum(value).over(before([*keys, "run"], step)), F.lit(0))
    return rows.withColumn(name, inside).join(runs, [*keys, "run"]).withColumn(name, F.col(name) + F.col("of_runs")).drop("run", "of_runs")


def _among(bounds: Column, steps: Column, x: Column) -> Column:
    """How many of the ascending ``bounds`` are x or less, by bisection; ``steps``: powers of two, descending."""
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when((at + n <= F.size(bounds)) & (F.get(bounds, at + n - 1) <= x), at + n).otherwise(at))


def _drawn_ranks(numbers: DataFrame, shares: DataFrame, x: Column, share: str) -> DataFrame:
    """Adds ``rank``: the source in whose stretch of the number line x lies; stretches are as long as ``share``."""
    lines = shares.filter(F.col(share) > 0).select("rank", F.sum(share).over(Window.orderBy("rank")).alias("end"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "end")))
    table = lines.agg(ordered.alias("all")).select(F.col("all.rank").alias("ranks"), F.col("all.end").alias("ends"))
    steps = F.array(*(F.lit(1 << i) for i in range(24, -1, -1)))
    return numbers.crossJoin(F.broadcast(table)).withColumn("rank", F.get("ranks", _among(F.col("ends"), steps, x))).drop("ranks", "ends")  # one row, a number a source


def shard_counts(sources: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """``n`` slots of each (shard, rank): a multinomial draw for each shard, settled to the sources' totals.

    ``sources``: ``rank`` and ``n``, which sum to ``slots``.
    """
    spark = sources.sparkSession
    width = max(shuffle_width(spark), slots // SLOTS + 1)
    each = spark.range(0, slots, 1, width)
    each = _drawn_ranks(each, sources, F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(slots)), "n")
    drawn = each.groupBy(F.expr(f"id div {shard_slots}").alias("shard"), "rank").agg(F.count("*").alias("c"))
    drawn = materialise(drawn, "mix-drawn")
    totals = drawn.groupBy("rank").agg(F.sum("c").alias("drawn"))
    totals = sources.select("rank", "n").join(totals, "rank", "left").select("rank", F.coalesce("drawn", F.lit(0)).alias("drawn"), "n")
    totals = materialise(totals.withColumns({"over": F.greatest(F.col("drawn") - F.col("n"), F.lit(0)), "under": F.greatest(F.col("n") - F.col("drawn"), F.lit(0))}), "mix-totals")
    before = running(drawn, ["rank"], "shard", "c", "before").join(totals.select("rank", "drawn", "over"), "rank")
    given = F.expr("(over * (before + c)) div drawn - (over * before) div drawn")
    kept = materialise(before.select("shard", "rank", "c", given.alias("given")), "mix-kept")
    free = running(kept.groupBy("shard").agg(F.sum("given").alias("given")).filter("given > 0").withColumn("one", F.lit(0)), ["one"], "shard", "given", "before")
    freed = totals.agg(F.sum("under")).first()[0] or 0
    free = free.select("shard", F.explode(F.expr("sequence(before, before + given - 1)")).alias("j"))
    taken = _drawn_ranks(free, totals, permuted(F.col("j"), F.lit(freed), F.lit(seed + 2)), "under").groupBy("shard", "rank").agg(F.count("*").alias("n"))
    return kept.select("shard", "rank", (F.col("c") - F.col("given")).alias("n")).unionByName(taken).groupBy("shard", "rank").agg(F.sum("n").alias("n")).filter("n > 0")


@dataclass
class Mix:
    """``documents``: id, tie, size, source_size, target, rank, start.  ``slots``: shard, slot, rank, pass, block and
    ``words``, how many of the block's the slot takes.  ``taken``: one row per slot and document part: shard, slot,
    pass, rank, block, id, tie, and the words ``begin`` to ``end`` of the document.  ``rows``: tie and ``row``, all
    columns of the document, if they were carried."""

    documents: DataFrame
    slots: DataFrame
    taken: DataFrame
    rows: DataFrame | None = None


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 128, shard_slots: int = 65_536, seed: int = 7, carry: bool = False) -> Mix:
    """Draw a mix of all sources of as many words as they have together.

    A source gives whole passes over its blocks while its target allows, then the first words of one more pass; so
    its taken words are its target, rounded, and no document is taken more than ``most`` times.  The result depends
    on ids, sources, sizes and ``seed`` alone.  ``carry``: keep whole rows, to be joined by ``tie``.

    Defined cases: a null or empty text has no words and is taken 0 times; null is a source of its own; equal
    ids are separate documents, and identical rows are interchangeable; a source without words has target 0;
    an empty table gives empty results; other columns are not read.
    """
    spark = docs.sparkSession
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(text_col).alias("text_hash"), *whole)
    held = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "mix-sizes")
    rows = held.drop("row")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.least(F.col("source_size"), F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint")))
    sources = source_targets(sizes, weights, most).withColumn("passes", passes)
    sources = sources.withColumn("rest", F.when(F.col("passes") < most, rest).otherwise(0))
    # the whole blocks of a pass come first, in a permuted order, and its short one, if there is one, last
    sources = sources.withColumns({"full": F.expr(f"source_size div {block}"), "blocks": F.expr(f"(source_size + {block - 1}) div {block}")})
    sources = sources.withColumn("n", F.expr(f"passes * blocks + (rest + {block - 1}) div {block}"))
    sources = materialise(sources.withColumn("buckets", F.expr(f"(rows + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}")), "mix-sources")

    # words before each document in its source: bucket totals first, then a window inside each bucket
    keyed = rows.join(sources.select(F.col("source").alias("s_source"), "rank", "source_size", "target", "buckets"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source", "source")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("id", "text_hash", "tie"), F.col("buckets")))
    totals = running(keyed.groupBy("rank", "bucket").agg(F.sum("size").alias("words")), ["rank"], "bucket", "words", "before").drop("words")
    inside = Window.partitionBy("rank", "bucket").orderBy("id", "size", "text_hash", "tie").rowsBetween(Window.unboundedPreceding, 0)
    documents = keyed.join(totals, ["rank", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    documents = materialise(documents.select("id", "text_hash", "tie", "size", "source_size", "target", "rank", "start"), "mix-documents")

    all_slots = sources.agg(F.sum("n")).first()[0] or 0
    counts = materialise(shard_counts(sources.filter("n > 0"), all_slots, shard_slots, seed), "mix-counts")
    counts = running(counts, ["rank"], "shard", "n", "first")
    counts = counts.withColumn("place", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # few rows that make many: a fixed number of partitions, and a join that never broadcasts what they make
    counts = counts.join(sources.select("rank", "full", "blocks", "passes", "rest", "source_size"), "rank").repartition(max(shuffle_width(spark), all_slots // SLOTS + 1), "shard", "rank")
    slots = counts.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("q", F.col("first") + F.col("i"))
    slots = slots.withColumns({"pass": F.expr("q div blocks"), "j": F.expr("q % blocks")})
    number = F.when(F.col("j") < F.col("full"), permuted(F.col("j"), F.greatest(F.col("full"), F.lit(1)), F.xxhash64("rank", "pass", F.lit(seed + 1)))).otherwise(F.col("full"))
    words = F.when(F.col("pass") < F.col("passes"), F.least(F.lit(block), F.col("source_size") - F.col("j") * block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("j") * block))
    size = F.least(F.lit(shard_slots), F.lit(all_slots) - F.col("shard") * shard_slots)
    slot = permuted(F.col("place") + F.col("i"), size, F.xxhash64("shard", F.lit(seed)))
    slots = slots.select("rank", "pass", number.alias("block"), "shard", slot.alias("slot"), words.alias("words"))

    parts = documents.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    parts = parts.select("id", "text_hash", "tie", "rank", "block", "start", "size", (F.greatest(F.col("start"), F.col("block") * block) - F.col("start")).alias("begin"))
    taken = slots.hint("merge").join(parts, ["rank", "block"]).withColumn("end", F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("start"))).filter(F.col("begin") < F.col("end")).drop("start", "size", "words")
    return Mix(documents, slots, taken, held.select("tie", "row") if carry else None)


def taken_words(mix: Mix) -> DataFrame:
    """Each document with the words that the mix takes from it, repeats counted."""
    sums = mix.taken.groupBy("tie").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    return mix.documents.join(sums, "tie", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
