"""Near-duplicate documents by min-max hashing.

Documents are sets of word shingles.  Under each permutation both the least and the
greatest hash are kept, so a signature takes half as many hash evaluations as its length;
bands of the signature bring similar sets into a bucket.  Exact copies of a set are
reduced to one representative first.  In a bucket, members are not compared with one
another but with a hub, the member whose buckets are fullest: among near copies of a text
that is the text itself or one close to it.  What is left are buckets whose members lie in
several components; their cross pairs are found by an exact prefix join: members of other
components than their bucket's largest meet members that share one of their rarest
shingles early enough for the similarity to be reachable.  So copies that are not quite
alike cost what they share beyond the common text, and no link is lost in a bucket.  A
link is an exact comparison of two whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, copied, dealt, hot_keys, in_pieces, materialise, mix64, small_batches, text_bytes, word_table
from .decontamination import gram_hashes
from .graph import components

_U64 = np.uint64
_TABLE = word_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Chance that a pair just at the threshold shares no bucket.
MISS = 1e-7


def band_count(similarity: float, rows: int) -> int:
    """Bands of ``rows`` values that leave a pair of this similarity unseen with a chance of ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity**rows))


def shingle_sets(texts: list[bytes], shingle: int, rolling: Rolling) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for a, b in in_pieces(texts):
        words = Words([t.lower() for t in texts[a:b]], _TABLE)
        hashes = words.hashes(rolling)
        grams = gram_hashes(hashes, shingle)
        for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            n = y - x
            yield np.unique(grams[x : y - shingle + 1]) if n >= shingle else gram_hashes(hashes[x:y], n) if n else hashes[:0]


class MinMax:
    """Band keys of sets, from the least and greatest of ``x * a + b`` over the set for odd multipliers ``a``."""

    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        self.bands, self.rows = bands, rows
        n = (bands * rows + 1) // 2
        base = mix64(np.arange(1, 2 * n + 1, dtype=_U64) + _U64(seed << 32))
        self.times, self.plus = base[:n] | _U64(1), base[n:]
        self.salt = mix64(np.arange(1, bands + 1, dtype=_U64))

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of band keys for each set; sets must not be empty."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        at = np.cumsum(sizes) - sizes
        values = np.concatenate(sets)
        n = len(self.times)
        signature = np.empty((len(sets), 2 * n), _U64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = values * self.times[i] + self.plus[i]
                signature[:, i] = np.minimum.reduceat(h, at)
                signature[:, n + i] = np.maximum.reduceat(h, at)
            key = np.tile(self.salt, (len(sets), 1))
            grid = signature[:, : self.bands * self.rows].reshape(len(sets), self.bands, self.rows)
            for j in range(self.rows):
                key = mix64(key * _U64(Rolling.BASE) + grid[:, :, j])
        return key


def _signatures(shingle: int, bands: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, hasher = Rolling(), MinMax(bands, rows)

        def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            prints: list = [None] * len(sets)
            if full:
                for i, k in zip(full, hasher.keys([sets[i] for i in full]).view(np.int64), strict=True):
                    keys[i] = k
                    prints[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "print", "keys"])

        for batch in batches:
            ids: list = []
            sets: list[np.ndarray] = []
            held = 0
            for d, s in zip(batch.column("id").to_pylist(), shingle_sets(text_bytes(batch.column("text")), shingle, rolling), strict=True):
                ids.append(d)
                sets.append(s)
                held += len(s)
                if held > 100_000 or len(sets) >= 1000:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if sets:
                yield out(ids, sets)

    return task


def _sets(shingle: int, shared):
    """The sets of rows whose ``spot`` is in the shared bitmap."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, bitmap = Rolling(), shared.value
        for batch in batches:
            spots = batch.column("spot").to_numpy()
            some = batch.take(pa.array(np.flatnonzero(bitmap[spots >> 3] >> (spots & 7).astype(np.uint8) & 1)))
            ids = some.column("id")
            texts = text_bytes(some.column("text"))
            for i in range(0, len(texts), 256):
                sets = list(shingle_sets(texts[i : i + 256], shingle, rolling))
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), pa.array(prints, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "print", "set"])

    return task


def _spot(bits: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(bits))


def _bitmap(ids: DataFrame, most_bits: int) -> tuple[int, np.ndarray]:
    """A bitmap, and its number of bits, with the ``_spot`` of every id: 16 to 32 bits an id up to ``most_bits``.

    What it lets through is joined with the ids themselves, so a full one costs a shuffle and nothing else.
    """
    bits = 1 << 15
    need = 16 * ids.count()
    while bits < min(need, most_bits):
        bits *= 2
    bitmap = np.zeros(bits // 8, np.uint8)
    for x in ids.groupBy((_spot(bits) / (1 << 15)).cast("int").alias("part")).agg(F.bitmap_construct_agg(_spot(bits) % (1 << 15)).alias("set")).collect():  # bits / 32768 rows at most
        bitmap[x["part"] << 12 : x["part"] + 1 << 12] = np.frombuffer(x["set"], np.uint8)
    return bits, bitmap


def _cross_pairs(alive: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components, one of them ``other``, that may reach the similarity.

    The shingles of each set are ordered by how many sets have them.  Two sets of sizes m and n that reach it
    share a shingle among the first m - ceil(percent % of m) + 1 of one and as many of the other; at the first
    they share, at positions i and j, at most min(m - i, n - j) shingles are left to share.
    """
    shingles = alive.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "print", "c", "other", F.size("set").alias("size"), F.explode("set").alias("shingle"))
    common = materialise(shingles.groupBy("shingle").agg(F.count("*").alias("n")), "near-shingles")
    hot = materialise(hot_keys(common, "shingle"), "near-hot")
    counted = dealt(shingles, "shingle", hot, ["rep"]).join(copied(common.withColumnRenamed("n", "df"), "shingle", hot), ["shingle", "piece"])
    ranked = counted.groupBy("rep", "print", "c", "other", "size").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    first = F.slice("all", F.lit(1), F.col("size") - F.expr(f"(size * {percent} + 99) div 100").cast("int") + 1)
    prefix = materialise(ranked.select("rep", "c", "other", "size", F.posexplode(first).alias("at", "x")).select("rep", "c", "other", "size", "at", "x.shingle", "x.df").filter("df > 1"), "near-prefixes")
    p = copied(prefix.filter("other"), "shingle", hot).select("shingle", "piece", F.col("rep").alias("p"), F.col("c").alias("pc"), F.col("size").alias("m"), F.col("at").alias("i"))
    q = dealt(prefix, "shingle", hot, ["rep"]).select("shingle", "piece", F.col("rep").alias("q"), F.col("c").alias("qc"), F.col("size").alias("n"), F.col("at").alias("j"))
    most = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    reachable = (100 + percent) * most >= percent * (F.col("m") + F.col("n"))
    both = p.join(q, (p["shingle"] == q["shingle"]) & (p["piece"] == q["piece"]) & (F.col("pc") != F.col("qc")) & reachable)
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, rows: int = 4, most_bits: int = 1 << 27) -> DataFrame:
    """Components of documents whose shingle sets A, B have 100 * |A and B| >= ``percent`` * |A or B|.

    Returns one row per document: the id column, ``n_shingles``, ``component_id`` (the least id reachable by
    links, itself included) and ``kept`` (it is that id).  A-Z is lower-cased; words are separated by ASCII
    white space; a text of fewer words than a shingle is one shingle.  ``rows``: values in a band.  Shingles
    are compared as 64-bit hashes.  ``most_bits``: size of the bitmap that keeps the sets of documents in no
    shared bucket from being shuffled.

    Defined cases: a null or empty text has an empty set, which links with nothing; rows of one id are one
    node of the graph, linked by what any of their texts links to; a null id links with nothing, has no
    component and is kept; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    bands = band_count(percent / 100, rows)
    signed = materialise(source.mapInArrow(_signatures(shingle, bands, rows), "id bigint, n bigint, print binary, keys array<bigint>"), "near-signatures")

    linked = signed.filter("n > 0 and id is not null")
    classes = materialise(linked.groupBy("print").agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys"), F.count("*").alias("n")), "near-classes")
    # rows of one id with different sets are one node
    ids = linked.groupBy("id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q").select("id")
    twins = linked.join(ids, "id").select("id", "print").join(classes.select("print", "rep"), "print").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    rows_of = classes.select(F.explode("keys").alias("key"), "rep")
    buckets = materialise(rows_of.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    hot = materialise(hot_keys(buckets, "key"), "near-hot")
    members = materialise(dealt(rows_of, "key", hot, ["rep"]).join(copied(buckets, "key", hot), ["key", "piece"]), "near-members")
    weights = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    members = members.join(weights, "rep")
    hubs = members.groupBy("key").agg(F.max_by("rep", F.struct("weight", F.xxhash64("rep"))).alias("hub"))
    members = materialise(members.join(copied(hubs, "key", hot), ["key", "piece"]).select("key", "piece", "rep", "n", "hub"), "near-hubs")

    # sets of those in shared buckets: all of a node's, if rows of its id differ
    involved = materialise(members.select(F.col("rep").alias("id")).distinct(), "near-involved")
    bits, bitmap = _bitmap(involved, most_bits)
    texts = source.filter("id is not null").withColumn("spot", _spot(bits))
    sets = texts.mapInArrow(_sets(shingle, docs.sparkSession.sparkContext.broadcast(bitmap)), "id bigint, print binary, set array<bigint>")
    sets = sets.filter(F.size("set") > 0).join(involved, "id", "left_semi")
    sets = materialise(sets.groupBy("id", "print").agg(F.any_value("set").alias("set")), "near-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that reach the similarity; either may be in very many."""
        pairs = materialise(pairs, "near-pairs")
        both = pairs
        for end, set_ in (("b", "y"), ("a", "x")):
            of = materialise(hot_keys(pairs.groupBy(end).agg(F.count("*").alias("n")), end), "near-hot")
            own = copied(sets.select(F.col("id").alias(end), F.col("set").alias(set_)), end, of)
            both = dealt(both, end, of, ["a", "b"]).join(own, [end, "piece"]).drop("piece")
        shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("i"), (F.size("x") + F.size("y")).cast("bigint").alias("t"))
        return shared.filter(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")

    links = materialise(confirmed(members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()).union(twins), "near-links")
    found = components(links)
    # buckets that are still several components; of two members the hub has been compared with the other
    named = members.filter("n > 2").select("key", "piece", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "piece", "rep", F.coalesce("component", "rep").alias("c"))
    split = named.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("q")).filter("p <> q").select("key")
    named = materialise(named.join(copied(split, "key", hot), ["key", "piece"]), "near-split")
    if not named.isEmpty():
        largest = named.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"))
        alive = named.join(copied(largest, "key", hot), ["key", "piece"]).groupBy("rep", "c").agg(F.max(F.col("c") != F.col("main")).alias("other"))
        pairs = _cross_pairs(materialise(alive, "near-alive"), sets, percent)
        more = materialise(confirmed(pairs), "near-links")
        if not more.isEmpty():
            found = components(links.union(more))

    named = classes.select("print", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    copies = materialise(hot_keys(classes, "print"), "near-hot")
    of = dealt(signed.select("id", "n", "print"), "print", copies, ["id"]).join(copied(named, "print", copies), ["print", "piece"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return of.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
