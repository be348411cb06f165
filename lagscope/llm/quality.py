"""Quality selection by importance resampling with hashed n-gram models.

Two generative models of hashed words and word pairs are counted: the target's over texts
labelled good, the raw one over all documents.  A document's weight is the ratio of its
likelihoods, and a Gumbel top-k draw keeps k documents without replacement, each as likely
as its weight.  k is the number of documents that lie above the level which best parts the
good from the bad in labelled rows held out from the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Rolling, in_pieces, materialise, mix64, small_batches, text_bytes

_U64 = np.uint64
_BYTE_CODES = mix64(np.arange(1, 257, dtype=_U64) * _U64(0xD6E8FEB86659FD93))

#: Class of a byte: 0 white space and control, 1 word, 2 punctuation.
_KIND = np.full(256, 2, np.uint8)
_KIND[:0x21] = 0
_KIND[0x7F] = 0
_KIND[0x80:] = 1
for _a, _z in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KIND[ord(_a) : ord(_z) + 1] = 1


def ngram_buckets(texts: list[bytes], buckets: int, rolling: Rolling) -> Iterator[np.ndarray]:
    """For each text, in order, the buckets of its words and punctuation runs and of their neighbouring pairs."""
    for a, b in in_pieces(texts):
        buffer = b"\n".join(t.lower() for t in texts[a:b]) + b"\n"
        raw = np.frombuffer(buffer, np.uint8)
        kind = _KIND[raw]
        edge = np.concatenate([[True], kind[1:] != kind[:-1]])
        cuts = np.append(np.flatnonzero(edge), len(raw))
        run = kind[cuts[:-1]] > 0
        starts, ends = cuts[:-1][run], cuts[1:][run]
        words = mix64(rolling.slices(_BYTE_CODES[raw], starts, ends))
        with np.errstate(over="ignore"):
            pairs = mix64(words[:-1] * _U64(Rolling.BASE) + words[1:]) % _U64(buckets)
        words = words % _U64(buckets)
        sizes = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
        first = np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes))])
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.concatenate([words[x:y], pairs[x : max(x, y - 1)]]).astype(np.int64)


def _count(shared, buckets: int):
    """Counts of each bucket over all texts and over those of the target; one set a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = shared.value
        rolling = Rolling()
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for d, grams in zip(batch.column("id").to_pylist(), ngram_buckets(text_bytes(batch.column("text")), buckets, rolling), strict=True):
                own = np.bincount(grams, minlength=buckets)
                counts[0] += own
                if d in target:
                    counts[1] += own
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "target"])

    return task


def _weigh_rows(shared, buckets: int, text_col: str):
    """Adds the mean log ratio of the text's n-grams to carried rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, _ = shared.value
        rolling = Rolling()
        for batch in batches:
            row = batch.column("row")
            weights = [float(ratio[g].mean()) if len(g) else None for g in ngram_buckets(text_bytes(row.field(text_col)), buckets, rolling)]
            yield pa.RecordBatch.from_arrays([row, batch.column("id"), batch.column("text_hash"), pa.array(weights, pa.float64())], names=["row", "id", "text_hash", "weight"])

    return task


def _weigh(shared, buckets: int):
    """The mean log ratio of each text's n-grams, null without any; and the label of a held-out row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, held_out = shared.value
        rolling = Rolling()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            weights = [float(ratio[g].mean()) if len(g) else None for g in ngram_buckets(text_bytes(batch.column("text")), buckets, rolling)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(weights, pa.float64()), pa.array([held_out.get(d) for d in ids], pa.int32())], names=["id", "text_hash", "weight", "label"])

    return task


def level_between(weights: np.ndarray, labels: np.ndarray, care: float = 1.0) -> float:
    """The weight that best parts label 1 (above) from 0: the largest sum of both labels' rates, that of label 1
    times ``care``, and of equal ones the middle of the widest gap."""
    if not len(weights) or labels.min() == labels.max():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, y = weights[order], labels[order]
    below_bad = np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum()
    above_good = 1 - np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum()
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    gaps = np.diff(edges)
    value = np.where(gaps > 0, below_bad + care * above_good, -1)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    i = best[gaps[best].argmax()]
    return float((edges[i] + edges[i + 1]) / 2)


def kth_largest(values: DataFrame, column: str, k: int, ways: int = 4096) -> int:
    """The k-th largest of a bigint column, exactly: counts in ever narrower bins, at most ``ways`` of them at once."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    above = 0  # values beyond the bins
    while low < high:
        step = max(1, -(-(high - low + 1) // ways))
        bins = values.filter(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - ({low})) div {step}").alias("bin")).count().collect()
        for x in sorted(bins, key=lambda x: -x["bin"]):
            if above + x["count"] >= k:
                low, high = low + x["bin"] * step, min(high, low + (x["bin"] + 1) * step - 1)
                break
            above += x["count"]
    return low


@dataclass
class _Draws:
    """All weights, what tasks need to weigh rows, and the draw and decision on (id, text_hash, weight)."""

    weighed: DataFrame
    shared: object
    draw: Column
    kept: Column


def _draws(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", buckets: int = 1 << 16, most_labelled: int = 20_000, smoothing: float = 1.0, sharpness: float = 200.0, care: float = 5.0, seed: int = 5) -> _Draws:
    spark = docs.sparkSession
    small_batches(spark)
    place = F.xxhash64(F.col(label_id_col).cast("bigint"), F.lit(seed))
    sample = labels.select(F.col(label_id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"), place.alias("place")).filter("id is not null and label in (0, 1)")
    sample = sample.groupBy("id", "place").agg(F.min("label").alias("label")).orderBy("place", "id").limit(most_labelled).collect()
    target = {x["id"] for i, x in enumerate(sample) if i % 2 == 0 and x["label"] == 1}
    held_out = {x["id"]: x["label"] for i, x in enumerate(sample) if i % 2}
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    counted = rows.select("id", "text").mapInArrow(_count(spark.sparkContext.broadcast(target), buckets), "bucket bigint, raw bigint, target bigint")
    counts = np.zeros((2, buckets))
    for x in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # a row a bucket at most
        counts[:, x["bucket"]] = x["raw"], x["target"]
    chance = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True)
    # the smaller model is pulled towards the raw one, so that what it has not met says little
    size = counts[1].sum()
    model = (counts[1] + smoothing * buckets * chance[0]) / (size + smoothing * buckets)
    ratio = np.log(model / chance[0]) if size else np.zeros(buckets)

    shared = spark.sparkContext.broadcast((ratio, held_out))
    weighed = materialise(rows.mapInArrow(_weigh(shared, buckets), "id bigint, text_hash bigint, weight double, label int"), "quality-weights")
    known = weighed.filter("label is not null and weight is not null").groupBy("id").agg(F.min("weight").alias("weight"), F.max("label").alias("label")).collect()  # a row a held-out id
    level = level_between(np.array([x["weight"] for x in known]), np.array([x["label"] for x in known]), care)

    uniform: Column = (F.pmod(F.xxhash64("id", "text_hash", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draw = F.col("weight") * sharpness - F.log(-F.log(uniform))
    rank = F.floor(draw * float(1 << 30)).cast("bigint")
    some = weighed.filter("weight is not null").select("weight", rank.alias("rank"))
    k = some.filter(F.col("weight") >= F.lit(level)).count()
    kept = F.coalesce(rank >= F.lit(kth_largest(some, "rank", k)), F.lit(False)) if k else F.lit(False)
    return _Draws(weighed, shared, draw, kept)


def resample_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Draw the documents that are like the labelled good ones.

    Returns one row per document: the id column, ``text_hash``, ``weight`` (the mean log ratio of its n-grams,
    target to raw), ``draw`` (``sharpness`` times the weight plus Gumbel noise from a hash of id and text) and
    ``kept`` (it is among the k largest draws).  The weight is a mean, times a fixed sharpness, so that a
    document is not judged by its length.

    ``most_labelled`` bounds the labelled rows that are used, taken in order of a hash of their ids; half of
    them make the target model (label 1), half set k, losing a good document counting ``care`` times.  The raw model and all draws cover all documents.

    Defined cases: a null or empty text, or one of white space alone, has no weight and is not kept; ties at
    the k-th draw are all kept, so repeated rows stay or go together; labels that are null or of unknown ids
    are not used, and of several labels of one id the worst counts; without labels of both kinds all documents with a weight are kept; empty tables are fine;
    other columns are not read.  ``options``: those of ``_draws``, with their defaults.
    """
    drawn = _draws(docs, labels, id_col=id_col, **options)
    return drawn.weighed.select(F.col("id").alias(id_col), "text_hash", "weight", drawn.draw.alias("draw"), drawn.kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``resample_quality`` keeps.

    Rows are weighed once more as they pass, so whole texts are neither stored nor shuffled.
    """
    drawn = _draws(docs, labels, id_col=id_col, text_col=text_col, buckets=buckets, **options)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"))
    schema = StructType([*rows.schema.fields, StructField("weight", DoubleType())])
    return rows.mapInArrow(_weigh_rows(drawn.shared, buckets, text_col), schema).filter(drawn.kept).select("row.*")
