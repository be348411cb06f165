"""Pieces shared by the corpus operators: scratch tables, hashing and word spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U64 = np.uint64


#: Name of the vocabulary file that queries and stages take from the public tokenizers.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lagscope-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one key that a task should get of it at least, before they are dealt to several, and keys so dealt at most.
HOT_ROWS, HOT_KEYS = 256, 100_000


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """From ``key`` and ``n``, its rows: the keys of many rows, with the number of ``pieces`` to deal them in.

    What is many grows with the sum of all n, so that there are ``HOT_KEYS`` such keys at most: few enough to broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = max(HOT_ROWS, total // HOT_KEYS)
    return counts.filter(F.col("n") > many).select(F.col(key).alias("hot_key"), F.expr(f"int(least(n div {many} + 1, 1 << 20))").alias("pieces"))


def dealt(rows: DataFrame, key: str, hot: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``piece``: which of its key's pieces a row belongs to, by a hash of ``by``; null keys, which meet
    nothing, are dealt to all tasks."""
    few = F.broadcast(hot)
    pieces = F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(F.coalesce("pieces", F.lit(1)))
    return rows.join(few, F.col(key) == F.col("hot_key"), "left").withColumn("piece", F.pmod(F.xxhash64(*by), pieces).cast("int")).drop("hot_key", "pieces")


def copied(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """A copy of each row for every ``piece`` of its key, to be joined with ``dealt`` rows on the key and the piece."""
    few = F.broadcast(hot)
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1))
    return rows.join(few, F.col(key) == F.col("hot_key"), "left").withColumn("piece", pieces).drop("hot_key", "pieces")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python tasks in Arrow batches of fewer rows than the default, for this session; a
    smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U64(33))
        x = x * _U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U64(33))
        x = x * _U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U64(33))


class Rolling:
    """Polynomial hashes of any slices of a sequence, by prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                steps = np.full(n - 1, self.BASE, _U64)
                self.up = np.concatenate([np.ones(1, _U64), np.multiply.accumulate(steps)])
                steps[:] = self.INVERSE
                self.down = np.concatenate([np.ones(1, _U64), np.multiply.accumulate(steps)])

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of ``values[s:e]`` for each pair; equal slices have equal hashes wherever they stand."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, _U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.up[: len(values)], out=total[1:])
            return (total[ends] - total[starts]) * self.down[starts]


_BYTE_CODES = mix64(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


def word_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


class Words:
    """Words of many texts as positions in one byte buffer.

    ``starts``/``ends``: byte span of each word; ``first[i]:first[i+1]``: the words of text i.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray) -> None:
        self.buffer = b"\n".join(texts) + b"\n"  # a line feed is a word byte in no table
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = table[raw]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.concatenate([[0], np.searchsorted(self.starts, np.cumsum(sizes))]).astype(np.int64)

    def hashes(self, rolling: Rolling) -> np.ndarray:
        raw = np.frombuffer(self.buffer, np.uint8)
        h = rolling.slices(_BYTE_CODES[raw], self.starts, self.ends)
        return mix64(h ^ (self.ends - self.starts).astype(_U64))


def in_pieces(texts: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about ``limit`` bytes, or of one longer text."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)
