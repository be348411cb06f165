"""Exact substring deduplication by super-k-mer partitioning.

A *window* is ``window`` consecutive words of one document.  Consecutive windows that
share a minimiser (the smallest hash among their runs of ``minimizer`` words) travel as
one packed string, a super-k-mer, to the bucket of that minimiser.  Equal windows have
equal minimisers, so a bucket sees every occurrence of its windows; sorting the windows
of a bucket counts them exactly (hashes order them, word codes confirm equality).

A line that very many documents hold would draw all windows around it, unlike as they are, to
the bucket of its minimiser.  So the bytes that each minimiser would draw are counted first,
in slots over the whole input, and runs of words in a heavy slot come last in the order:
a window takes one of them only if it has no other, and then all its copies are alike.

Scale: a task sends each distinct super-k-mer once, with weight 2 if it met it twice (its
windows are then known to repeat and need no answer), so a passage that a third of all
documents share reaches its bucket once per map task, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, mix64, shuffle_width, small_batches, text_bytes

_U64 = np.uint64
#: Windows of one super-k-mer at most, so that a text of one repeated word makes no endless string.
LONGEST = 256
#: Text bytes that a map task packs before it sends its blobs.
FLUSH = 48 << 20
#: Text bytes that a bucket should hold.
BUCKET_BYTES = 12 << 20
#: Slots in which the bytes of minimisers are counted, in blocks of so many.
SLOTS, BLOCK = 1 << 22, 1 << 16

_BLOB = pa.schema([("bucket", pa.int32()), ("strings", pa.binary()), ("facts", pa.binary())])
_RANGE = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
#: What is known of a packed string: where it stands, its windows, and 1 or 2 as it was met once or more.
_FACT = np.dtype([("doc", "<i8"), ("null_doc", "u1"), ("text_hash", "<i8"), ("begin", "<i8"), ("windows", "<i4"), ("weight", "u1")])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class _Cutter:
    """Cuts the words of many texts at once into super-k-mers; ``heavy``: a bitmap of the slots that come last."""

    def __init__(self, window: int, minimizer: int, heavy: np.ndarray | None = None) -> None:
        self.window, self.minimizer, self.heavy, self.rolling = window, minimizer, heavy, Rolling()

    def runs(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that are words joined by one space, none empty: their bytes; where words start and end; by
        window, its text and least run; by text, its first word; by super-k-mer, its first window and the one after
        its last."""
        k, m = self.window, self.minimizer
        buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(buffer, np.uint8)
        ends = np.flatnonzero((raw == 32) | (raw == 10))
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = np.flatnonzero(raw[ends] == 10)
        first = np.concatenate([[0], last[:-1] + 1])
        if len(ends) < k:
            none = np.zeros(0, np.int64)
            return buffer, starts, ends, none, none.astype(_U64), first, none, none
        words = mix64(self.rolling.slices(mix64(raw.astype(_U64) + _U64(1)), starts, ends))
        grams = np.zeros(len(words) - m + 1, _U64)
        with np.errstate(over="ignore"):
            for j in range(m):
                grams = grams * _U64(Rolling.BASE) + words[j : len(words) - m + 1 + j]
        grams = mix64(grams)
        order = grams >> _U64(1)
        if self.heavy is not None:
            slot = order % _U64(SLOTS)
            order |= (self.heavy[(slot >> _U64(3)).astype(np.intp)] >> (slot & _U64(7)).astype(np.uint8) & 1).astype(_U64) << _U64(63)
        least = _sliding_min(order, k - m + 1)
        of = np.repeat(np.arange(len(texts)), last - first + 1)
        inside = of[: len(least)] == of[k - 1 :]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        begin = np.flatnonzero(new)
        stop = np.flatnonzero(np.concatenate([inside, [False]])[:-1] & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
        return buffer, starts, ends, of, least, first, begin, stop

    def cut(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(text, first word, windows, minimiser, string)."""
        buffer, starts, ends, of, least, first, begin, stop = self.runs(texts)
        for b, e in zip(begin.tolist(), stop.tolist(), strict=True):
            for a in range(b, e, LONGEST):
                z = min(e, a + LONGEST)
                t = of[a]
                yield t, a - first[t], z - a, int(least[a]), buffer[starts[a] : ends[z + self.window - 2]]


def _drawn_bytes(window: int, minimizer: int):
    """Bytes that the minimisers of each slot draw, over all texts of a task, in blocks of slots."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, packer = _Cutter(window, minimizer), zstandard.ZstdCompressor(level=1)
        drawn = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = [b" ".join(t.split()) for t in text_bytes(batch.column("text"))]
            for rows in _groups(texts, window):
                _, starts, ends, _, least, _, begin, stop = cutter.runs([texts[i] for i in rows])
                if len(begin):
                    np.add.at(drawn, (least[begin] % _U64(SLOTS)).astype(np.intp), ends[stop + window - 2] - starts[begin])
        for i in range(SLOTS // BLOCK):
            own = drawn[i * BLOCK : (i + 1) * BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packer.compress(own.tobytes())], pa.binary())], names=["block", "drawn"])

    return task


def _heavy_slots(most: int):
    """A bitmap of each block's slots that draw more than ``most`` bytes in all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, drawn in zip(batch.column("block").to_pylist(), batch.column("drawn").to_pylist(), strict=True):
                sums.setdefault(i, np.zeros(BLOCK, np.int64))
                sums[i] += np.frombuffer(opener.decompress(drawn), np.int64)
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(own > most, bitorder="little").tobytes()], pa.binary())], names=["block", "heavy"])

    return task


def heavy_slots(source: DataFrame, window: int, minimizer: int, most: int) -> np.ndarray:
    """The bitmap, of ``SLOTS`` bits, of slots whose minimisers draw more than ``most`` bytes of ``source``."""
    drawn = source.select("text").mapInArrow(_drawn_bytes(window, minimizer), "block int, drawn binary")
    found = drawn.repartition(min(shuffle_width(source.sparkSession), SLOTS // BLOCK), "block").mapInArrow(_heavy_slots(most), "block int, heavy binary")
    heavy = np.zeros(SLOTS // 8, np.uint8)
    for x in found.collect():  # half a megabyte in all
        heavy[x["block"] * BLOCK // 8 : (x["block"] + 1) * BLOCK // 8] = np.frombuffer(x["heavy"], np.uint8)
    return heavy


def _pack(window: int, minimizer: int, buckets: int, heavy):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(window, minimizer, heavy.value)
        packer = zstandard.ZstdCompressor(level=1)
        seen: dict[bytes, list] = {}
        known: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by: dict[int, list[bytes]] = {}
            for string, fact in seen.items():
                by.setdefault(fact[-1], []).append(string)
            rows = []
            for bucket, strings in by.items():
                facts = np.array([tuple(seen[s][:-1]) for s in strings], _FACT)
                rows.append((bucket, packer.compress(b"\n".join(strings)), packer.compress(facts.tobytes())))
            # what is known already passes through buckets chosen by its document and place
            facts = np.array(known, _FACT)
            with np.errstate(over="ignore"):
                spot = facts["text_hash"].astype(_U64) + mix64(facts["doc"].astype(_U64) + mix64(facts["begin"].astype(_U64)))
            place = (mix64(spot) % _U64(buckets)).astype(int)
            for bucket in np.unique(place).tolist():
                rows.append((bucket, b"", packer.compress(facts[place == bucket].tobytes())))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 64], strict=True), _BLOB, strict=True)], schema=_BLOB)
            seen.clear()
            known.clear()

        for batch in batches:
            ids, hashes = batch.column("doc").to_pylist(), batch.column("text_hash").to_pylist()
            texts = [b" ".join(t.split()) for t in text_bytes(batch.column("text"))]
            for rows in _groups(texts, window):
                for t, at, n, least, string in cutter.cut([texts[i] for i in rows]):
                    row = rows[t]
                    fact = [ids[row] or 0, ids[row] is None, hashes[row], at, n, 1, least % buckets]
                    before = seen.setdefault(string, fact)
                    if before is not fact:
                        known.append((*fact[:5], 0))
                        if before[5] == 1:
                            known.append((*before[:5], 0))
                            before[5] = 2
                    else:
                        held += len(string)
                if held + 30 * len(known) > FLUSH:
                    yield from flush()
                    held = 0
        if seen:
            yield from flush()

    return task


def _groups(texts: list[bytes], window: int, limit: int = 1 << 21) -> Iterator[list[int]]:
    """Rows whose texts have a window at all, about ``limit`` bytes at a time."""
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t.count(b" ") + 1 >= window:
            rows.append(i)
            size += len(t)
            if size > limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def repeated_windows(strings: list[bytes], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For each packed string, which of its windows occur twice in all, weights counted."""
    data = b" ".join(strings) + b" "
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 32) + 1
    kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    words = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(width)), pa.py_buffer(data)])
    codes = words.dictionary_encode().indices.to_numpy()
    sizes = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    first = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    of = np.repeat(np.arange(len(strings)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]
    hashes = Rolling().slices(mix64(codes.astype(_U64) + _U64(1)), at, at + window)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    again = np.flatnonzero(same)
    for i in range(0, len(again), 1 << 15):
        x = again[i : i + (1 << 15)]
        a, b = at[order[x]], at[order[x - 1]]
        equal = np.ones(len(x), bool)
        for j in range(window):
            equal &= codes[a + j] == codes[b + j]
        if not equal.all():  # equal hashes of different windows: order all windows by their words themselves
            rows = codes[at[:, None] + np.arange(window)]
            order = np.lexsort(rows.T[::-1])
            same = np.concatenate([[False], (rows[order[1:]] == rows[order[:-1]]).all(1)])
            break
    run = np.cumsum(~same) - 1
    total = np.bincount(run, weights[of[order]])
    repeated = np.empty(len(order), bool)
    repeated[order] = total[run] > 1
    return np.split(repeated, np.cumsum(counts)[:-1])


def _judge(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        strings: list[bytes] = []
        facts = []
        out: list[tuple] = []
        for batch in batches:
            for packed, about in zip(batch.column("strings").to_pylist(), batch.column("facts").to_pylist(), strict=True):
                fact = np.frombuffer(opener.decompress(about), _FACT)
                if packed:
                    strings += opener.decompress(packed).split(b"\n")
                    facts.append(fact)
                else:
                    for f in fact.tolist():
                        out.append((None if f[1] else f[0], f[2], f[3], f[3] + f[4] + window - 1))
                if len(out) > 50_000:
                    yield _ranges(out)
                    out = []
        if strings:
            fact = np.concatenate(facts)
            for f, flags in zip(fact.tolist(), repeated_windows(strings, fact["weight"], window), strict=True):
                if f[5] == 1 and flags.any():
                    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False)).tolist()
                    for a, b in zip(edge[::2], edge[1::2], strict=True):
                        out.append((None if f[1] else f[0], f[2], f[3] + a, f[3] + b + window - 1))
        for i in range(0, len(out), 50_000):
            yield _ranges(out[i : i + 50_000])

    return task


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RANGE, strict=True)], schema=_RANGE)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc")
        texts = text_bytes(batch.column("text"))
        begins, ends = batch.column("begins").to_pylist(), batch.column("ends").to_pylist()
        for i in range(0, len(texts), 512):
            kept, n, gone, spans = [], [], [], []
            for t, b, e in zip(texts[i : i + 512], begins[i : i + 512], ends[i : i + 512], strict=True):
                words = t.split()
                n.append(len(words))
                merged: list[list[int]] = []
                for a, z in sorted(zip(b or (), e or (), strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                gone.append(sum(z - a for a, z in merged))
                spans.append([{"begin": a, "end": z} for a, z in merged])
                for a, z in reversed(merged):
                    del words[a:z]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["doc", "n_words", "n_removed", "kept_text", "removed"],
            )


def remove_repeated_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, minimizer: int = 5, buckets: int | None = None) -> DataFrame:
    """Remove every word that a repeated window covers.

    Returns one row per document: the id column, ``n_words``, ``n_removed``, ``kept_text`` (the words
    left, joined by one space) and ``removed`` (word ranges).  Windows are judged on the input, so all
    copies of a passage go.  Words are separated by ASCII white space and otherwise unchanged.

    Defined cases: a null or empty text has no words and an empty ``kept_text``; a text shorter than
    the window keeps all words; repeated rows are separate documents and repeat one another; a null id
    is an id like any other; an empty table gives an empty result; other columns are not read.
    """
    if not 0 < minimizer <= window:
        raise ValueError("minimizer must be between 1 and window")
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    # a word travels about 1 + (window - 1) / ((window - minimizer + 2) / 2) times
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    drawn = int(size * (1 + 2 * (window - 1) / (window - minimizer + 2)))
    if buckets is None:
        buckets = max(shuffle_width(spark), drawn // BUCKET_BYTES + 1)
    heavy = spark.sparkContext.broadcast(heavy_slots(source, window, minimizer, max(BUCKET_BYTES // 8, 4 * drawn // SLOTS)))
    blobs = source.mapInArrow(_pack(window, minimizer, buckets, heavy), "bucket int, strings binary, facts binary")
    ranges = blobs.repartitionById(buckets, "bucket").mapInArrow(_judge(window), "doc bigint, text_hash bigint, begin bigint, end bigint")
    # rows with one id and text all find the same ranges: a set of them, which map tasks reduce, goes to each row
    found = ranges.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).select(F.col("doc").alias("f_doc"), F.col("text_hash").alias("f_hash"), F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
    joined = source.join(found, F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("text_hash") == F.col("f_hash")), "left")
    out = joined.select("doc", "text", "begins", "ends").mapInArrow(_remove, "doc bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<begin:bigint,end:bigint>>")
    return out.withColumnRenamed("doc", id_col)
