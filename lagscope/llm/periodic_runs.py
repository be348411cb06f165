"""Periodic runs of words, by bit-parallel lags.

The word ids of a text are bit planes, big integers with a bit for each word.  A plane XOR itself
shifted by q places has a bit wherever words q apart differ in it; OR over all planes leaves zeros
where they agree.  ANDs of the agreement with itself, shifted twice as far each time, leave bits only
where a sufficiently long stretch of agreement begins.

A stretch of agreement of 3q words holds three aligned blocks of q words that are equal, so lags
without such blocks are passed over: their planes could show nothing.  Blocks are compared by rolling
hashes, for all lags at once; what they propose, the planes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, in_pieces, mix64, small_batches, text_bytes, word_table

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of blocks that are compared at a time.
BLOCKS = 1 << 20

_WORDS = word_table(lambda b: b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit planes of word ids: bit i of plane k is bit k of the i-th id."""
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(int(ids.max()).bit_length())]


def stretches(planes: list[int], n: int, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches [a, b) of ``least`` places or more whose words are those ``lag`` places on."""
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    begins = ~differ & ((1 << (n - lag)) - 1)
    have = 1
    while have < least and begins:
        step = min(have, least - have)
        begins &= begins >> step
        have += step
    if begins:
        bits = np.unpackbits(np.frombuffer(begins.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
        edges = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            yield a, b + least - 1


def _proposed(hashes: np.ndarray, rolling: Rolling) -> Iterator[tuple[int, np.ndarray]]:
    """Lags with three equal aligned blocks in a row, and where these begin."""
    n = len(hashes)
    low, last = 1, n // LEAST_PERIODS
    while low <= last:
        # lags low to high - 1 have some n / lag blocks each
        high = low + 1
        total = n // low
        while high <= last and total + n // high <= BLOCKS:
            total += n // high
            high += 1
        lags = np.arange(low, high)
        counts = n // lags
        lag = np.repeat(lags, counts)
        block = np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)
        digest = rolling.slices(hashes, block * lag, (block + 1) * lag)
        alike = np.zeros(len(lag), bool)
        alike[:-2] = (digest[:-2] == digest[1:-1]) & (digest[1:-1] == digest[2:]) & (lag[:-2] == lag[2:])
        here = np.flatnonzero(alike)
        cuts = np.flatnonzero(np.diff(lag[here])) + 1
        for part in np.split(here, cuts):
            if len(part):
                yield int(lag[part[0]]), block[part] * lag[part[0]]
        low = high


def find_runs(ids: np.ndarray, rolling: Rolling) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word ids, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    planes: list[int] = []
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by period: starts and ends, both rising
    out, seen = [], set()
    for q, begins in _proposed(mix64((ids + 1).astype(np.uint64)), rolling):
        # inside a run whose period divides q, agreement at q is that run again: it has that period throughout
        for d, (starts, ends) in found.items():
            if q % d == 0:
                at = np.searchsorted(starts, begins, "right") - 1
                begins = begins[(at < 0) | (ends[at] < begins + 3 * q)]
        if not len(begins):
            continue
        planes = planes or planes_of(ids)
        own = []
        for a, b in stretches(planes, n, q, max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)):
            if (a, b + q) not in seen:  # else it has a smaller period
                seen.add((a, b + q))
                own.append((a, b + q))
        if own:
            found[q] = np.array([a for a, _ in own]), np.array([b for _, b in own])
            out += [(a, b - a, q) for a, b in own]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _runs_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling()
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for a, b in in_pieces(texts):
            words = Words(texts[a:b], _WORDS)
            counts, runs, collapsed = [], [], []
            for i in range(b - a):
                first, last = words.first[i], words.first[i + 1]
                own = [words.buffer[s:e] for s, e in zip(words.starts[first:last].tolist(), words.ends[first:last].tolist(), strict=True)]
                known: dict[bytes, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own))
                found = find_runs(ids, rolling)
                kept = np.ones(len(own), bool)
                for start, length, period in found:
                    kept[start + period : start + length] = False
                counts.append(len(own))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                collapsed.append(b" ".join(own if kept.all() else [own[j] for j in np.flatnonzero(kept)]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            text = pa.array(collapsed, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(runs, kind), text], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of each text: maximal stretches of words with a smallest period q, of 4q words and six at least.

    Returns the id column, ``n_words``, ``runs`` (start, length and period of each, by start, then period) and
    ``collapsed`` (the words, joined by one space, without those that a run holds after its first period).  Texts
    are searched where they are; nothing is shuffled.

    Defined cases: a null or empty text has no words and no run; a very long text is searched whole; repeated rows
    and ids are separate rows, null ids too; runs that overlap all count, and a word goes if any of them drops it;
    an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_runs_of_texts, f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("id", id_col)
