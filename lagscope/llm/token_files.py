"""Token ids of documents in word-aligned binary blocks (Simple-8b), written and read as a table.

Format.  A block holds the ids of whole documents, in order of the document id:

* ``words``: little-endian 64-bit words.  The top four bits are a selector, an index into ``PER_WORD``;
  the rest holds that many ids of 60 // n bits each, the first in the lowest bits.
* An id of ``ESCAPE`` or more is packed as ``ESCAPE``; its value is next in ``escapes`` (32-bit).
* ``doc_ids``, ``lengths``: the documents and their ids' number; ``start``: ids before the block in its
  part; ``n_ids``: ids of the block.  ``part``, ``block``: place of the block; parts are in order.

A block needs nothing outside itself to be decoded, and decoding handles all words of a selector at once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, text_bytes

#: Ids in one word, by selector.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in PER_WORD)
ESCAPE = (1 << 15) - 1
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Bytes of texts after which they are encoded: the more, the fewer distinct pieces are looked up again.
TEXT_BYTES = 1 << 22

BLOCKS = "part int, block int, start bigint, n_ids bigint, words binary, escapes binary, doc_ids array<bigint>, lengths array<bigint>"

_U64 = np.uint64


def _widened(greatest: np.ndarray, over: int, n: int) -> tuple[np.ndarray, int]:
    """From the greatest of every ``over`` neighbours those of every ``n``."""
    while over < n:
        step = min(over, n - over)
        greatest, over = np.maximum(greatest[:-step], greatest[step:]), over + step
    return greatest, over


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """The packed words and the escapes of 32-bit ids; each word takes as many ids as fit."""
    big = ids >= ESCAPE
    escapes = ids[big].astype("<u4").tobytes()
    small = np.where(big, ESCAPE, ids).astype(np.uint16)
    n = len(small)
    if not n:
        return b"", escapes
    # the selector at each position, were a word to begin there: the most ids, the greatest of which fits
    best = np.full(n, PER_WORD.index(1), np.uint8)
    greatest, over = small, 1  # of so many ids from each position on
    for s in range(len(PER_WORD) - 2, -1, -1):
        if PER_WORD[s] > n:
            break
        greatest, over = _widened(greatest, over, PER_WORD[s])
        best[: len(greatest)][greatest < 1 << WIDTHS[s]] = s
    values = small.astype(_U64)
    steps = np.array(PER_WORD, np.uint8)[best].tobytes()
    heads, i = [], 0
    head = heads.append
    while i < n:
        head(i)
        i += steps[i]
    heads = np.array(heads)
    selectors = best[heads]
    words = selectors.astype(_U64) << _U64(60)
    for s in np.unique(selectors).tolist():
        here = np.flatnonzero(selectors == s)
        at = heads[here]
        packed = values.take(at)
        for j in range(1, PER_WORD[s]):
            at += 1
            packed |= values.take(at) << _U64(j * WIDTHS[s])
        words[here] |= packed
    return words.astype("<u8").tobytes(), escapes


def decode_ids(words: bytes, escapes: bytes) -> np.ndarray:
    """The ids that ``encode_ids`` packed, as unsigned 32-bit integers."""
    packed = np.frombuffer(words, "<u8")
    selectors = (packed >> _U64(60)).astype(np.intp)
    counts = np.array(PER_WORD)[selectors]
    begins = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint32)
    for s in np.unique(selectors).tolist():
        here = np.flatnonzero(selectors == s)
        mask = _U64((1 << WIDTHS[s]) - 1)
        for j in range(PER_WORD[s]):
            out[begins[here] + j] = (packed[here] >> _U64(j * WIDTHS[s])) & mask
    out[out == ESCAPE] = np.frombuffer(escapes, "<u4")
    return out


#: A run of letters that no other letter class touches: ASCII, and Latin-1 letters as UTF-8.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: What a byte is, as bits, and the byte that stands between texts, which UTF-8 has nowhere.
_MARK, _ASCII, _C3, _AFTER_C3, _GAP, _STOP = 1, 2, 4, 8, 16, 32
_BETWEEN = b"\xff"


def _byte_classes() -> bytes:
    bits = np.zeros(256, np.uint8)
    bits[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = _MARK  # ASCII punctuation, without what special tokens and contractions hold
    bits[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _ASCII
    bits[0xC3] = _C3
    bits[0x80:0xC0] = _AFTER_C3
    bits[[0x97, 0xB7]] = 0
    bits[list(b" \t\n\v\f\r")] = _GAP
    bits[list(_BETWEEN)] = _STOP
    return bits.tobytes()


_CLASSES = _byte_classes()


def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte; the blank stays."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)} | {32: 32}


_BYTE_LETTERS = _byte_letters()


#: How a vocabulary must treat text for its pieces to be encoded one by one.
_BY_PIECES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def splits_at_pieces(form: dict) -> bool:
    """Whether a vocabulary's file says that its ids of a text are those of the text's pieces."""
    special = all(x["special"] and x["content"].startswith("<|") for x in form.get("added_tokens") or [])
    return special and all(form.get(k) == v for k, v in _BY_PIECES.items()) and form["model"].get("end_of_word_suffix") == "</w>" and form["model"].get("dropout") is None


class Encoder:
    """Ids of texts.  A vocabulary of any form is asked for each text; one of the form ``_BY_PIECES`` splits at
    white space and between letters and punctuation, and ends every split with an end-of-word id.

    A text's ids are then those of its pieces between such places, one after another, and each distinct piece
    is encoded once while it is remembered.  Pieces of letters are one split each, so many are encoded as one
    text, which is lower-cased and written as byte-level letters before, and told apart by the end-of-word ids.
    """

    #: Pieces at most that are remembered.
    REMEMBERED = 400_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.by_pieces = splits_at_pieces(form)
        if self.by_pieces:
            self.of_letters = Tokenizer(self.tokenizer.model)  # without the steps that letters pass unchanged
            self.of_letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = form["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.memory: dict[bytes, int] = {_BETWEEN: -1}
        self.pool, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        letters: list[bytes] = []
        rest: list[bytes] = []
        for x in pieces:
            (letters if x.isalpha() or _LETTERS.fullmatch(x) else rest).append(x)
        joined = [b" ".join(letters[i : i + 1000]).decode().lower().encode().decode("latin-1").translate(_BYTE_LETTERS) for i in range(0, len(letters), 1000)]
        own = [e.ids for e in self.of_letters.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.array([i for x in own for i in x], np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        assert len(stops) == len(letters)
        sizes = np.diff(stops, prepend=0)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)]
        sizes = np.concatenate([sizes, np.array([len(x) for x in others], np.int64)])
        ids = np.concatenate([ids, np.array([i for x in others for i in x], np.uint32)])
        self.memory.update(zip(letters + rest, range(len(self.lengths), len(self.lengths) + len(pieces)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.pool) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and the number of ids of each text."""
        if not self.by_pieces:
            own = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64)
        buffer = b"".join([t + _BETWEEN for t in texts])
        if b"<|" not in buffer:  # special tokens are known by their case
            buffer = buffer.lower()
        raw = np.frombuffer(buffer, np.uint8)
        bits = np.frombuffer(buffer.translate(_CLASSES), np.uint8)
        lead, after = bits[:-1], bits[1:]
        pair = (lead & _C3) & ((after & _AFTER_C3) >> 1)  # where a Latin-1 letter begins, of two bytes
        letter = bits & _ASCII
        first = letter.copy()  # first bytes of letters
        first[:-1] |= pair
        letter[1:] |= pair
        cut = np.zeros(len(raw) + 1, bool)  # a piece begins here
        cut[1:-1] = ((letter[:-1] != 0) & (after & _MARK != 0)) | ((lead & _MARK != 0) & (first[1:] != 0)) | (after & _STOP != 0) | (lead & (_STOP | _GAP) != 0)
        cut[0] = True
        full = bits & _GAP == 0
        kept = raw[full]
        offsets = np.append(np.flatnonzero(cut[:-1][full]), len(kept)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        flat = pieces.dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [x for x in distinct if x not in self.memory]
        if len(self.memory) + len(new) > self.REMEMBERED:
            self._forget()
            new = [x for x in distinct if x not in self.memory]
        self._learn(new)
        at = np.fromiter(map(self.memory.__getitem__, distinct), np.int64, len(distinct))
        pool = np.append(self.pool, np.uint32(end_id))
        begins = np.append(self.begins, len(pool) - 1)[at].astype(np.int32)
        lengths = np.append(self.lengths, 1)[at].astype(np.int32)
        codes = flat.indices.to_numpy()
        sizes = lengths.take(codes)
        total = np.cumsum(sizes, dtype=np.int64)
        where = np.repeat((begins.take(codes) - total + sizes).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return pool.take(where), np.diff(total[kept[offsets[:-1]] == _BETWEEN[0]], prepend=0)


def _blocks(path: str, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder(path)
        start = block = 0
        docs: list[int | None] = []
        texts: list[bytes] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal start, block
            ids, lengths = encoder.encode(texts, end_id)
            ends = np.cumsum(lengths)
            a = 0
            while a < len(lengths):
                base = int(ends[a] - lengths[a])
                b = max(a + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                n = int(ends[b - 1]) - base
                words, escapes = encode_ids(ids[base : base + n])
                row = {"part": part, "block": block, "start": start, "n_ids": n, "words": words, "escapes": escapes, "doc_ids": docs[a:b], "lengths": lengths[a:b].tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)
                start, block, a = start + n, block + 1, b
            docs.clear()
            texts.clear()

        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                for d, t in zip(rows.column("id").to_pylist(), text_bytes(rows.column("text")), strict=True):
                    docs.append(d)
                    texts.append(t)
                    held += len(t)
                    if held > TEXT_BYTES:
                        yield from close()
                        held = 0
        if docs:
            yield from close()

    return task


_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("escapes", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encode every whole text and write blocks in ascending order of the id to ``path``.

    Defined cases: a null or empty text has the end id alone; null ids come first; equal ids stand together,
    ordered by their texts' hashes; a text longer than a block makes a long block; an empty table writes no
    block; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    ordered.mapInArrow(_blocks(tokenizer, end_id), BLOCKS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``first``: the ids of all documents before the block."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    return blocks.join(F.broadcast(parts), "part").withColumn("first", F.col("before") + F.col("start")).drop("before")  # one row a file


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row["words"], row["escapes"]).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["first"]), pa.array(lengths), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def token_index(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from its decoded ids: the id, ``start``, ``n_tokens`` and ``ids_crc32``."""
    out = blocks.select("words", "escapes", "doc_ids", "lengths", "first").mapInArrow(_documents, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("id", id_col)
