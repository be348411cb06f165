"""Benchmark decontamination by winnowing.

Of each 6 consecutive hashes of 5 words the smallest is kept as a fingerprint, so any 10
words in a row that a document shares with an item leave a fingerprint in both.  Document
and item fingerprints are joined, and each hit is extended as far as the words agree; a
stretch of 10 words or more is contaminated.  Items of fewer than 10 words are one window
each and are looked up by the hash of all their words.

The item side is broadcast while its words stay below a bound; beyond it, document
fingerprints and item fingerprints meet in a shuffle join, in which common fingerprints are
dealt to several tasks, and only candidate items travel to a document, ``AT_ONCE`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Rolling, Words, ascii_lower, copied, dealt, hot_keys, in_pieces, materialise, mix64, small_batches, text_bytes, word_table

#: Regular expression of a word: digits, lower-case letters and everything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

#: Candidate items that travel to a document together.
AT_ONCE = 64

_U64 = np.uint64
_RESULT = "row_id bigint, n_words bigint, begins array<bigint>, ends array<bigint>, items array<string>"


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, _U64)
    out = np.full(len(words) - n + 1, n, _U64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _U64(Rolling.BASE) + words[j : len(words) - n + 1 + j]
    return mix64(out)


def winnow(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of one text with at least ``window`` words: of all grams that
    start in a window, the smallest, and of equal ones the last."""
    grams = gram_hashes(words, gram)
    width = window - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], width)
    at = np.unique(len(grams) - 1 - (np.arange(len(views)) + views.argmin(1)))
    return at, grams[at]


class Items:
    """Benchmark items as word hashes, with an index of their fingerprints."""

    def __init__(self, names: list[str | None], texts: list[bytes], window: int, gram: int) -> None:
        self.window, self.gram, self.rolling = window, gram, Rolling()
        words = Words([t.lower() for t in texts], _TABLE)
        hashes = words.hashes(self.rolling)
        rows = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        keep = [i for i, r in enumerate(rows) if len(r)]
        self.names, self.words = [names[i] for i in keep], [rows[i] for i in keep]
        prints = [(h, i, p) for i, w in enumerate(self.words) if len(w) >= window for p, h in zip(*map(np.ndarray.tolist, winnow(w, window, gram)), strict=True)]
        prints.sort()
        self.hashes = np.array([x[0] for x in prints], _U64)
        self.item = np.array([x[1] for x in prints], np.int64)
        self.at = np.array([x[2] for x in prints], np.int64)
        #: by length: {hash of all words: items}
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if len(w) < window:
                self.short.setdefault(len(w), {}).setdefault(int(gram_hashes(w, len(w))[0]), []).append(i)

    def find(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """The contaminated stretches of one document's words (they may overlap), and the items in it."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(self.hashes):
            at, prints = winnow(words, self.window, self.gram)
            low, high = np.searchsorted(self.hashes, prints, "left"), np.searchsorted(self.hashes, prints, "right")
            done: dict[tuple[int, int], int] = {}  # by item and diagonal, where its last stretch ends
            for x in np.flatnonzero(high > low).tolist():
                p = int(at[x])
                for y in range(low[x], high[x]):
                    i, q = int(self.item[y]), int(self.at[y])
                    if done.get((i, p - q), -1) > p:
                        continue
                    own = self.words[i]
                    back, ahead = min(p, q), min(len(words) - p, len(own) - q)
                    differs = np.flatnonzero(words[p : p + ahead] != own[q : q + ahead])
                    end = p + (int(differs[0]) if len(differs) else ahead)
                    differs = np.flatnonzero(words[p - back : p] != own[q - back : q])
                    begin = p - back + (int(differs[-1]) + 1 if len(differs) else 0)
                    done[i, p - q] = end
                    if end - begin >= self.window:
                        found.append((begin, end))
                        items.add(i)
        for n, of in self.short.items():
            hashes = gram_hashes(words, n)
            for p in np.flatnonzero(np.isin(hashes, np.fromiter(of, _U64, len(of)))).tolist():
                found.append((p, p + n))
                items.update(of[int(hashes[p])])
        return found, items


def document_words(texts: list[bytes], rolling: Rolling) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    for a, b in in_pieces(texts):
        words = Words([t.lower() for t in texts[a:b]], _TABLE)
        hashes = words.hashes(rolling)
        for x, y in zip(words.first[:-1], words.first[1:], strict=True):
            yield hashes[x:y]


def _merged(found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    begins: list[int] = []
    ends: list[int] = []
    for a, z in sorted(found):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            begins.append(a)
            ends.append(z)
    return begins, ends


def _texts(batch: pa.RecordBatch, text_col: str | None) -> list[bytes]:
    """The texts of a batch, of the column itself or in a row that is carried along."""
    return text_bytes(batch.column("row").field(text_col) if text_col else batch.column("text"))


def _result(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    types = {"row_id": pa.int64(), "n_words": pa.int64(), "begins": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    carried = ["row"] if "row" in batch.schema.names else []
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)), *map(batch.column, carried)], names=[*types, *carried])


def _scan(shared, text_col: str | None):
    """All of a document's work in one pass, the item side being at hand."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in batches:
            rows = []
            for d, words in zip(batch.column("row_id").to_pylist(), document_words(_texts(batch, text_col), items.rolling), strict=True):
                found, which = items.find(words)
                rows.append((d, len(words), *_merged(found), sorted({items.names[i] for i in which} - {None})))
            yield _result(rows, batch)

    return task


def _prints(window: int, gram: int, lengths: list[int], whole: bool):
    """The distinct fingerprints of each text: (key, length of what is hashed, hash).  Of an item (``whole``),
    those of a short item are the hash of all its words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for k, words in zip(batch.column("key").to_pylist(), document_words(text_bytes(batch.column("text")), rolling), strict=True):
                found = {(0, h) for h in winnow(words, window, gram)[1].tolist()}
                for n in lengths:
                    if not whole or (n == len(words)):
                        found |= {(n, h) for h in gram_hashes(words, n).tolist()}
                keys += [k] * len(found)
                sizes += [x for x, _ in found]
                hashes += [h for _, h in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(sizes, pa.int32()), pa.array(np.array(hashes, _U64).view(np.int64))], names=["key", "size", "hash"])

    return task


def _extend(window: int, gram: int, text_col: str | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            rows = []
            for d, words, own in zip(batch.column("row_id").to_pylist(), document_words(_texts(batch, text_col), rolling), batch.column("items"), strict=True):
                near = own.as_py() or []
                items = Items([x["name"] for x in near], [(x["text"] or "").encode() for x in near], window, gram)
                found, which = items.find(words) if near else ([], set())
                rows.append((d, len(words), *_merged(found), sorted({items.names[i] for i in which} - {None})))
            yield _result(rows, batch)

    return task


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, most_broadcast: int = 64 << 20, carry: bool = False) -> DataFrame:
    """Words of documents inside any occurrence of a window of a benchmark item.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Returns one row per
    document: the id column, ``n_words``, ``n_hit``, ``begins`` and ``ends`` (the hit word ranges) and ``items``
    (the ids, as strings and sorted, of the items with windows in it).  A-Z is lower-cased.

    ``carry``: all columns of the document come too, as a struct ``row``.

    ``most_broadcast``: UTF-8 bytes of item texts up to which they are sent to all tasks.

    Defined cases: a null or empty text has no words and no hits; an item without words has no window; items
    with equal texts are all reported; a null item id is not reported, though its windows are hit; equal
    document ids are separate documents; empty tables are fine; other columns are not read.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("text")).filter("text is not null")
    size = named.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else [F.col(text_col).alias("text")]))
    inside = text_col if carry else None
    if size <= most_broadcast:
        items = named.collect()
        shared = spark.sparkContext.broadcast(([x["name"] for x in items], [x["text"].encode() for x in items], window, gram))
        found = rows.mapInArrow(_scan(shared, inside), _with_row(rows))
    else:
        found = _by_join(rows, named, window, gram, inside)
    hit = F.aggregate(F.zip_with("begins", "ends", lambda a, z: z - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select(F.col("row_id").alias(id_col), "n_words", hit.alias("n_hit"), "begins", "ends", "items", *(["row"] if carry else []))


def _with_row(rows: DataFrame) -> StructType:
    """The result's columns, and the carried row's."""
    return StructType([*StructType.fromDDL(_RESULT).fields, *(f for f in rows.schema.fields if f.name == "row")])


def _by_join(rows: DataFrame, named: DataFrame, window: int, gram: int, inside: str | None) -> DataFrame:
    """The same with fingerprints joined by shuffle; a document is known by its id and its text's hash."""
    text = F.col(f"row.`{inside}`") if inside else F.col("text")
    hashed = rows.withColumn("key", F.xxhash64("row_id", text)).withColumn("n_words", F.coalesce(F.regexp_count(ascii_lower(text), F.lit(ITEM_WORD)), F.lit(0)).cast("bigint"))
    items = materialise(named.select("name", "text", F.xxhash64(F.col("name").isNull(), "name", "text").alias("key"), F.regexp_count(ascii_lower(F.col("text")), F.lit(ITEM_WORD)).alias("words")).distinct(), "decontamination-items")
    lengths = sorted(x["words"] for x in items.filter(F.col("words").between(1, window - 1)).select("words").distinct().collect())  # below the window
    # of documents with the same id and text one is enough
    texts = hashed.select("key", text.alias("text")).filter("text is not null").groupBy("key").agg(F.any_value("text").alias("text"))
    texts = materialise(texts, "decontamination-texts")
    schema = "key bigint, size int, hash bigint"
    of_docs = texts.mapInArrow(_prints(window, gram, lengths, False), schema).select(F.col("key").alias("doc"), F.xxhash64("size", "hash").alias("print"))
    of_items = materialise(items.select("key", "text").mapInArrow(_prints(window, gram, lengths, True), schema).select(F.col("key").alias("item"), F.xxhash64("size", "hash").alias("print")), "decontamination-items")
    of_docs = materialise(of_docs.join(of_items.select("print").distinct(), "print", "left_semi"), "decontamination-prints")
    hot = materialise(hot_keys(of_docs.groupBy("print").agg(F.count("*").alias("n")), "print"), "decontamination-hot")
    pairs = dealt(of_docs, "print", hot, ["doc"]).join(copied(of_items, "print", hot), ["print", "piece"]).select("doc", "item").distinct()
    pairs = materialise(pairs, "decontamination-candidates")
    # an item may be near very many documents, and a document near very many items
    hot = materialise(hot_keys(pairs.groupBy("item").agg(F.count("*").alias("n")), "item"), "decontamination-hot")
    own = items.select(F.col("key").alias("item"), F.struct("name", "text").alias("of"))
    sizes = pairs.groupBy("doc").agg(F.expr(f"int((count(*) - 1) div {AT_ONCE} + 1)").alias("groups"))
    near = dealt(pairs, "item", hot, ["doc"]).join(copied(own, "item", hot), ["item", "piece"]).join(sizes, "doc")
    near = near.groupBy("doc", F.pmod(F.xxhash64("item"), F.col("groups")).alias("group")).agg(F.collect_list("of").alias("items"))
    tried = near.join(texts.withColumnRenamed("key", "doc"), "doc").select(F.col("doc").alias("row_id"), "text", "items").mapInArrow(_extend(window, gram, None), _RESULT)
    ranges = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))))
    found = tried.groupBy(F.col("row_id").alias("f_key")).agg(ranges.alias("ranges"), F.array_distinct(F.sort_array(F.flatten(F.collect_list("items")))).alias("items"))
    # sorted ranges, those that touch made one
    merge = lambda done, r: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["ends"] >= r["begins"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["begins"].alias("begins"), F.greatest(F.try_element_at(done, F.lit(-1))["ends"], r["ends"]).alias("ends"))))).otherwise(F.concat(done, F.array(r)))
    found = found.withColumn("ranges", F.aggregate("ranges", F.array().cast("array<struct<begins:bigint,ends:bigint>>"), merge))
    joined = hashed.join(found, F.col("key") == F.col("f_key"), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return joined.select("row_id", "n_words", none(F.col("ranges.begins"), "bigint").alias("begins"), none(F.col("ranges.ends"), "bigint").alias("ends"), none(F.col("items"), "string").alias("items"), *(["row"] if inside else []))
