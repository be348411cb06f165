"""Approximate nearest neighbours by an inverted multi-index.

1. Both halves of the unit vectors are quantised apart, by k-means on a bounded sample; a pair of
   centroids is a cell, and every vector is an entry of one cell.  Vectors that are the same are one
   entry, with as many of their rows as an answer can hold.
2. A query meets the pairs of centroids by rising summed distance, with a heap (multi-sequence
   traversal), until the cells met hold ``budget`` entries.
3. Entries are dealt by cell to regions of a bounded size; a cell larger than a region is spread over
   several.  A query goes once to each region that holds a cell it met, with these cells.  There the
   entries of the cells are reranked by cosine in double precision.
4. The budget comes from an audit: sampled queries are compared with all entries, and the budget is the
   least one that reaches ``target_recall`` of their true neighbours.  On vectors without structure this
   is a large share of the table; on clustered ones it is small.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copied, dealt, hot_keys, materialise, shuffle_width

log = logging.getLogger(__name__)

#: Scores by matrix product that differ by less may be ties; they are computed again one by one.
SLACK = 1e-9
#: Bytes of sampled vectors that the driver holds at most, and entries of a region.
SAMPLE_BYTES, LEAST_REGION, MOST_REGION = 32 << 20, 256, 8192
#: Queries that a region compares at a time, and rows that an audit does.
QUERIES, ROWS = 256, 2048
PLACES = 1 << 40

_OUT = "query_cls binary, score double, none boolean, id bigint, rid bigint"


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector has a direction, scaled by a power of two, which leaves every cosine as it is."""
    for batch in batches:
        vectors = batch.column("embedding")
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
        values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        here, vecs = [], []
        for i in np.flatnonzero(sizes):
            v = values[ends[i] - sizes[i] : ends[i]]
            top = np.abs(v).max()
            if np.isfinite(top) and top > 0:
                here.append(i)
                vecs.append((np.ldexp(v, -int(np.frexp(top)[1])) + 0.0).tobytes())
        rows = batch.take(pa.array(here, pa.int64()))
        dims = pa.array(sizes[here], pa.int32())
        yield pa.RecordBatch.from_arrays([rows.column("rid"), rows.column("id"), rows.column("asked"), dims, pa.array(vecs, pa.binary())], names=["rid", "id", "asked", "dim", "vec"])


def _padded(column: pa.Array, widest: int) -> np.ndarray:
    """One row per vector; shorter ones end in zeros."""
    rows = column.to_pylist()
    if all(len(x) == 8 * widest for x in rows):
        return np.frombuffer(b"".join(rows)).reshape(len(rows), widest)
    out = np.zeros((len(rows), widest))
    for i, x in enumerate(rows):
        out[i, : len(x) // 8] = np.frombuffer(x)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T)


def fit_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means from ``k`` drawn rows; a centroid without rows stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _squares(x, centroids).argmin(1)
        n = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, x)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


class MultiIndex:
    """Both codebooks; how many entries each cell has, and where these lie among all entries in order of cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray, widest: int, counts: np.ndarray | None = None) -> None:
        self.first, self.second, self.widest, self.half = first, second, widest, first.shape[1]
        self.counts = np.zeros(len(first) * len(second), np.int64) if counts is None else counts
        self.before = np.cumsum(self.counts) - self.counts

    def parts(self) -> tuple:
        """What it is made from: tasks get plain arrays, as executors may not have this module."""
        return self.first, self.second, self.widest, self.counts

    def count(self, cells: np.ndarray, n: np.ndarray) -> None:
        self.counts[cells] = n
        self.before = np.cumsum(self.counts) - self.counts

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors, to the centroids of either half."""
        return _squares(x[:, : self.half], self.first), _squares(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return one.argmin(1) * len(self.second) + two.argmin(1)

    def traverse(self, one: np.ndarray, two: np.ndarray, budget: int) -> list[int]:
        """The cells with entries, by rising summed distance, until they hold ``budget`` entries."""
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        x, y = one[a].tolist(), two[b].tolist()
        a, b, counts, width = a.tolist(), b.tolist(), self.counts, len(self.second)
        heap, done, found, n = [(x[0] + y[0], 0, 0)], [0] * (len(x) + 1), [], 0
        while heap and n < budget:
            _, i, j = heapq.heappop(heap)
            done[i] = j + 1  # row i has been met up to j
            cell = a[i] * width + b[j]
            if size := int(counts[cell]):
                n += size
                found.append(cell)
            # a pair is pushed once both pairs before it have been met
            if j + 1 < len(y) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if i + 1 < len(x) and done[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        return found

    def needed(self, one: np.ndarray, two: np.ndarray, cells: list[int]) -> list[int]:
        """The least budget with which a traversal meets each of ``cells``."""
        summed = (one[:, None] + two).ravel()
        return [int(self.counts[summed < summed[c]].sum()) + 1 for c in cells]


def _celled(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(*shared.value)
        for batch in batches:
            if batch.num_rows:
                x = _padded(batch.column("vec"), index.widest)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(x / _norms(x)[:, None]).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return task


def _to_regions(shared, size: int):
    """Entries: each to a place of its own among those of its cell, and so to a region."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(*shared.value)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            place = index.before[cell] + batch.column("place").to_numpy() % index.counts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place // size)], names=[*batch.schema.names, "region"])

    return task


def _visits(shared, size: int, budget: int):
    """Queries: one row for each region with a cell that the traversal meets, with these cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MultiIndex(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _padded(batch.column("vec"), index.widest)
            one, two = index.distances(x / _norms(x)[:, None])
            take, regions, cells = [], [], []
            for i in range(batch.num_rows):
                met: dict[int, list[int]] = {}
                for cell in index.traverse(one[i], two[i], budget):
                    low = int(index.before[cell])
                    for region in range(low // size, (low + int(index.counts[cell]) - 1) // size + 1):
                        met.setdefault(region, []).append(cell)
                take += [i] * len(met)
                regions += met
                cells += (np.array(c, np.int32).tobytes() for c in met.values())
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(regions, pa.int64()), pa.array(cells, pa.binary())], names=[*batch.schema.names, "region", "cells"])

    return task


def _lists(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of a column of lists: which row each item belongs to, and the items."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), ids.flatten()


class _Region:
    def __init__(self, held: list[pa.RecordBatch], widest: int, most: int) -> None:
        t = pa.Table.from_batches(held).combine_chunks()
        self.widest, self.most = widest, most
        self.vecs, self.dims = _padded(t["vec"].combine_chunks(), widest), t["dim"].to_numpy()
        self.norms = _norms(self.vecs)
        self.cells, self.cell = np.unique(t["cell"].to_numpy(), return_inverse=True)
        self.owner, self.rows = _lists(t["ids"].combine_chunks())
        self.first = np.searchsorted(self.owner, np.arange(t.num_rows + 1))

    def search(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, asked.num_rows, QUERIES):
            part = asked.slice(at, QUERIES)
            q, dims = _padded(part.column("vec"), self.widest), part.column("dim").to_numpy()
            norms = _norms(q)
            met = np.zeros((len(q), len(self.cells)), bool)
            for i, c in enumerate(part.column("cells").to_pylist()):
                met[i, np.searchsorted(self.cells, np.intersect1d(np.frombuffer(c, np.int32), self.cells))] = True
            about = (q / norms[:, None]) @ (self.vecs / self.norms[:, None]).T
            about[~met[:, self.cell] | (dims[:, None] != self.dims)] = -np.inf
            n = min(self.most, about.shape[1])
            least = np.partition(about, -n, axis=1)[:, -n] if n < about.shape[1] else about.min(1)
            i, e = np.nonzero((about >= least[:, None] - SLACK) & (about > -np.inf))
            score = np.einsum("ij,ij->i", q[i], self.vecs[e]) / (norms[i] * self.norms[e])
            # the rows of each entry, and the best of them for each query
            sizes = self.first[e + 1] - self.first[e]
            i, score = np.repeat(i, sizes), np.repeat(score, sizes)
            row = np.repeat(self.first[e], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = self.rows.take(pa.array(row, pa.int64()))
            none, rid = rows.field("none").to_numpy(zero_copy_only=False).astype(bool), rows.field("rid").to_numpy()
            ids = pc.fill_null(rows.field("id"), 0).to_numpy()
            order = np.lexsort((rid, ids, none, -score, i))
            rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            best = order[rank < self.most]
            cls = part.column("cls").take(pa.array(i[best], pa.int64()))
            yield pa.RecordBatch.from_arrays([cls, pa.array(score[best]), pa.array(none[best]), rows.field("id").take(pa.array(best)), pa.array(rid[best])], names=["query_cls", "score", "none", "id", "rid"])


def _rerank(widest: int, most: int):
    """Rows sorted by region, entries first: each query of a region against the entries of its cells there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, region = -1, [], None
        for batch in batches:
            regions, query = batch.column("region").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(regions) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if regions[a] != at:
                    at, held, region = regions[a], [], None
                if not query[a]:
                    held.append(batch.slice(a, b - a))
                elif held or region:
                    if region is None:
                        region, held = _Region(held, widest, most), []
                    yield from region.search(batch.slice(a, b - a))

    return task


def _true_cells(shared, most: int):
    """The nearest entries of each shared query in a partition: their cells and scores."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, classes, dims, q = shared.value
        index = MultiIndex(*parts)
        score = np.full((len(q), 0), -np.inf)
        cell = np.zeros((len(q), 0), np.int32)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            x = _padded(batch.column("vec"), index.widest)
            new = q @ (x / _norms(x)[:, None]).T
            new[dims[:, None] != batch.column("dim").to_numpy()] = -np.inf
            place = {c: i for i, c in enumerate(batch.column("cls").to_pylist())}
            for i, c in enumerate(classes):
                if c in place:
                    new[i, place[c]] = -np.inf
            score = np.concatenate([score, new], axis=1)
            cell = np.concatenate([cell, np.broadcast_to(batch.column("cell").to_numpy(), new.shape)], axis=1)
            if score.shape[1] > most:
                top = np.argpartition(-score, most - 1, axis=1)[:, :most]
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        i, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(score[i, j]), pa.array(cell[i, j])], names=["q", "score", "cell"])

    return task


def _drawn(rows: DataFrame, n: int, of: int, seed: int) -> list:
    """About ``n`` of ``of`` rows, by a hash of their vectors; in the same order in every run."""
    share = min(PLACES, n * PLACES // max(1, of))
    found = rows.filter(F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(PLACES)) < share).select("cls", "dim", "vec").collect()
    return sorted(found, key=lambda r: bytes(r["cls"]))


def _stacked(rows: list, widest: int) -> np.ndarray:
    x = _padded(pa.array([bytes(r["vec"]) for r in rows], pa.binary()), widest)
    return x / _norms(x)[:, None]


def nearest_vectors(vectors: DataFrame, asked: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = 5, target_recall: float = 0.96, sample: int = 20_000, audit: int = 400, most_centroids: int = 1024, least_budget: int = 1000, budget: int | None = None) -> DataFrame:
    """The ``nearest`` rows found for each row of ``vectors`` for which ``asked`` holds, by cosine.

    Returns ``query_id``, ``rank`` (from 1), the id column and ``score``, the cosine in double precision; ties go
    to the smaller id.  The codebooks are fitted on some ``sample`` distinct vectors; all vectors are indexed.
    ``budget``, the number of entries that a query reranks at least, comes from an audit of about ``audit``
    queries against all entries, unless it is given; up to ``least_budget`` entries the search is exact.

    Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, as
    queries and as candidates; vectors of another length are no candidates; repeated ids are separate rows, and a
    row is never its own candidate; a row with a null id is a candidate like others, after them where scores tie;
    with fewer candidates than ``nearest`` all are returned; an empty table, or one without queries, gives an
    empty result; other columns are not read.
    """
    spark, most = vectors.sparkSession, nearest + 1  # one more, for a query's own row
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "asked", "embedding").mapInArrow(_usable, "rid bigint, id bigint, asked boolean, dim int, vec binary")
    rows = materialise(rows.withColumn("cls", F.unhex(F.md5("vec"))), "ann-rows")

    # of rows with one vector, as many of the smallest ids as an answer can hold: the window drops the rest before it shuffles
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("id").asc_nulls_last(), "rid"))
    few = rows.select("cls", "dim", "vec", "id", "rid").withColumn("copy", place).filter(F.col("copy") <= most)
    ids = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))).alias("ids")
    entries = materialise(few.groupBy("cls").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), ids), "ann-entries")
    n, widest = entries.agg(F.count("*"), F.max("dim")).first()
    queries = materialise(rows.filter("asked").groupBy("cls").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec")), "ann-queries")
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")

    widest = max(2, widest)
    drawn = _stacked(_drawn(entries, min(sample, SAMPLE_BYTES // (8 * widest)), n, 1), widest)
    if not len(drawn):  # few rows, of which none was drawn
        drawn = _stacked(entries.select("cls", "dim", "vec").limit(LEAST_REGION).collect(), widest)
    k = min(most_centroids, 1 << max(2, round(np.log2(np.sqrt(n) / 4))))
    half = widest // 2
    index = MultiIndex(fit_centroids(drawn[:, :half], k, 1), fit_centroids(drawn[:, half:], k, 2), widest)
    shared = spark.sparkContext.broadcast(index.parts())  # at most 2 * most_centroids halves
    entries = materialise(entries.mapInArrow(_celled(shared), f"{_fields(entries)}, cell int"), "ann-cells")
    counted = entries.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # a row for each pair of centroids at most
    index.count(counted["cell"].to_numpy(), counted["n"].to_numpy())

    if budget is None:
        budget = max(least_budget, _audited(entries, queries, n_queries, index, audit, nearest, target_recall))
    log.info("%d entries, %d queries, %d x %d cells, budget %d", n, n_queries, len(index.first), len(index.second), budget)

    size = int(min(MOST_REGION, max(LEAST_REGION, n // (4 * shuffle_width(spark)))))
    shared = spark.sparkContext.broadcast(index.parts())
    placed = entries.withColumn("place", F.pmod(F.xxhash64("cls"), F.lit(PLACES))).mapInArrow(_to_regions(shared, size), f"{_fields(entries)}, place bigint, region bigint")
    visits = queries.repartition(shuffle_width(spark)).mapInArrow(_visits(shared, size, budget), f"{_fields(queries)}, region bigint, cells binary")
    both = placed.drop("place").withColumn("query", F.lit(False)).unionByName(visits.withColumn("query", F.lit(True)), allowMissingColumns=True)
    found = both.repartition("region").sortWithinPartitions("region", "query").mapInArrow(_rerank(widest, most), _OUT)

    place = F.row_number().over(Window.partitionBy("query_cls").orderBy(F.col("score").desc(), "none", "id", "rid"))
    best = found.withColumn("place", place).filter(F.col("place") <= most).groupBy("query_cls").agg(F.sort_array(F.collect_list(F.struct("place", "id", "rid", "score"))).alias("best"))
    best = materialise(best.withColumnRenamed("query_cls", "cls"), "ann-best")
    # very many queries may be one vector
    wanted = rows.filter("asked").select("cls", F.col("id").alias("query_id"), F.col("rid").alias("own"))
    hot = materialise(hot_keys(wanted.groupBy("cls").agg(F.count("*").alias("n")), "cls"), "ann-hot")
    answers = dealt(wanted, "cls", hot, ["own"]).join(copied(best, "cls", hot), ["cls", "piece"])
    others = F.slice(F.filter("best", lambda x: x["rid"] != F.col("own")), 1, nearest)
    answers = answers.select("query_id", F.posexplode(others).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _audited(entries: DataFrame, queries: DataFrame, n: int, index: MultiIndex, audit: int, nearest: int, target: float) -> int:
    """The least budget that meets the share ``target`` of the true neighbours of some ``audit`` queries."""
    # fewer of very long vectors: every task holds them
    drawn = _drawn(queries, min(audit, max(16, SAMPLE_BYTES // (64 * index.widest))), n, 2)
    if not drawn:
        return 0
    q = _stacked(drawn, index.widest)
    shared = queries.sparkSession.sparkContext.broadcast((index.parts(), [bytes(r["cls"]) for r in drawn], np.array([r["dim"] for r in drawn]), q))
    true = entries.mapInArrow(_true_cells(shared, nearest), "q int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "cell"))
    true = true.withColumn("place", place).filter(F.col("place") <= nearest).groupBy("q").agg(F.collect_list("cell").alias("cells")).collect()
    shared.destroy()
    one, two = index.distances(q)
    needed = sorted(x for r in true for x in index.needed(one[r["q"]], two[r["q"]], r["cells"]))
    log.info("audit: %d true neighbours of %d queries", len(needed), len(drawn))
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] if needed else 0
