"""Near-duplicate embeddings by NN-descent.

1. Vectors that lie close together are reduced to balls: in several random-projection orders,
   chunks of neighbouring rows are clustered around leaders.  A ball's radius is at most half
   the link angle, so by the triangle inequality all its members link with one another and
   need no pair.  A third of all rows being near copies becomes a handful of balls.
2. NN-descent over the balls: from neighbours within chunks of projection orders, each round
   joins every ball's neighbours with one another and keeps the nearest of each.  The distance
   of balls is the angle of their leaders less both radii.
3. The first descent ends when two rounds running hardly change the links; those after a failed audit, when
   hardly any entry changes.  A list that is full of links is saturated: its length doubles and the descent goes on,
   up to ``MOST_WIDENED`` doublings.  Balls whose lists are full even then lie in a dense region; they are compared with
   all balls in blocks, without lists.
4. Each audit compares a fresh sample of balls with all balls by brute force.  Where links are rare, a sample holds
   few; so probes are planted, too: some balls get a partner of their own at the link angle, the hardest that
   counts, which the search doesn't know from other balls.  While the share of real links (of links, and of balls) or
   of probes that is in the lists is below the target, more projection orders, and then longer lists, are taken.  If
   audits keep failing, or one doesn't halve the share that is missing, brute force compares the balls left.
5. Balls within the link angle are edges.  Their members' links are counted by bounds where
   these decide and by cosine in double precision where they don't.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .graph import components

log = logging.getLogger(__name__)

#: Rows that are compared with one another in a projection order.
CHUNK = 256
#: Radians by which single precision may mistake an angle, and by which bounds must hold.
SLACK, MARGIN = 2e-3, 1e-6
#: Bytes of vectors that a brute-force block broadcasts at most, its rows compared at a time, and places of a draw.
BLOCK_BYTES, QUERIES, PLACES = 16 << 20, 512, 1 << 40
#: How often a list that is full of links doubles.
MOST_WIDENED = 2

_NODE = "rid bigint, dim int, vec binary, radius double"


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; null where a vector has no direction."""
    for batch in batches:
        vecs, dims = [], []
        for x in batch.column("embedding").to_pylist():
            v = None
            if x and None not in x:
                v = np.array(x, np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    v = v / np.sqrt(v @ v)
                else:
                    v = None
            vecs.append(None if v is None else v.tobytes())
            dims.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["rid", "id", "dim", "vec"])


def _coded(seeds: range, kind):
    """For each seed, a turn of its own: the signs of 60 random projections, as one number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            parts = [(d, np.flatnonzero(dims == d)) for d in np.unique(dims).tolist()]
            parts = [(d, here, _matrix(batch.column("vec").take(pa.array(here)), kind)) for d, here in parts]
            for seed in seeds:
                codes = np.zeros(batch.num_rows, np.int64)
                for d, here, v in parts:
                    planes = np.random.default_rng([seed, d]).standard_normal((d, 60))
                    codes[here] = (v @ planes > 0) @ (np.int64(1) << np.arange(59, -1, -1))
                turn = pa.array(np.full(batch.num_rows, seed, np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, turn, pa.array(codes)], names=[*batch.schema.names, "turn", "code"])

    return task


def _in_order(nodes: DataFrame, seeds: range, kind=np.float64) -> DataFrame:
    """Nodes in a projection order for each seed, one after the other, in one shuffle; ids part rows of one code,
    however many."""
    coded = nodes.select("rid", "dim", "vec", "radius").mapInArrow(_coded(seeds, kind), f"{_NODE}, turn int, code bigint")
    return coded.repartitionByRange("turn", "dim", "code", "rid").sortWithinPartitions("turn", "dim", "code", "rid")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Up to ``CHUNK`` rows of one turn and dimension at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        at = 0
        while table.num_rows - at >= CHUNK:
            yield from _alike(table.slice(at, CHUNK))
            at += CHUNK
        held = table.slice(at).to_batches()
    if held:
        yield from _alike(pa.Table.from_batches(held).combine_chunks())


def _alike(table: pa.Table) -> Iterator[pa.Table]:
    step = np.diff(table["turn"].to_numpy()) | np.diff(table["dim"].to_numpy())
    cuts = [0, *(np.flatnonzero(step) + 1).tolist(), table.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield table.slice(a, b - a)


def _absorb(limit: float):
    """Leaders of each chunk take in what lies, with its own ball, within ``limit`` of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            v, r, ids = _matrix(t["vec"]), t["radius"].to_numpy(), t["rid"].to_numpy()
            far = _angles(v, v)
            np.fill_diagonal(far, 0)
            far = far + r
            leader, radius, free = np.arange(len(r)), r.copy(), np.ones(len(r), bool)
            for i in range(len(r)):
                if free[i]:
                    own = free & (far[i] <= limit)
                    leader[own], radius[i] = i, far[i][own].max()
                    free &= ~own
            yield from pa.table({"rid": t["rid"], "dim": t["dim"], "vec": t["vec"], "radius": radius, "leader": ids[leader]}).to_batches()

    return task


def _nearest(k: int):
    """The ``k`` nearest of each row in its chunk, in single precision."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            v, r, ids = _matrix(t["vec"], np.float32), t["radius"].to_numpy(), t["rid"].to_numpy()
            gap = _angles(v, v) - r - r[:, None]
            np.fill_diagonal(gap, np.inf)
            n = min(k, len(ids) - 1)
            if n > 0:
                best = np.argpartition(gap, n - 1, axis=1)[:, :n]
                u = np.repeat(np.arange(len(ids)), n)
                yield from pa.table({"u": ids[u], "v": ids[best.ravel()], "d": gap[u, best.ravel()]}).to_batches()

    return task


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, x, fresh, vec, radius, worst) sorted by p: the pairs of p's neighbours of which one is fresh,
    as far as they are nearer to x than its worst neighbour."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        v, r, ids = _matrix(t["vec"], np.float32), t["radius"].to_numpy(), t["x"].to_numpy()
        fresh, worst = t["fresh"].to_numpy(), t["worst"].to_numpy()
        gap = _angles(v, v) - r - r[:, None]
        a, b = np.nonzero((gap < worst[:, None]) & (fresh | fresh[:, None]) & (ids != ids[:, None]))
        if len(a):
            yield from pa.table({"u": ids[a], "v": ids[b], "d": gap[a, b].astype(np.float64)}).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        p = table["p"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from pairs(table.slice(a, b - a))
        held = table.slice(cuts[-1]).to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held).combine_chunks())


def _probes(angle: float):
    """For each node a partner at ``angle`` from it, in a direction of its own; its id is below 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = []
            for rid, x in zip(batch.column("rid").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                v = np.frombuffer(x)
                w = np.random.default_rng([rid, len(v)]).standard_normal(len(v))
                w = w - (w @ v) * v
                size = np.sqrt(w @ w)
                p = np.cos(angle) * v + np.sin(angle) * w / size if size > 1e-9 else v
                vecs.append((p / np.sqrt(p @ p)).tobytes())
            ids = pa.array(-1 - batch.column("rid").to_numpy())
            yield pa.RecordBatch.from_arrays([ids, batch.column("dim"), pa.array(vecs, pa.binary()), pa.array(np.zeros(len(vecs)))], names=["rid", "dim", "vec", "radius"])

    return task


def _brute(shared, reach: float):
    """Nodes within ``reach`` of the shared ones: (u, v)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d, (ids, vecs, radii) in block.items():
                here = np.flatnonzero(dims == d)
                if len(here):
                    v, r, own = _matrix(batch.column("vec").take(pa.array(here))), batch.column("radius").to_numpy()[here], batch.column("rid").to_numpy()[here]
                    single = np.ascontiguousarray(v.T, np.float32)
                    for i in range(0, len(ids), QUERIES):
                        q, q_ids, q_radii = vecs[i : i + QUERIES], ids[i : i + QUERIES], radii[i : i + QUERIES]
                        # the widest radii decide which angles are worth taking; single precision errs by far less than SLACK
                        least = np.cos(min(np.pi, reach + q_radii.max() + r.max() + MARGIN)) - SLACK
                        a, b = np.divmod(np.flatnonzero(q.astype(np.float32) @ single >= np.float32(least)), len(own))
                        cosine = np.einsum("ij,ij->i", q[a], v[b])
                        near = (np.arccos(np.clip(cosine, -1, 1)) - q_radii[a] - r[b] <= reach) & (q_ids[a] != own[b])
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[near]]), pa.array(own[b[near]])], names=["u", "v"])

    return task


def _angle_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``cosine`` and ``angle`` of the columns x and y; a vector of another length is at no angle."""
    for batch in batches:
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        cosine = np.array([np.frombuffer(a) @ np.frombuffer(b) if len(a) == len(b) else -2.0 for a, b in zip(x, y, strict=True)], np.float64)
        rest = [c for c in batch.schema.names if c not in ("x", "y")]
        angle = np.where(cosine < -1.5, np.inf, np.arccos(np.clip(cosine, -1, 1)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(cosine), pa.array(angle)], names=[*rest, "cosine", "angle"])


class _Descent:
    """Neighbour lists of nodes (rid, dim, vec, radius), and of some ``probes`` planted at ``angle``, and their refinement."""

    def __init__(self, nodes: DataFrame, k: int, reach: float, angle: float, probes: int, reverse: int = 32) -> None:
        self.real, self.k, self.reach, self.reverse, self.seeds = nodes, k, reach, reverse, 1000
        self.n, self.widest = nodes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
        share = min(PLACES, probes * PLACES // max(1, self.n))
        planted = nodes.filter(F.pmod(F.xxhash64("rid", F.lit(-1)), F.lit(PLACES)) < share).mapInArrow(_probes(angle), _NODE)
        self.nodes = nodes = materialise(nodes.select("rid", "dim", "vec", "radius").unionByName(planted), "descent-all")
        self.light = materialise(nodes.mapInArrow(_to_single, _NODE), "descent-nodes")
        self.edges: DataFrame | None = None
        # links found by brute force, and the nodes all of whose links are among them
        self.proved: list[DataFrame] = []
        self.compared, self.draws = F.lit(False), 0
        self.filled: DataFrame | None = None

    def _kept(self, found: DataFrame) -> DataFrame:
        """The nearest of each list; ``fresh``: not joined yet.  One shuffle, by u, serves both steps."""
        once = found.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
        order = Window.partitionBy("u").orderBy("d", "v")
        k = F.coalesce(F.max("k").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(self.k))
        return materialise(once.withColumns({"rank": F.row_number().over(order), "k": k}).filter("rank <= k").select("u", "v", "d", "fresh", "rank", "k"), "descent-edges")

    def _facts(self) -> tuple[int, int, int, int, int]:
        """Numbers of entries, fresh ones, links, fresh ones, and lists that are full of links."""
        link = F.col("d") <= self.reach
        return tuple(self.edges.agg(F.count("*"), F.count_if("fresh"), F.count_if(link), F.count_if(link & F.col("fresh")), F.count_if(link & (F.col("rank") == F.col("k")))).first())

    def seed(self, orders: int, k: int) -> None:
        """Add the neighbours within chunks of so many more projection orders."""
        new = [F.lit(True).alias("fresh"), F.lit(None).cast("int").alias("k")]
        found = _in_order(self.light, range(self.seeds, self.seeds + orders), np.float32).mapInArrow(_nearest(k), "u bigint, v bigint, d double").select("*", *new)
        self.seeds += orders
        self.edges = self._kept(found if self.edges is None else found.unionByName(self.edges.select("u", "v", "d", "fresh", "k")))

    def refine(self, rounds: int, enough: float, *, links_only: bool) -> None:
        """Join neighbours of neighbours until fewer than ``enough`` of all entries change, or, ``links_only``, of
        those that are links, in two rounds running; double the lists that are full of links; again, until none is.
        Lists that doubling doesn't help are left to brute force."""
        full, widened = 1, 0
        while full:
            still = 0
            for _ in range(rounds):
                old = self.edges.select("u", "v", "d", F.lit(False).alias("fresh"), "k")
                self.edges = self._kept(self._joined().withColumns({"fresh": F.lit(True), "k": F.lit(None).cast("int")}).unionByName(old))
                total, fresh, links, fresh_links, full = self._facts()
                log.info("refined: %d entries, %d fresh; %d links, %d fresh; %d full lists", total, fresh, links, fresh_links, full)
                still = still + 1 if fresh_links <= enough * links else 0
                if fresh <= enough * total or (links_only and still == 2):
                    break
            if full and widened == MOST_WIDENED:
                self._fill()
                return
            if full:
                self._widen()
                widened += 1

    def _fill(self) -> None:
        """Compare the nodes whose lists are full of links with all nodes; then every link of theirs is known."""
        full = self.edges.filter((F.col("d") <= self.reach) & (F.col("rank") == F.col("k"))).select(F.col("u").alias("rid")).distinct()
        full = full if self.filled is None else full.join(self.filled, "rid", "left_anti")
        rest = materialise(self.real.join(full, "rid", "left_semi").filter(~self.compared), "descent-full")
        self.filled = rest.select("rid") if self.filled is None else self.filled.unionByName(rest.select("rid"))
        n = rest.count()
        log.info("brute force for %d of %d balls with full lists", n, self.n)
        if n:
            self.proved += [true for true, _ in self._blocks(rest, n, max(QUERIES, BLOCK_BYTES // (8 * self.widest)), self.reach)]

    def _joined(self) -> DataFrame:
        e = self.edges
        # of a node that very many have as a neighbour, `reverse` reverse entries are taken, fresh ones first; before the shuffle, too
        place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("fresh").desc(), F.xxhash64("u", "v", "d"), "u"))
        back = e.select("u", "v", "d", "fresh").withColumn("place", place).filter(F.col("place") <= self.reverse).select(F.col("v").alias("p"), F.col("u").alias("x"), "fresh")
        legs = e.select(F.col("u").alias("p"), F.col("v").alias("x"), "fresh").unionByName(back).repartition("x").groupBy("p", "x").agg(F.max("fresh").alias("fresh"))
        worst = e.groupBy("u").agg(F.when(F.count("*") >= F.max("k"), F.max("d")).otherwise(F.lit(10.0)).alias("worst"))
        about = self.light.select("rid", "vec", "radius").join(worst.withColumnRenamed("u", "rid"), "rid").withColumnRenamed("rid", "x")
        full = legs.join(about, "x").select("p", "x", "fresh", "vec", "radius", "worst")
        return full.repartition("p").sortWithinPartitions("p").mapInArrow(_local_join, "u bigint, v bigint, d double")

    def _widen(self) -> None:
        """Double the lists that are full of links; what they drop so far comes back through their neighbours,
        which are fresh again."""
        full = self.edges.filter((F.col("d") <= self.reach) & (F.col("rank") == F.col("k"))).select("u", F.lit(True).alias("full"))
        again = self.edges.join(full, "u", "left").withColumn("full", F.coalesce("full", F.lit(False)))
        self.edges = materialise(again.select("u", "v", "d", (F.col("fresh") | F.col("full")).alias("fresh"), "rank", F.when(F.col("full"), 2 * F.col("k")).otherwise(F.col("k")).alias("k")), "descent-edges")

    def lengthen(self) -> None:
        """Double all lists."""
        self.k *= 2
        self.edges = self.edges.withColumn("k", 2 * F.col("k"))

    def links(self, reach: float) -> DataFrame:
        near = self.edges.filter((F.col("d") <= reach) & (F.col("u") >= 0) & (F.col("v") >= 0)).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        for x in self.proved:
            near = near.union(x.select(F.least("u", "v"), F.greatest("u", "v")))
        return near.distinct()

    def _blocks(self, nodes: DataFrame, n: int, first: int, reach: float) -> Iterator[tuple[DataFrame, Column]]:
        """Freshly drawn blocks of ``nodes``, about ``first`` and then four times as many each time, against all nodes:
        the links (u, v) of a block, and which nodes have been drawn up to then; the last block ends the nodes."""
        self.draws += 1
        place = F.pmod(F.xxhash64("rid", F.lit(self.draws)), F.lit(PLACES))
        low, size, most = 0, first, max(QUERIES, BLOCK_BYTES // (8 * self.widest))
        while low < PLACES:
            high = min(PLACES, low + max(1, min(size, most) * PLACES // max(1, n)))
            by: dict[int, list] = {}
            for x in nodes.filter((place >= low) & (place < high)).collect():
                by.setdefault(x["dim"], []).append(x)
            block = {d: (np.array([x["rid"] for x in own]), np.stack([np.frombuffer(x["vec"]) for x in own]), np.array([x["radius"] for x in own])) for d, own in by.items()}
            shared = self.nodes.sparkSession.sparkContext.broadcast(block)
            true = materialise(self.real.mapInArrow(_brute(shared, reach + MARGIN), "u bigint, v bigint"), "descent-true")
            shared.destroy()
            yield true, place < high
            low, size = high, 4 * size

    def audit(self, reach: float, sample: int, enough: int) -> float:
        """Share of what should be in the lists that is: of the true links of ``sample`` fresh nodes, over links or
        over nodes, if there are ``enough`` of these links to tell, and of the probes; the least of them.

        What brute force finds stays known.  If the sample takes all nodes, every link is, and the share is 1.
        """
        known = materialise(self.links(reach + SLACK).withColumn("hit", F.lit(1)), "descent-known")
        true, drawn = next(self._blocks(self.real, self.n, sample, reach))
        seen = true.select("u", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).join(known, ["a", "b"], "left")
        n, found, nodes, shares = (x or 0 for x in seen.groupBy("u").agg(F.count("*").alias("n"), F.count("hit").alias("found")).agg(F.sum("n"), F.sum("found"), F.count("*"), F.sum(F.col("found") / F.col("n"))).first())
        met = self.edges.filter((F.col("d") <= self.reach) & (F.col("u") == -1 - F.col("v")))
        probes = self.nodes.filter("rid < 0").count()
        planted = met.select(F.least("u", "v").alias("p")).distinct().count()
        self.proved.append(true)
        self.compared = self.compared | drawn
        log.info("audit %d: %d of %d links at %d of %d balls, mean share %.4f; %d of %d probes", self.draws, found, n, nodes, self.n, shares / nodes if nodes else 1.0, planted, probes)
        if sample >= self.n:
            return 1.0
        return min(found / n if n >= max(1, enough) else 1.0, shares / nodes if n >= max(1, enough) else 1.0, planted / probes if probes else 0.0)

    def complete(self, reach: float) -> None:
        """Compare what no audit has compared with all nodes; then every link is known."""
        rest = materialise(self.real.filter(~self.compared), "descent-rest")
        n = rest.count()
        log.info("brute force for the %d of %d balls not compared yet", n, self.n)
        most = max(QUERIES, BLOCK_BYTES // (8 * self.widest))
        self.proved += [true for true, _ in self._blocks(rest, n, most, reach)]
        self.compared = F.lit(True)


def orders_for(n: int, angle: float, target: float) -> int:
    """Projection orders in which two of ``n`` vectors at ``angle`` lie in one chunk at least once, all but for half of
    what ``target`` leaves open: two signs in a row agree with a chance of 1 - angle / pi.  From 6 to 32."""
    once = (1 - angle / np.pi) ** max(0.0, np.log2(max(1, n) / CHUNK))
    return int(np.clip(np.ceil(np.log(max(1e-4, (1 - target) / 2)) / np.log(max(1e-9, 1 - once))), 6, 32))


def _last_leaders(steps: list[DataFrame]) -> DataFrame:
    """(``rid``, ``leader``): who leads each absorbed node in the end.  A node is absorbed once; leaders that are
    themselves absorbed in a later step are followed, twice as far each time."""
    led = materialise(reduce(DataFrame.unionByName, steps), "ball-leaders")
    for _ in range((len(steps) - 1).bit_length()):
        further = led.select(F.col("rid").alias("leader"), F.col("leader").alias("last"))
        led = materialise(led.join(further, "leader", "left").select("rid", F.coalesce("last", "leader").alias("leader")), "ball-leaders")
    return led


def _to_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = [np.frombuffer(x).astype(np.float32).tobytes() for x in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("dim"), pa.array(vecs, pa.binary()), batch.column("radius")], names=["rid", "dim", "vec", "radius"])


def linked_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, neighbours: int = 8, orders: int | None = None, target_recall: float = 0.98, sample: int = 512, audit_links: int = 100, probes: int = 1000, most_audits: int = 4) -> DataFrame:
    """Links of vectors with a cosine of ``cosine`` or more, and the components they make.

    Returns one row per vector: the id column, ``n_links`` (other vectors linked with it), ``component_id``
    (the least id reachable by links, itself included) and ``kept`` (it is that id).  No pair below the
    threshold is linked; the share of pairs found is audited against ``target_recall``, on the links of ``sample``
    balls where they number ``audit_links`` or more, and on ``probes`` planted pairs.  If ``most_audits`` audits fail,
    or one finds more than half as much missing as the one before, all balls are compared: no link is missed.

    Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, links with
    nothing and is its own component; vectors of different lengths do not link; equal ids are separate
    vectors; a row with a null id is linked and counted, but names no component and is not kept; an empty
    table gives an empty result; other columns are not read.
    """
    angle = float(np.arccos(cosine))
    rows = materialise(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("embedding")).withColumn("rid", F.monotonically_increasing_id()).select("rid", "id", "embedding").mapInArrow(_unit, "rid bigint, id bigint, dim int, vec binary"), "vectors")
    valid = rows.filter("dim > 0")

    nodes = valid.select("rid", "dim", "vec", F.lit(0.0).alias("radius"))
    steps = []
    before = valid.count()
    for i in range(12):
        step = materialise(_in_order(nodes, range(i, i + 1)).mapInArrow(_absorb(angle / 2 - MARGIN), f"{_NODE}, leader bigint"), "balls")
        steps.append(step.filter("rid <> leader").select("rid", "leader"))
        nodes = step.filter("rid = leader").drop("leader")
        after = nodes.count()
        log.info("absorbed: %d of %d balls left", after, before)
        if i and after > 0.98 * before:
            break
        before = after
    member = valid.select("rid").join(_last_leaders(steps), "rid", "left").select("rid", F.coalesce("leader", "rid").alias("ball"))
    member = materialise(member, "ball-members")

    search = _Descent(nodes, neighbours, angle + SLACK, angle, probes)
    orders = orders or orders_for(search.n, angle, target_recall)
    search.seed(orders, neighbours)
    reached = 0.0
    for i in range(most_audits):
        search.refine(8, 0.002, links_only=i == 0)
        before, reached = reached, search.audit(angle, sample, audit_links)
        if reached >= target_recall or (i and 1 - reached > (1 - before) / 2):
            break
        if i + 1 < most_audits:
            if i:
                search.lengthen()
            search.seed(orders, search.k)
    if reached < target_recall:
        search.complete(angle)

    full = materialise(valid.select("rid", "id", "vec").join(member, "rid"), "ball-vectors")
    balls = full.groupBy("ball").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    balls = materialise(nodes.select(F.col("rid").alias("ball"), "vec", "radius").join(balls, "ball"), "ball-facts")

    def side(name: str, vec: str) -> DataFrame:
        return balls.select(F.col("ball").alias(name), F.col("vec").alias(vec), F.col("radius").alias(f"r_{name}"), F.col("size").alias(f"n_{name}"))

    near = search.links(angle + SLACK).join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "r_a", "r_b", "n_a", "n_b", "x", "y")
    near = materialise(near.mapInArrow(_angle_of, "a bigint, b bigint, r_a double, r_b double, n_a bigint, n_b bigint, cosine double, angle double"), "ball-edges")
    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    spread = F.col("r_a") + F.col("r_b")
    whole = F.when(single, F.col("cosine") >= cosine).otherwise(F.col("angle") + spread <= angle - MARGIN)
    open_ = ~single & ~whole & (F.col("angle") - spread <= angle + MARGIN)
    wholes = near.filter(whole)
    per_ball = wholes.select(F.col("a").alias("ball"), F.col("n_b").alias("n")).union(wholes.select("b", "n_a")).groupBy("ball").agg(F.sum("n").alias("others"))

    # balls that bounds leave open: each member against the other ball, then against its members
    sides = near.filter(open_).select("a", "b").union(near.filter(open_).select("b", "a"))
    tried = full.select("rid", F.col("ball").alias("a"), F.col("vec").alias("x")).join(sides, "a").join(side("b", "y"), "b").select("rid", "a", "b", "r_b", "n_b", "x", "y")
    tried = materialise(tried.mapInArrow(_angle_of, "rid bigint, a bigint, b bigint, r_b double, n_b bigint, cosine double, angle double"), "ball-tries")
    certain = F.col("angle") + F.col("r_b") <= angle - MARGIN
    unsure = ~certain & (F.col("angle") - F.col("r_b") <= angle + MARGIN)
    pairs = tried.filter(unsure).select("rid", "a", "b").join(full.select("rid", F.col("vec").alias("x")), "rid").join(full.select(F.col("ball").alias("b"), F.col("vec").alias("y")), "b").select("rid", "a", "b", "x", "y")
    pairs = pairs.mapInArrow(_angle_of, "rid bigint, a bigint, b bigint, cosine double, angle double").filter(F.col("cosine") >= cosine)
    partial = tried.filter(certain).select("rid", "a", "b", F.col("n_b").alias("n")).unionByName(pairs.groupBy("rid", "a", "b").agg(F.count("*").alias("n")))
    partial = materialise(partial, "ball-partial")

    joined = components(wholes.select("a", "b").union(partial.select("a", "b").distinct()))
    named = balls.select("ball", "size", "least").join(joined.withColumnRenamed("id", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(per_ball, "ball", "left").select("ball", "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    extra = partial.groupBy("rid").agg(F.sum("n").alias("extra"))
    out = rows.select("rid", "id").join(member, "rid", "left").join(named, "ball", "left").join(extra, "rid", "left")
    component = F.when(F.col("ball").isNull(), F.col("id")).otherwise(F.col("component_id"))
    count: Column = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("extra"), F.lit(0))
    return out.select(F.col("id").alias(id_col), count.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
