"""Merkle manifest of a table: one root for all rows, and a proof for each.

Every row is a leaf.  The leaves of a group form a tree of eight children a node, in the order of
their ids, and the roots of the groups form another one.

1. Spark hashes the rows and numbers the leaves of each group, by range partitions and prefix sums
   of their totals.
2. Leaves are cut into buckets of 8**4 aligned places.  A task hands a bucket to DuckDB as an Arrow
   table; each level is one query, ``sha256(string_agg(...))`` over runs of eight.
3. Bucket roots are nodes again, cut into buckets in turn, until a group has one node left.
4. On the way down, each bucket is joined with the proof of its own root, its outer proof, and DuckDB
   extends it to the nodes of the bucket; of the leaves only digests are left.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width

#: Children of a node, and levels that one bucket holds.
FAN, LEVELS = 8, 4
BUCKET = FAN**LEVELS

_ENGINE = None


def _engine():
    """One connection for each Python worker, of one thread and bounded memory, which writes no files."""
    global _ENGINE
    if _ENGINE is None:
        import duckdb

        _ENGINE = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    return _ENGINE


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _runs(nodes: pa.Table, levels: int) -> tuple[list[pa.Table], pa.Table]:
    """For each level the runs of its nodes, as their concatenated digests; and the nodes that are left.
    ``nodes``: place and hex digest."""
    db, runs = _engine(), []
    for _ in range(levels):
        db.register("nodes", nodes)
        runs.append(db.sql(f"SELECT place // {FAN} AS run, string_agg(h, '' ORDER BY place) AS digests FROM nodes GROUP BY place // {FAN}").to_arrow_table())
        db.register("runs", runs[-1])
        nodes = db.sql("SELECT run AS place, sha256(digests) AS h FROM runs").to_arrow_table()
    return runs, nodes


def _bucket_root(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The one node that a bucket (grp, bucket) ends in, and how many the group has of them."""
    n = table["n"][0].as_py()
    _, top = _runs(table.select(["place", "h"]), min(LEVELS, levels_of(n)))
    return pa.table({"grp": [key[0].as_py()], "place": [key[1].as_py()], "h": top["h"], "n": [-(-n // BUCKET)]})


def _beside(levels: int, runs: list[pa.Table], nodes: pa.Table) -> pa.Table:
    """For each node and level the digests to the left and to the right of its path in a run: ``l0``, ``r0``, ..."""
    db = _engine()
    db.register("nodes", nodes)
    joins, columns = [], []
    for i, run in enumerate(runs):
        db.register(f"run{i}", run)
        before = f"64 * ((nodes.place // {FAN**i}) % {FAN})"
        joins.append(f"JOIN run{i} ON run{i}.run = nodes.place // {FAN ** (i + 1)}")
        columns.append(f", substr(run{i}.digests, 1, {before}) AS l{i}, substr(run{i}.digests, {before} + 65) AS r{i}")
    return db.sql(f"SELECT nodes.*{''.join(columns)} FROM nodes {' '.join(joins)}").to_arrow_table()


def _inner_proofs(table: pa.Table, outer: pa.Table) -> pa.Table:
    """The proofs of a bucket's nodes: its own levels, then those of its root."""
    levels = min(LEVELS, levels_of(table["n"][0].as_py()))
    nodes = table.select(["grp", "place", "h"])
    found = _beside(levels, _runs(nodes.select(["place", "h"]), levels)[0], nodes)
    db, top = _engine(), outer.select(["lefts", "rights", "subroot", "root"])
    db.register("found", found)
    db.register("top", top)
    sides = [", ".join(f"{s}{i}" for i in range(levels)) for s in "lr"]
    out = f"SELECT grp, place, list_concat([{sides[0]}]::VARCHAR[], lefts) AS lefts, list_concat([{sides[1]}]::VARCHAR[], rights) AS rights, subroot, root FROM found, top"
    return db.sql(out).to_arrow_table()


def _leaf_proofs(table: pa.Table, outer: pa.Table) -> pa.Table:
    """What is left of the proofs of leaves: the digest of their text, and the root that they lead to."""
    levels = min(LEVELS, levels_of(table["n"][0].as_py()))
    db, top = _engine(), outer.select(["lefts", "rights", "subroot", "root"])
    leaves = table.select(["id", "place", "h", "claimed"])
    found = _beside(levels, _runs(leaves.select(["place", "h"]), levels)[0], leaves)
    lefts, rights = top["lefts"][0].as_py(), top["rights"][0].as_py()
    db.register("top", top)
    db.register("path0", found.append_column("proof", pa.array([""] * found.num_rows)).append_column("fold", found["claimed"]))
    for i in range(levels):  # the levels of this bucket
        path = db.sql(f"SELECT * REPLACE (sha256(l{i} || fold || r{i}) AS fold, proof || l{i} || r{i} AS proof) FROM path0").to_arrow_table()
        db.register("path0", path)
    for left, right in zip(lefts, rights, strict=True):  # those above it, which all of its leaves share
        path = db.sql("SELECT * REPLACE (sha256($l || fold || $r) AS fold, proof || $l || $r AS proof) FROM path0", params={"l": left, "r": right}).to_arrow_table()
        db.register("path0", path)
    return db.sql("SELECT id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root FROM path0, top").to_arrow_table()


def _numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Adds ``place``, the place of each row in its ``grp``, and ``n``, the group's rows.  However many rows a group
    has, they are sorted in range partitions, whose totals (one row for each partition and group) are summed up."""
    ranged = materialise(rows.repartitionByRange(shuffle_width(rows.sparkSession), "grp", *order).withColumn("part", F.spark_partition_id()), tag)
    group = Window.partitionBy("grp")
    totals = ranged.groupBy("grp", "part").agg(F.count("*").alias("m"))
    totals = totals.select("grp", "part", F.coalesce(F.sum("m").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(totals, ["grp", "part"]).withColumn("place", (F.col("before") + F.col("inside") - 1).cast("bigint")).drop("before", "inside", "part")


def _bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"place div {BUCKET}"))


_NODE = "grp string, place bigint, h string, n bigint"
_PROOF = "grp string, place bigint, lefts array<string>, rights array<string>, subroot string, root string"


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Nodes, the roots of their buckets, the roots of these, and so on, until every group has one."""
    tiers = [nodes]
    while tiers[-1].filter("n > 1").limit(1).count():
        tiers.append(materialise(_bucketed(tiers[-1]).groupBy("grp", "bucket").applyInArrow(_bucket_root, _NODE), "manifest-nodes"))
    return tiers


def _joined(nodes: DataFrame, outer: DataFrame, task, schema: str) -> DataFrame:
    """Buckets, each with the proof of its root."""
    own = outer.withColumnRenamed("place", "bucket")
    return _bucketed(nodes).groupBy("grp", "bucket").cogroup(own.groupBy("grp", "bucket")).applyInArrow(task, schema)


def _value(x: Column) -> Column:
    text = x.cast("string")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def merkle_manifest(rows: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``rows``: for each its leaf, the roots over it, and what its proof comes to.

    Returns the id column, ``leaf`` (sha256 of ``columns``, each ``-`` if null, else its number of UTF-8 bytes, a
    colon and its text), ``subroot`` (of its group), ``root``, ``proof_sha256`` (of the digests beside its path,
    from its level up, left to right), ``folded_root`` (where the path leads from the leaf, with the columns of
    ``changed`` in place of those stored) and ``verified`` (it leads to the root).

    Defined cases: null ids come first; rows with the same id are ordered by their leaves, and identical rows are
    separate leaves next to each other; a null group comes before all others and the empty one next; a single row
    is its own subroot and, alone in the table, the root, with an empty proof; a very long text is hashed whole; an
    empty table gives an empty result; columns that are not named are not read.
    """
    changed = changed or {}
    digest = lambda fields: F.sha2(F.concat(*(_value(x) for x in fields)).cast("binary"), 256)
    stored = digest([F.col(c) for c in columns])
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(x) for c, x in changed.items()), F.lit(True))
    claimed = F.when(~same, digest([changed.get(c, F.col(c)) for c in columns]))
    group = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))  # null first, bytewise
    leaves = rows.select(F.col(id_col).alias("id"), group.alias("grp"), F.unhex(stored).alias("leaf"), F.unhex(claimed).alias("claimed"), F.monotonically_increasing_id().alias("tie"))
    numbered = materialise(_numbered(materialise(leaves, "manifest-leaves"), ["id", "leaf", "tie"], "manifest-ranges").drop("tie"), "manifest-places")
    hexed = lambda c: F.lower(F.hex(c))
    leaves = numbered.select("id", "grp", "place", "n", hexed("leaf").alias("h"), F.coalesce(hexed("claimed"), hexed("leaf")).alias("claimed"))

    tiers = _tiers(leaves.select("grp", "place", "h", "n"))
    if len(tiers) == 1:  # groups of one row each; a bucket's root is still needed
        tiers.append(materialise(_bucketed(tiers[0]).groupBy("grp", "bucket").applyInArrow(_bucket_root, _NODE), "manifest-nodes"))
    subroots = tiers[-1].select(F.col("grp").alias("name"), F.lit("").alias("grp"), "h")
    subroots = materialise(_numbered(subroots, ["name"], "manifest-groups"), "manifest-groups")
    above = _tiers(subroots.select("grp", "place", "h", "n"))

    none = F.array().cast("array<string>")
    proofs = above[-1].select("grp", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for tier in reversed(above[:-1]):
        proofs = materialise(_joined(tier, proofs, _inner_proofs, _PROOF), "manifest-proofs")
    proofs = subroots.select(F.col("name"), "place", "h").join(proofs.drop("grp"), "place").select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("place"), "lefts", "rights", F.col("h").alias("subroot"), "root")
    for tier in reversed(tiers[1:-1]):
        proofs = materialise(_joined(tier, proofs, _inner_proofs, _PROOF), "manifest-proofs")
    kind = leaves.schema["id"].dataType.simpleString()
    out = _joined(leaves, proofs, _leaf_proofs, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
