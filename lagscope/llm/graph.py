"""Connected components of an undirected graph, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copied, dealt, hot_keys, materialise


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) for each end of ``edges`` (``a``, ``b``); a component is named by its least id.

    Each round takes the least label among a node's own and its neighbours', then the label of that label
    (pointer jumping), and ends when nothing changes.  Rows are pairs of ids; the edges of a node that has very
    many are dealt to several tasks, and labels are reduced before they are shuffled.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = materialise(both.distinct(), "component-edges")
    hot = materialise(hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b"), "component-hot")
    both = materialise(dealt(both, "b", hot, ["a"]), "component-edges")
    # the least neighbour at once: in a star one round is enough
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "component-labels")
    while True:
        near = both.join(copied(labels.select(F.col("id").alias("b"), "label"), "b", hot), ["b", "piece"]).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "m").alias("m"))
        # very many nodes may have one label
        named = materialise(least, "component-least")
        many = hot_keys(named.groupBy("m").agg(F.count("*").alias("n")), "m")
        jump = copied(labels.select(F.col("id").alias("m"), F.col("label").alias("j")), "m", many)
        new = materialise(dealt(named, "m", many, ["id"]).join(jump, ["m", "piece"], "left").select("id", F.col("label").alias("old"), F.coalesce("j", "m").alias("label")), "component-labels")
        labels = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
