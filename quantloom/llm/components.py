"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long ``u``, ``v``. Returns every node that has an edge to another: ``node``, ``root``.

    Each round points every node at its least neighbour by hash order (or
    itself), doubles the pointers, and rewrites the edges onto what they point
    at; edges inside a tree vanish. The hash order keeps the number of rounds logarithmic also
    on long chains. Each round's tables are written to the shared folder.
    ``root`` is one node of the component, the same for all its nodes.
    """
    live = materialize(edges.where("u <> v").select("u", "v").distinct())
    label: DataFrame | None = None
    while not live.isEmpty():
        both = live.union(live.select("v", "u"))
        key = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("n"))
        least = both.groupBy("u").agg(F.min(key).alias("m"))
        mine = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("n"))
        step = materialize(least.select(F.col("u").alias("node"), F.least("m", mine)["n"].alias("up")))
        for _ in range(2):
            over = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = step.join(over, "up").select("node", F.col("top").alias("up"))
        step = materialize(step)
        if label is None:
            label = step.withColumnRenamed("up", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "up")
            label = materialize(label.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        a, b = step.select(F.col("node").alias("u"), F.col("up").alias("a")), step.select(F.col("node").alias("v"), F.col("up").alias("b"))
        moved = live.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        live = materialize(moved.distinct())
    return live.select(F.col("u").alias("node"), F.col("v").alias("root")) if label is None else label
