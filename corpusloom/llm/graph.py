"""Connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import write_table


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b: long).

    Each round hooks every node to its least neighbour, shortens the chains to their ends and keeps the edges
    between different ends; rounds grow with the logarithm of a component's length. Every round is written out.
    """
    edges = write_table(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        hooked = both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root"))
        hooked = write_table(hooked, "hooked")
        while True:
            up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = hooked.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
            longer = write_table(longer.join(up.toDF("root", "next"), "root").select("node", F.col("next").alias("root"), (F.col("moved") | (F.col("next") != F.col("root"))).alias("moved")), "hooked")
            hooked = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        ends = hooked.toDF("_at", "_end")
        if roots is None:
            roots = hooked
        else:
            roots = write_table(roots.join(ends, roots["root"] == ends["_at"], "left").select("node", F.coalesce("_end", "root").alias("root")), "roots")
        moved = edges.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x != y")
        edges = write_table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.toDF("node", "root")


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) after more edges (a, b)."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    between = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    between = write_table(between.where("a != b").distinct(), "edges")
    if between.isEmpty():
        return roots
    ends = components(between).toDF("root", "end")
    # a node without earlier links is its own root
    known = roots.unionByName(ends.select(F.col("root").alias("node"), "root").join(roots, "node", "left_anti"))
    return write_table(known.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
