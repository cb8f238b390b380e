"""Connected components of a graph that no machine can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b): root is the smallest node of the component; roots themselves aren't listed.

    In every round each node hooks onto its smallest smaller neighbour, chains of hooks are halved until
    they end at roots, and the edges between roots are what is left. Null ends and loops don't count.
    """
    left = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    found = None
    while not left.isEmpty():
        hooks = written(left.groupBy("b").agg(F.min("a").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("b").alias("p"), F.col("p").alias("pp"))
            hooks = written(hooks.join(up, "p", "left").select("b", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "hooks")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.select("b", "p")
        if found is None:
            found = hooks.select(F.col("b").alias("node"), F.col("p").alias("root"))
        else:
            moved = found.join(hooks, F.col("root") == F.col("b"), "left").select("node", F.coalesce("p", "root").alias("root"))
            found = written(moved.unionByName(hooks.select(F.col("b").alias("node"), F.col("p").alias("root"))), "roots")
        one = hooks.select(F.col("b").alias("a"), F.col("p").alias("pa"))
        two = hooks.select("b", F.col("p").alias("pb"))
        ends = left.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        left = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return found if found is not None else left.select(F.col("b").alias("node"), F.col("a").alias("root"))
