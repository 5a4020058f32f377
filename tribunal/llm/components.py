"""Connected components of a graph in a table, by hooking on the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Rows of a file of the (narrow) tables here.
ROWS = 500_000


def components(edges: DataFrame, stage=staged) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of its component.

    A round points each node at its smallest neighbour, follows the pointers to their ends, and contracts what they joined; at least half of the nodes
    that still have edges go each round. All rounds are written to the shared folder by stage(df, name), so that nothing long is recomputed.
    """
    found = None  # (node, root) so far
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while n := edges.count():
        keep = lambda df, name: stage(df.coalesce(2 * n // ROWS + 1), name)  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "up")
        while True:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            up = keep(up.join(to, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "up")
            done = up.where("moved").isEmpty()
            up = up.drop("moved")
            if done:
                break
        if found is None:
            found = up
        else:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = stage(found.join(to, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "found")
        ends = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = edges.join(ends[0], "a").join(ends[1], "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = keep(left.where("a <> b").distinct(), "edges")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
