"""Connected components by local contraction, in Spark alone.

Each round, every node takes the label of the node with the least random rank in its closed neighbourhood; edges
are then drawn between labels, loops and repeats go, and the labels of all rounds compose. A round needs one
aggregate by node and two plain equi-joins (whose skewed sides adaptive execution can split), so a node with any
number of neighbours is never gathered in one task. Rounds grow with the logarithm of the number of nodes. Every
round is a written table in the shared folder; only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store


def connected_components(edges: DataFrame, store: Store, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node of each component. Nodes without an edge to another node are not listed.

    Nulls, loops and repeated edges are ignored. No edges: no rows. Node columns may be of any orderable type.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = store.put(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    step = 0
    while not e.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), c).alias("r"), c.alias("n"))  # noqa: B023,E731
        arcs = e.union(e.select("b", "a"))
        label = store.put(
            arcs.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least("m", rank(F.col("a")))["n"].alias("label")),
            "label",
        )
        la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
        nxt = e.join(la, "a").join(lb, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        nxt = store.put(nxt, "edges")
        if labels is None:
            labels = label
        else:
            up = label.toDF("label", "up")
            labels = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            labels = store.put(labels, "labels")
        store.drop(e)
        e = nxt
        step += 1
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("a").alias("root"))
    # written, since a join of plain scans can be split where one component holds very many nodes
    least = store.put(labels.groupBy("label").agg(F.min("node").alias("root")), "roots")
    return labels.join(least, "label").select("node", "root")
