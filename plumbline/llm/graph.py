"""Connected components by hooking to the least neighbour and contraction, in joins while many edges are left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import forget, settled, written

#: Edges that the driver solves at once: 16 bytes each, so 1 MB. A round of joins costs the driver far more in plans, stages and broadcasts.
FEW = 1 << 16


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != up[up]).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[up]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of the component. Nodes are integers.

    Each round hooks every node to its least neighbour, jumps twice along these hooks, and contracts
    the edges, so that at least half of the unfinished nodes of a component go in a round. The joins
    have plain exchanges on both sides, so that Spark can split the rows of a hub. Once at most FEW
    edges are left, the driver takes these to their roots.
    """
    left = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while left.count() > FEW:
        if roots is None:
            nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
            roots = written(nodes.withColumn("root", F.col("node")), "roots")
        both = left.union(left.select("b", "a"))
        first = written(both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.first("a")).alias("y")), "hooks")
        hook = first
        for _ in range(2):
            nxt = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            hook = hook.join(nxt, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        hook = written(hook, "hooks")
        moved_roots = written(_moved(roots, hook), "roots")
        of_a, of_b = hook.select(F.col("x").alias("a"), F.col("y").alias("u")), hook.select(F.col("x").alias("b"), F.col("y").alias("v"))
        moved = left.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
        rest = written(moved.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
        forget(left, first, hook, roots)
        left, roots = rest, moved_roots
    return _finished(left, roots)


def _moved(roots: DataFrame, hook: DataFrame) -> DataFrame:
    """roots, each taken along its hook (x, y) if it has one."""
    return roots.join(hook.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("y", "root").alias("root"))


def _finished(left: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) once the last edges are solved; roots: of the rounds before, if there were any."""
    got = left.toArrow()
    x, y = least_nodes(*(got[c].to_numpy() for c in ("a", "b")))
    kind = got.schema.field("a").type
    hook = left.sparkSession.createDataFrame(pa.table({"x": pa.array(x, kind), "y": pa.array(y, kind)}))
    out = written(hook.toDF("node", "root") if roots is None else _moved(roots, hook), "roots")
    forget(left, *([] if roots is None else [roots]))
    settled(out.sparkSession)
    return out
