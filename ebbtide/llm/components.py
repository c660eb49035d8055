"""Connected components of an edge table: up to SMALL edges in one task, more by large-star and small-star steps.

A round of steps takes about eight tasks a shuffle partition, and the driver handles the results of each, so a few edges aren't worth it.
Each step is a minimum for each node (summed before the shuffle) and a join back, so a node with very many edges is no single task's
work. Tables between rounds are written to the shared folder; nothing is collected but a number a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.ship import ship_package
from ebbtide.llm.common import materialize

#: Edges that one task joins, 4 MB of them.
SMALL = 1 << 18


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    moved = down.join(least, F.col("a") == F.col("k")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def _joined(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges, in order, and the least node of each one's component."""
    nodes, ends = np.unique(edges, return_inverse=True)
    ends, up = ends.reshape(edges.shape), np.arange(len(nodes))
    while True:
        a, b = up[ends[:, 0]], up[ends[:, 1]]
        if not (a != b).any():
            return nodes, nodes[up]
        # roots go under the least root that they meet, then every node under its root
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (above := up[up])).any():
            up = above


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
        if both:
            nodes, roots = _joined(np.concatenate(both))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    ship_package(e.sparkSession)
    return e.coalesce(1).mapInArrow(run, "node long, root long")


def _are_stars(e: DataFrame) -> bool:
    """Whether every node has one edge down (from a to b), or only edges from above."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not ends.filter("down + up > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """node, root: every node with an edge to another one, and the least node of its component. Null ends and loops are ignored."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a != b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if e.count() <= small:
        return materialize(_in_one_task(e), "roots")
    while not _are_stars(e):
        e = materialize(_small(_large(e)), "edges")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
