"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one batch: each node with the smallest node it reaches there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        stars = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["u", "v"])


def _checked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = edges.checkpoint()
    mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges, tuple(mark)


def connected_components(edges: DataFrame, *, contract: bool = True) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(u, v)`` (longs),
    except the roots themselves; the root is the smallest node reachable.

    Edges are first contracted to stars inside each Arrow batch (without
    ``contract`` this step, the only Python one, is left out); then the
    alternating large-star and small-star steps run until nothing changes (a
    logarithmic number of rounds in practice).  Each step groups by a node and
    joins its minimum back, both as hash aggregates and equi-joins, so a hub is
    collapsed before its shuffle and split by Spark in the join.  Every round is
    checkpointed.  Loops and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    stars, mark = _checked((edges.mapInArrow(_local_stars, "u long, v long") if contract else edges).distinct())
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())  # every larger neighbour points to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stars, new_mark = _checked(small)
        if new_mark == mark:
            break
        mark = new_mark
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
