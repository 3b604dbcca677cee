"""Connected components by local forests and alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.llm.common import checkpointed_in_few, forest

#: Links of a task that are contracted together.
TOGETHER = 1 << 18


def contracted(links: DataFrame) -> DataFrame:
    """(u, v) stars that connect what the links (u, v) connect, made within each task, a bounded number at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            nodes, roots = forest(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("u", "v")))
            n += batch.num_rows
            if n >= TOGETHER:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one root at most and no root has another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    seen = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not seen.agg(F.max((F.col("child") + F.col("parent") > 1).cast("int")).alias("m")).first().m


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link in links (u long, v long); root is the least node reachable.

    Links to itself, repeats and either direction are fine; nodes without links are absent; no links give an
    empty result. Every round works on whole edges with aggregates and joins: the least neighbour of a node is a
    map-side combined minimum, so a node with very many links gathers nothing in one task. Minima are checkpointed
    before they are joined back: both sides of the join are then shuffled for it alone, so that adaptive execution
    may split the rows of such a node. Lost executors cost at most a part of a round.
    """
    edges = contracted(links.where(F.col("u") != F.col("v")))
    edges = checkpointed_in_few(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        # large star: the greater neighbours of x link to the least node around x
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed_in_few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpointed_in_few(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the lesser neighbours of x, and x, link to the least of them
        low = checkpointed_in_few(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed_in_few(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
