"""Connected components of a link table by union-find, first in partitions, then over all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import tidy
from vigilog.session import materialize


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as a star around each local root: at most one per node."""
    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(x, y)
    nodes = [x for x in forest.parent if forest.find(x) != x]
    for a in range(0, max(1, len(nodes)), 50_000):
        part = nodes[a:a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(
            [forest.find(x) for x in part], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the least of its component, from links (a, b).

    Each round turns the links towards the least neighbour seen: a node's links to greater ones
    move to its least neighbour, and it keeps one link itself. Rounds go on until nothing moves
    (the links are then stars around the roots), about as many as the logarithm of the longest
    chain. Neighbours are never gathered: a round is a minimum per node and a join, so a node
    with very many links can be split. Each round is written to the shared folder.
    """
    pairs = links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    stars = materialize(pairs.where("a <> b").mapInArrow(
        tidy(_contract), "node bigint, root bigint"), "components")
    state = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state:
            return stars
        state = now
        # Larger neighbours go to the least one (links run from the greater to the lesser).
        least = stars.groupBy("node").agg(F.min("root").alias("least"))
        moved = (stars.join(least, "node")
                 .select(F.explode(F.array(
                     F.struct("node", F.col("least").alias("root")),
                     F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("l"))
                 .select("l.*").where("node <> root").distinct())
        up = moved.groupBy("node").agg(F.min("root").alias("up"))
        # A root that has itself moved: follow it one step, so chains halve.
        jumped = (moved.join(up.select(F.col("node").alias("root"), "up"), "root", "left")
                  .select("node", F.coalesce("up", "root").alias("root")))
        stars = materialize(jumped.where("node <> root").distinct(), "components")
