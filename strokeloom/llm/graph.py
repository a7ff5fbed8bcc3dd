"""Connected components of a table of links: a forest in each task, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeloom.llm.common import joined, kept, materialize, scratch

MAX_ROUNDS = 60  # a path of n nodes takes about log2(n) rounds


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node reachable) of a graph of n nodes with links i to j."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            moved = np.nonzero(root != np.arange(n))[0]
            return moved, root[moved]
        root = after


HELD = 1 << 22  # links that a task contracts at once


def stars(links: DataFrame) -> DataFrame:
    """links (a, b), written. As many links or fewer, (larger, smaller), with the same components: each
    task turns the links of its files into stars, whole or HELD at a time."""

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        node, root = forest(len(nodes), places[: len(a)], places[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(nodes[node]), pa.array(nodes[root])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD:
                yield contracted(held)
                held = []
        if held:
            yield contracted(held)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), longs. Returns (node, root), root the least node reachable, for every node with a
    link to another one.

    Each round points neighbours at the least node of a neighbourhood, first upwards, then
    downwards; it ends when a round changes nothing. No row count ever exceeds that of the links,
    least nodes come from partial sums, and each round's rows are written before the next. A node
    with many neighbours is no task of its own: its least node is broadcast.
    """
    mark = lambda rows: tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    with scratch(links.sparkSession):
        rows = kept(stars(materialize(links.where("a <> b").select("a", "b"), "links")).distinct(), "links")
    before = mark(rows)
    for _ in range(MAX_ROUNDS):
        with scratch(links.sparkSession):
            rows = kept(_round(rows), "links")
        now = mark(rows)
        if now == before:
            return rows.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")


def _round(rows: DataFrame) -> DataFrame:
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    up = joined(both, materialize(least, "least"), "a", "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # up holds (larger, smaller) only: each node now points down.
    up = materialize(up, "up")
    least = materialize(up.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    down = joined(up, least, "a", "n")
    down = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return down.distinct()
