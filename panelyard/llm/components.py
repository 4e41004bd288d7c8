"""Connected components of an edge table by repeated contraction.

Defined results. Edges may come in any direction and repeat; loops and edges with a NULL end are
left out. Nodes without an edge have no row. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import stored

CHUNK = 500_000          # edges a task contracts at once


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number joined to each of 0 to n - 1 by the pairs (a, b). Each turn hooks every
    root with a smaller neighbour and then shortens all ways to one step."""
    label = np.arange(n)
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return label
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while (label[label] != label).any():
            label = label[label]


def star_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, place of a, place of b) to edges (a, b) that connect the same nodes: from every
    node of a chunk to the one of its component there with the first place. Equal places go to
    whichever node comes first, which connects all the same."""
    held, rows = [], 0

    def stars():
        table = pa.Table.from_batches(held)
        names = pa.concat_arrays([c for side in ("a", "b") for c in table.column(side).chunks]).dictionary_encode()
        place = np.concatenate([table.column(side).to_numpy() for side in ("da", "db")])
        code, number = names.indices.to_numpy(), len(names.dictionary)
        drawn = np.empty(number, dtype=np.int64)
        drawn[code] = place
        order = np.argsort(drawn, kind="stable")
        rank = np.empty(number, dtype=np.int64)
        rank[order] = np.arange(number)
        ends = rank[code]
        label = roots(number, ends[:table.num_rows], ends[table.num_rows:])
        moved = np.flatnonzero(label != np.arange(number))
        pick = lambda which: names.dictionary.take(pa.array(order[which]))
        return pa.RecordBatch.from_arrays([pick(moved), pick(label[moved])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield stars()
            held, rows = [], 0
    if rows:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component. ``edges`` has columns a, b.

    Each round sends every node to the first of its neighbours and itself in an order that a hash
    draws anew, and joins what is left of the edges between those. On average a fixed share of
    nodes goes each round, however the ids run along a chain, so rounds grow with the logarithm of
    the nodes and need no limit. Ahead of its shuffle each task replaces its own edges, a bounded
    chunk at a time, by stars around the first of their nodes in that order: what is joined inside
    a chunk goes in one round. A round's tables are written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select("a", "b"))
    kind = edges.schema["a"].dataType
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1

        def place(node: str):
            return F.struct(F.xxhash64(node, F.lit(turn)).alias("drawn"), F.col(node).alias("node"))  # noqa: B023

        placed = edges.select("a", "b", F.xxhash64("a", F.lit(turn)).alias("da"), F.xxhash64("b", F.lit(turn)).alias("db"))
        edges = stored(placed.mapInArrow(star_task, edges.schema))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("first"))
        parent = stored(first.select("node", F.least("first", place("node"))["node"].alias("parent")))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("label"))
        else:
            moved = parent.select(F.col("node").alias("label"), "parent")
            labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("parent", "label").alias("label")))
        ends = edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        ends = ends.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        edges = stored(
            ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").cast(kind).alias("label"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("smallest"))
    return labels.join(smallest, "label").select("node", F.col("smallest").alias("label"))
