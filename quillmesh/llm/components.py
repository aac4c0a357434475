"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, materialize

#: Links that one task settles in its memory; more are brought together by rounds of stars. The result is the same.
FEW = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a partition's links but the least one of its component, and that one."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    both = pa.chunked_array([*(b.column(0) for b in held), *(b.column(1) for b in held)]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, v = np.split(rank[both.indices.to_numpy()], 2)
    root = np.arange(len(order))
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(len(order)))
    names = both.dictionary
    yield pa.RecordBatch.from_arrays([names.take(pa.array(order[at])), names.take(pa.array(order[root[at]]))], names=["u", "v"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) to (node, root): the least node of each component, for every node but roots themselves.

    A node's neighbours are never gathered: each round takes minima (with partial aggregation) and joins them
    back, so that a node with a large part of all links is as cheap as its rows. Each round's edges are a written
    table. FEW links or fewer need no rounds. Nulls are no nodes; repeated links and links of a node to itself change
    nothing.
    """
    kind = links.schema["u"].dataType.simpleString()
    if links.count() <= FEW:
        few = links.select("u", "v").where("u <> v").coalesce(1).mapInArrow(K.give_back(_forest), f"u {kind}, v {kind}")
        return materialize(few, "stars").toDF("node", "root")
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written tables: a join with one can be split where a node has very many links
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")  # v is smaller than u
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _state(small)
        discard(least, large, low, edges)
        edges = small
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
