"""Connected components of a table of links, by alternating star operations (Kiveris et al., 2014).

Each round is two aggregations (the smallest neighbour of every node; partial
sums before the shuffle, so a node with very many links costs no more) and two
joins between saved tables, which adaptive execution may split where one node
holds very many rows. Links never reach the driver; only two sums do, to see
whether a round changed anything. Every intermediate table is written to the
shared folder, so a lost executor repeats one step only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task, batch by batch, replaced by (node, smallest node it reaches within the batch)."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = where[: len(u)], where[len(u) :]
        label = np.arange(len(nodes))
        while True:  # hook both roots to the smaller label, then shorten all paths
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while not np.array_equal(shorter := new[new], new):
                new = shorter
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: two long columns. Returns (node, component) for every node with a link; component is its smallest node.

    Nulls and links of a node to itself are left out; without links the result is empty.
    """
    first, second = links.columns[:2]
    u, v = F.col(f"`{first}`"), F.col(f"`{second}`")
    pairs = links.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where((u != v) & u.isNotNull() & v.isNotNull())
    edges = scratch.save(pairs.mapInArrow(local_forest, "u long, v long").distinct(), "links")
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if tuple(found) == state or not found["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(found)
        # large star: the larger neighbours of a node join its smallest neighbour; a node that is its own smallest keeps them
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "least")
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = scratch.save(larger.join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours join the smallest of these
        smallest = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        scratch.drop(edges, least, large, smallest)
        edges = after
