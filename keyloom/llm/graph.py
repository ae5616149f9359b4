"""Connected components of an edge table: by one task if it is small, else by alternating stars; nothing but counts comes to
the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Parts that a hub's neighbours are dealt to.
SALT = 64
#: Edges that one task joins (some 100 bytes each): the rounds of larger tables each shuffle a few times, which takes seconds for a handful of edges.
FEW = 1_000_000


def components(edges: DataFrame, clean: bool = False) -> DataFrame:
    """node, component (least node that it is connected with) of all nodes of edges (a, b), longs or
    binaries. clean: edges is a written table of distinct edges with a < b.

    Of more than FEW edges, each round hangs a node's smaller neighbours, and then its larger ones, on the least of them. When no node has
    two parents, or a parent that itself has one, the stars are the components: after about log(longest path) rounds.
    Neighbours meet their hub in SALT parts, however many there are."""
    salted = lambda df, c: df.withColumn("s", F.pmod(F.xxhash64(c), F.lit(SALT)).cast("int"))
    pair = lambda m, a, b: F.explode(F.array(F.struct(m.alias("m"), F.col(b).alias("x")), F.struct(m.alias("m"), F.col(a).alias("x")))).alias("e")
    if not clean:
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.count() <= FEW:
        return _of_few(edges)
    while True:
        own = salted(edges, "a")
        least = own.groupBy("b", "s").agg(F.min("a").alias("m")).groupBy("b").agg(F.min("m").alias("m"), F.collect_set("s").alias("all"))
        small = own.join(least.select("b", "m", F.explode("all").alias("s")), ["b", "s"]).select(pair(F.col("m"), "a", "b"))
        small = written(small.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").distinct())
        least = small.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        own = salted(small, "b")
        parts = own.select("a", "s").distinct().join(least.select("a", "m"), "a")
        up = written(own.join(parts, ["a", "s"], "left").select("a", "b", "m"))
        if up.where("m is not null").isEmpty() and least.where("n > 1").isEmpty():  # one parent each, and that is a root
            return small.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(small.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        large = up.select(pair(F.coalesce("m", "a"), "a", "b"))
        edges = written(large.select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _of_few(edges: DataFrame) -> DataFrame:
    """components() of edges that fit into one task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["a"], b["b"]) for b in it if b.num_rows]
        if not held:
            return
        coded = pa.concat_arrays([side for sides in zip(*held, strict=True) for side in sides]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        a, b = rank[coded.indices.to_numpy()].reshape(2, -1)
        nodes = coded.dictionary.take(order)
        found = pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(least_linked(a, b, len(nodes))))], ["node", "component"])
        yield from (found.slice(i, 10_000) for i in range(0, len(nodes), 10_000))

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of the numbers below n, the least that each is connected with by edges (a, b). Each round hangs every root on the least
    root beside it; of those that are left after two rounds each took another one, so about 2 log(n) rounds do."""
    label = np.arange(n)
    while len(a):
        sides = label[a], label[b]
        low = np.minimum(*sides)
        for side in sides:
            np.minimum.at(label, side, low)
        while (label != (up := label[label])).any():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
