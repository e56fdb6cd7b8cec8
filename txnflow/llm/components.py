"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Each step replaces links by links to the smallest node around, so that no node gathers its neighbours: the smallest is an
aggregate, combined before the shuffle, and a node of very many links meets it in a join that adaptive execution can split.
Every round is written to the shared folder, so that a lost executor costs one round at most, and takes the place of the one before. Before the
first round each task contracts its own links, some at a time, to a forest.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.workspace import job_scope, materialize, release

#: Links a task contracts at once.
AT_ONCE = 1 << 18


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index that each of 0 .. n-1 is linked to by the pairs (u, v)."""
    roots = np.arange(n)
    while True:
        a, b = roots[u], roots[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return roots
        np.minimum.at(roots, high, low)
        while (roots[roots] != roots).any():
            roots = roots[roots]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) with the same components, of each task's nodes only those to their least one, and links to itself."""
    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emptied() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(len(nodes), place[:len(u)], place[len(u):])])], ["u", "v"])

        for batch in stream:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= AT_ONCE:
                yield emptied()
        if held:
            yield emptied()

    return links.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v").mapInArrow(batches, "u bigint, v bigint")


def _to_least(arcs: DataFrame) -> DataFrame:
    """Each arc (u, v) with ``m``, the least of u and of all v it leads to."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return arcs.join(least, "u")


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component (its least reachable node) for every node of ``links`` (u, v); links to itself only name the node.

    Nodes without a link aren't listed. Repeated links and either direction are the same.
    """
    with job_scope(links.sparkSession) as scope:
        return scope.keep(_settled(links, max_rounds), "components")


def _settled(links: DataFrame, max_rounds: int) -> DataFrame:
    ends = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    known = materialize(contracted(links).select(ends("u", "v").alias("x")).select("x.u", "x.v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # Large star: the larger neighbours of a node move to the least node around it.
        both = known.union(known.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Nodes that are the least around them keep a link to themselves.
        large = large.union(known.where("u = v")).distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        starred = _to_least(large)
        small = (starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(starred.select("u", F.col("m").alias("v"))).distinct())
        earlier, known = known, materialize(small, "links")
        release(earlier)
        state = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return known.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = state
    raise RuntimeError(f"links didn't settle in {max_rounds} rounds")
