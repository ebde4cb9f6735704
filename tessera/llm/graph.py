"""Connected components of a link table, labelled by the smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_heavy, written

#: Links that one task may hold (16 bytes each); larger graphs are first contracted by stars.
TASK_LINKS = 2_000_000


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 by the links a[i]-b[i]."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):  # a parent is smaller, so it is final already
        parent[i] = parent[p]
    return np.asarray(parent, dtype=np.int64)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = union_find(at[: len(u)], at[len(u) :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _star(links: DataFrame, total: int, large: bool) -> DataFrame:
    """One large-star or small-star step over links (u, v) with u > v."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    low = written(
        both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"),
        "star",
    )
    near = join_heavy(both, low, "u", F.col("v"), total * (2 if large else 1))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
    out = written(out.where("u != v").distinct(), "links")
    drop(low)
    return out


def components(links: DataFrame, a: str, b: str, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of every node that has a link to another; component is its smallest node.

    Null ends and self-links are left out; repeated links count once. Alternating
    star steps contract the graph in the cluster, each written to the shared folder,
    until either every link points to its root or what is left fits one task.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "links")
    while (total := now.count()) > task_links:
        wide = _star(now, total, True)
        slim = _star(wide, wide.count(), False)
        still = slim.exceptAll(now).isEmpty() and slim.count() == total
        drop(now, wide)
        now = slim
        if still:  # all links are (node, root)
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return written(now.coalesce(1).mapInArrow(_finish, "node long, component long"), "components")
