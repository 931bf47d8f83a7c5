"""Connected components of a distributed list of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored_compact as stored


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the smallest node that it can reach.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by pointer jumping, and contracts the
    edges; the number of nodes with edges at least halves in a round. Each step is a table in the shared folder.
    """
    edges = edges.where("u <> v").select("u", "v")
    edges = stored(edges.union(edges.select("v", "u")).distinct(), folder, f"{name}-edges")
    roots, k = None, 0
    while not edges.isEmpty():
        k += 1
        parent = edges.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        parent, jump = stored(parent, folder, f"{name}-{k}-hook"), 0
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jump += 1
            parent = stored(parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved")), folder, f"{name}-{k}-jump-{jump}")
            if parent.where("moved").isEmpty():
                break
            parent = parent.select("u", "p")
        parent = parent.select("u", "p")
        if roots is None:
            roots = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = stored(roots.join(parent.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), folder, f"{name}-{k}-roots")
        edges = edges.join(parent.withColumnRenamed("p", "pu"), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        edges = stored(edges.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), folder, f"{name}-{k}-edges")
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
