"""Union-find over links that no single task holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.session import staged


def _local_forest(batches):
    """Union-find with path halving over the links of one task; gives (child, parent) for every node that is no root."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for batch in batches:
        for a, b in zip(batch["child"].tolist(), batch["parent"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at: at + 100_000]
        yield pd.DataFrame({"child": np.array(part, np.int64), "parent": np.array([root(x) for x in part], np.int64)})


def components(links: DataFrame, folder: str, name: str, rounds: int = 60, native: bool = False) -> DataFrame:
    """(id, component_id) for every id of the links (a, b); component_id is the smallest id that can be reached.

    Each round merges links inside tasks by union-find, then hooks every node's neighbours to its smallest one (large star)
    and its parents to their smallest one (small star), until every link points at a root. Rounds are stored, so a lost
    executor costs one round; their number grows with the logarithm of the longest chain. ``native`` leaves out the merging
    inside tasks, which is Python; ids may then be of any type that has an order.
    """
    edges = links.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).filter("child > parent")
    for k in range(rounds):
        forest = edges if native else edges.select(F.col("child").cast("long"), F.col("parent").cast("long")).mapInPandas(_local_forest, "child long, parent long")
        both = forest.unionByName(forest.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        low = both.groupBy("child").agg(F.min("parent").alias("m")).select(F.col("child").alias("u"), F.least("child", "m").alias("m"))
        large = both.join(low, both["child"] == low["u"]).filter("parent > u").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(least, "child").select(F.explode(F.array(F.struct(F.col("child"), F.col("m").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("m").alias("parent")))).alias("e"))
        edges = staged(small.select("e.*").filter("child > parent").distinct(), folder, f"{name}-{k}")
        # Done when every node has one parent and no parent has one.
        several = edges.groupBy("child").count().filter("count > 1").select("child")
        inner = edges.select("child").join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        if several.unionByName(inner).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("child").alias("id"), F.col("parent").alias("component_id"))
