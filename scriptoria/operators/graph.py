"""Connected components of a graph of text keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


#: Edges that one task takes when no more are left.
LAST_EDGES = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the smallest node of its component.

    Each round points every node at the smallest of its neighbours, or at itself, and then at what that one points at, and contracts the edges: those whose ends
    now meet go, so a large group costs its edges once. When no more than LAST_EDGES are left, one task joins their ends. Only the number of edges left reaches the driver.
    """
    both = lambda df: df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.select("a", "b").where("a <> b").distinct())
    nodes = both(edges).select(F.col("a").alias("id")).distinct()
    roots = stored(nodes.select("id", F.col("id").alias("root")))
    while edges.limit(LAST_EDGES + 1).count() > LAST_EDGES:
        low = both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to"))
        up = low.select(F.col("v").alias("w"), F.col("to").alias("top"))
        step = stored(low.join(up, F.col("to") == F.col("w")).select("v", F.col("top").alias("to")))
        at = lambda c: step.select(F.col("v").alias(f"v_{c}"), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        edges = edges.join(at("a"), F.col("a") == F.col("v_a")).join(at("b"), F.col("b") == F.col("v_b"))
        edges = stored(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct())
        roots = stored(roots.join(step, F.col("root") == F.col("v"), "left").select("id", F.coalesce("to", "root").alias("root")))
    last = edges.coalesce(1).mapInPandas(_joined_ends, "root string, last string")
    return roots.join(F.broadcast(last), "root", "left").select("id", F.coalesce("last", "root").alias("root"))  # two rows for each of LAST_EDGES at most


def _joined_ends(batches):
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for one, two in b.itertuples(index=False):
            low, high = sorted((top(one), top(two)))
            up[high] = low
    yield pd.DataFrame({"root": list(up), "last": [top(x) for x in up]}, dtype=object)
