"""Connected components of links, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. A hub's rows are summed before they are shuffled; the join's hot keys AQE splits."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = both.join(least, both["u"] == least["k"])
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def local_forest(links: DataFrame) -> DataFrame:
    """Each partition's links (a, b) replaced by those of its nodes to their least node there: as many as nodes, at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = root.setdefault(y, y)
                x = root[x]
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(root)]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"], dtype="int64")

    return links.select("a", "b").mapInPandas(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) of every node in links (a, b); lone nodes are left out."""
    edges, seen = materialise(local_forest(links).distinct(), "edges"), None
    while True:
        after = materialise(_stars(_stars(edges, True), False), "edges")
        state = tuple(after.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_table(edges)
        edges = after
        if state == seen:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            return materialise(nodes, "components")
        seen = state
