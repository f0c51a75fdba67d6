"""Refresh by content: snapshot deltas, carried rows, and the test that a refresh equals a full build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: str, state: str, failed: DataFrame | None = None) -> DataFrame:
    """key, change: added, removed, changed or same; keys that could not be read (failed) are carried forward."""
    o, n = old.select(F.col(key).alias("k0"), F.col(state).alias("s0")), new.select(F.col(key).alias("k1"), F.col(state).alias("s1"))
    met = o.join(n, F.col("k0") == F.col("k1"), "full_outer").withColumn(key, F.coalesce("k0", "k1"))
    change = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(F.col("s0").eqNullSafe(F.col("s1")), "same").otherwise("changed")
    out = met.select(key, change.alias("change"))
    if failed is not None:
        out = out.join(failed.select(F.col(key).alias("kf")), F.col(key) == F.col("kf"), "left").select(key, F.when(F.col("kf").isNotNull() & (F.col("change") == "removed"), "carried").otherwise(F.col("change")).alias("change"))
    return out


def refreshed(results: DataFrame, recomputed: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """Old results of clean keys and the recomputed ones of dirty keys."""
    return results.join(dirty.select(key).distinct(), key, "left_anti").unionByName(recomputed)


def verdict(expected: DataFrame, got: DataFrame) -> DataFrame:
    """One row: rows missing and rows too many, and OK, UNDER, OVER or BOTH."""
    missing = expected.exceptAll(got).agg(F.count(F.lit(1)).alias("missing"))
    extra = got.exceptAll(expected).agg(F.count(F.lit(1)).alias("extra"))
    return missing.crossJoin(extra).withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "OK").when(F.col("extra") == 0, "UNDER").when(F.col("missing") == 0, "OVER").otherwise("BOTH"))  # one row each


def reconcile(managed: DataFrame, remote: DataFrame) -> DataFrame:
    """project, action: add, update, move, keep or missing. managed: project, path, head; remote alike."""
    m, r = managed.select("project", F.col("path").alias("p0"), F.col("head").alias("h0"), F.lit(True).alias("m")), remote.select("project", F.col("path").alias("p1"), F.col("head").alias("h1"), F.lit(True).alias("r"))
    met = m.join(r, "project", "full_outer")
    action = F.when(F.col("m").isNull(), "add").when(F.col("r").isNull(), "missing").when(F.col("p0") != F.col("p1"), "move").when(~F.col("h0").eqNullSafe(F.col("h1")), "update").otherwise("keep")
    return met.select("project", action.alias("action"))


def merged_identity(left: dict, right: dict) -> dict:
    """The identity of an answer from two snapshots (corpus, graph_corpus, generation, build, blobs, unanchored, cacheable).

    The first corpus stands; another beside it is the graph's. What the right one knows of the graph goes before. With
    two different corpora, or paths without a blob, the answer must not be cached.
    """
    out = {k: right.get(k) or left.get(k) for k in ("graph_corpus", "generation", "build")}
    out["corpus"] = left.get("corpus") or right.get("corpus")
    other = right.get("corpus")
    if not right.get("graph_corpus") and other and other != out["corpus"]:
        out["graph_corpus"] = other
    for k in ("blobs", "unanchored"):
        out[k] = sorted({*left.get(k, ()), *right.get(k, ())})
    conflict = bool(out["corpus"] and out["graph_corpus"] and out["corpus"] != out["graph_corpus"])
    out["cacheable"] = bool(left.get("cacheable") and right.get("cacheable") and not conflict and not out["unanchored"])
    return out
