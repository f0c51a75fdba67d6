"""Line spans: merging, chunk windows, prefix sums, import-dominated blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_LINES, CHUNK_OVERLAP = 40, 10
#: Spans of a task, about: AQE puts partitions together by their compressed bytes, so that a task's sort grew with the input.
TASK_SPANS = 1 << 19
IMPORT_PENALTY, TEST_PENALTY = 0.4, 0.5


def merge_spans(spans: DataFrame, by: list[str], gap: int = 1) -> DataFrame:
    """Spans (start, end) whose start is at most the end so far plus gap become one: gaps and islands, a sort a key.

    Spans are counted and dealt by key into as many partitions as they need, so what a task sorts is bounded but for one key's.
    """
    spans = spans.repartition(max(1, -(-spans.count() // TASK_SPANS)), *by)
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    islands = spans.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    rest = [c for c in spans.columns if c not in (*by, "start", "end")]
    sums = [F.max_by(F.col(c), F.struct("score", (-F.col("start")).alias("s"))).alias(c) for c in rest if c != "score"] + ([F.max("score").alias("score")] if "score" in rest else [])
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *sums).drop("island")


def chunks(blobs: DataFrame, n_lines: Column, size: int = CHUNK_LINES, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """start_line, end_line of overlapping windows; the first that reaches the end is the last."""
    stride = max(1, size - overlap)
    last = F.greatest(F.lit(1), F.ceil((n_lines - size) / stride) * stride + 1)
    return blobs.filter(n_lines > 0).withColumn("start_line", F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long"), F.lit(stride).cast("long")))).withColumn("end_line", F.least(F.col("start_line") + size - 1, n_lines.cast("long")))


def import_line(line: Column) -> Column:
    """Whether a line brings in a module, in any of the languages known."""
    return F.rlike(line, F.lit(r"^\s*(import\b|using\s+[\w.=\s]+;|from\s+\S+\s+import\b|#include\b|require\s*\(|package\b)"))


def test_path(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit(r"(^|/)(tests?|spec|__tests__)(/|$)|_test\.|\.(test|spec)\.|tests?\.cs$"))


def running_counts(lines: DataFrame, by: str) -> DataFrame:
    """Non-blank and import lines up to and including each line."""
    w = Window.partitionBy(by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("line_text") == ""
    return lines.select(by, "line", F.sum(F.when(~blank, 1).otherwise(0)).over(w).alias("nonblank"), F.sum(F.when(import_line(F.col("line_text")), 1).otherwise(0)).over(w).alias("imports"))


def import_dominated(blocks: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """Blocks (by, start, end) with whether over 7 of 10 non-blank lines are imports, from two reads of the prefix sums."""
    to = counts.select(F.col(by).alias("b1"), F.col("line").alias("l1"), F.col("nonblank").alias("n1"), F.col("imports").alias("i1"))
    fro = counts.select(F.col(by).alias("b0"), F.col("line").alias("l0"), F.col("nonblank").alias("n0"), F.col("imports").alias("i0"))
    met = blocks.join(to, (F.col(by) == F.col("b1")) & (F.col("end") == F.col("l1"))).join(fro, (F.col(by) == F.col("b0")) & (F.col("start") - 1 == F.col("l0")), "left")
    n, i = F.col("n1") - F.coalesce("n0", F.lit(0)), F.col("i1") - F.coalesce("i0", F.lit(0))
    return met.select(*blocks.columns, n.alias("nonblank"), i.alias("imports"), (i * 10 > n * 7).alias("dominated"))


def selection_score(score: Column, dominated: Column, path: Column) -> Column:
    """A block's score after the penalties for imports and for test paths."""
    return score * F.when(dominated, IMPORT_PENALTY).otherwise(1.0) * F.when(test_path(path), TEST_PENALTY).otherwise(1.0)
