"""Best-fit packing with variable capacities.

A document's tokens and an end mark are packed into training sequences of several permitted lengths. Documents longer
than the longest are cut into pieces of that length and a rest; no token is dropped. Pieces are dealt to shards by a
hash of their row; a shard is packed in one worker, longest piece first:

- best fit: a piece goes into the open bin with the least room that still holds it;
- if none does, a bin is opened. Each permitted length that holds the piece is tried out on the shard's remaining
  lengths (greedily, longest first that fits), and the one with the least cost per token filled is opened, where a bin
  costs its length plus a fixed overhead; so the lengths are optimised jointly, by what is left to fill them;
- at the end each bin is downsized to the shortest permitted length that holds its contents.

Null and empty texts are a single end mark. Ties go by doc_id (nulls last), then piece; repeated rows are packed as
rows of their own. Extra columns are not read. An empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32
#: Pieces of a shard, about.
SHARD = 8192


def estimated_tokens(text: Column) -> Column:
    """Four bytes of UTF-8 a token, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)


def _trial(length: int, capacity: int, lengths: list[int], counts: dict[int, int]) -> int:
    """Tokens that a new bin would hold: the piece, and then greedily the longest remaining that fit."""
    room = capacity - length
    at = bisect_right(lengths, room) - 1
    while at >= 0:
        x = lengths[at]
        room -= x * min(counts[x] - (x == length), room // x)
        at = min(at, bisect_right(lengths, room)) - 1
    return capacity - room


def pack_lengths(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (sizes descend, none over the largest capacity), and the final capacity of each bin."""
    capacities = tuple(sorted(capacities))
    counts: dict[int, int] = {}
    for n in sizes:
        counts[n] = counts.get(n, 0) + 1
    lengths = sorted(counts)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    open_: dict[int, list[int]] = {}
    bins, offsets, filled, caps = [], [], [], []
    for n in sizes:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            room = min(fits, key=lambda c: ((c + overhead) / _trial(n, c, lengths, counts), c))
            b = len(caps)
            caps.append(room)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        room -= n
        if room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append(b)
        counts[n] -= 1
        if not counts[n]:
            lengths.pop(bisect_left(lengths, n))
    return bins, offsets, [next(c for c in capacities if c >= f) for f in filled]


def pack(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents: doc_id, piece, piece_tokens, doc_start, bin_id, bin_offset, bin_tokens, bin_capacity."""
    tokens = estimated_tokens(F.col("text")) if tokens is None else tokens
    top = max(capacities)
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(tokens, F.lit(0)) + 1).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    pieces = sized.select("doc_id", "n", "row", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))).alias("piece", "doc_start"))
    pieces = pieces.select("doc_id", "row", F.col("piece").cast("long").alias("piece"), "doc_start", F.least(F.lit(top), F.col("n") - F.col("doc_start")).cast("long").alias("size"))
    total = sized.select(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-total // shard))
    # Rows were numbered as the lengths were written, so any number of equal rows, or of null ids, is dealt evenly.
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], na_position="last", kind="stable")
        bins, offsets, caps = pack_lengths(pdf["size"].tolist(), capacities, overhead)
        filled = np.bincount(bins, weights=pdf["size"], minlength=len(caps)).astype(np.int64)
        at, prefix = np.array(bins), int(pdf["shard"].iloc[0])
        out = pdf[["doc_id", "piece", "doc_start", "size"]].rename(columns={"size": "piece_tokens"})
        return out.assign(doc_id=out["doc_id"].astype("Int64"), bin_id=[f"{prefix}-{b}" for b in bins], bin_offset=offsets, bin_tokens=filled[at], bin_capacity=np.array(caps)[at])

    return pieces.groupBy("shard").applyInPandas(one, "doc_id long, piece long, doc_start long, piece_tokens long, bin_id string, bin_offset long, bin_tokens long, bin_capacity long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
