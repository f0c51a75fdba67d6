"""Exact dedup by a minimal perfect hash over historical distinct digests.

Digests of the history are dealt to buckets by their leading bits. Each bucket gets a minimal perfect hash of the
multi-level kind: at a level every remaining digest is hashed to a bit array; a digest alone on its bit takes it, the
others go on to the next level. The rank of its bit is a digest's slot; the slot holds the full digest and the
locator of the winner so far. A later digest that hashes to a slot is a member only if all its bytes equal the slot's,
so no false positive is possible; nonmembers are grouped separately, by digest.

Rows are aggregated by digest before they meet a bucket, so a hot group of copies costs one row per task, and buckets
hold distinct digests only, which spread evenly.

Null texts count as empty, and all empty texts are one group. A null doc_id sorts after every other. Repeated rows
(equal doc_id and text) belong to one group and one of them alone is kept. Extra columns pass through untouched; the operator
reads doc_id and text alone, so columns of any other name cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table

#: Distinct digests of a bucket, about; a bucket is built and probed in one Python worker.
BUCKET = 16_384
LEVELS = 40
GAMMA = 2.0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _at_level(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest at a level. words: digests as rows of four 64-bit words."""
    seed = np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return (_mix(words[:, 1] ^ _mix(words[:, 2] + seed)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests; slots hold the digests and rows of locators."""

    def __init__(self, sizes: list[int], bits: np.ndarray, digests: np.ndarray):
        self.sizes, self.bits, self.digests = sizes, bits, digests
        self.ranks = np.cumsum(bits) - bits
        self.overflow: dict[bytes, int] = {}
        for i in range(int(bits.sum()), len(digests)):
            self.overflow[digests[i].tobytes()] = i

    @staticmethod
    def build(digests: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the order in which the digests (n x 32 bytes, distinct) fill the slots."""
        words = np.ascontiguousarray(digests).view(">u8").astype(np.uint64).reshape(len(digests), 4)
        left, sizes, levels, order = np.arange(len(digests)), [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = int(len(left) * GAMMA) + 1
            at = _at_level(words[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            levels.append(alone)
            sizes.append(size)
            order.append(left[own][np.argsort(at[own], kind="stable")])
            left = left[~own]
        order = np.concatenate([*order, left]) if order or len(left) else np.zeros(0, np.int64)
        bits = np.concatenate(levels).astype(np.int64) if levels else np.zeros(0, np.int64)
        return PerfectHash(sizes, bits, digests[order]), order

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, or -1 where the slot's bytes differ."""
        slots, base = np.full(len(digests), -1, np.int64), 0
        if not len(digests):
            return slots
        words = np.ascontiguousarray(digests).view(">u8").astype(np.uint64).reshape(len(digests), 4)
        left = np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            at = base + _at_level(words[left], level, size)
            hit = self.bits[at] == 1
            found, slot = left[hit], self.ranks[at[hit]]
            same = (self.digests[slot] == digests[found]).all(axis=1)
            slots[found[same]] = slot[same]
            left, base = left[~hit], base + size
        for i in left if self.overflow else ():
            slots[i] = self.overflow.get(digests[i].tobytes(), -1)
        return slots


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


INDEX = "bucket int, n long, sizes array<long>, bits binary, digests binary, best_len binary, best_id binary, best_row binary, rows binary"


def grouped(rows: DataFrame) -> DataFrame:
    """Distinct digests with their best row and number of rows. Partial sums make a hot group one row per task."""
    # neg sorts the longest first and, of one length, null ids last: it is even for others
    neg = F.when(F.col("doc_id").isNull(), 1).otherwise(0) - 2 * F.col("len")
    best = F.struct(neg.alias("neg"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("row").alias("row"))
    return rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("rows")).select("digest", F.col("best.neg").alias("neg"), F.col("best.id").alias("id"), F.col("best.row").alias("row"), "rows")


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return groups.withColumn("bucket", (lead % buckets).cast("int"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the perfect hash and its slots. history: as grouped() gives it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mph, order = PerfectHash.build(_bytes(pdf["digest"]))
        pdf = pdf.iloc[order]
        column = lambda name: pdf[name].to_numpy(np.int64).tobytes()
        return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0], "n": len(pdf), "sizes": mph.sizes, "bits": np.packbits(mph.bits.astype(bool)).tobytes(), "digests": mph.digests.tobytes(), "best_len": column("neg"), "best_id": column("id"), "best_row": column("row"), "rows": column("rows")}])

    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(one, INDEX)


def merge(index: DataFrame, later: DataFrame, buckets: int) -> DataFrame:
    """Final groups (digest, neg, id, rows, known): members of the history joined with their slot, nonmembers by themselves."""

    def one(slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        digests = _bytes(new["digest"]) if len(new) else np.zeros((0, 32), np.uint8)
        neg, ids, row_ids, rows = (new[c].to_numpy(np.int64).copy() for c in ("neg", "id", "row", "rows"))
        if not len(slots):
            return pd.DataFrame({"digest": list(new["digest"]), "neg": neg, "id": ids, "row": row_ids, "rows": rows, "known": False})
        row = slots.iloc[0]
        n, sizes = int(row["n"]), [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(np.int64)
        mph = PerfectHash(sizes, bits, np.frombuffer(row["digests"], np.uint8).reshape(n, 32))
        old_neg, old_id, old_row, old_rows = (np.frombuffer(row[c], np.int64).copy() for c in ("best_len", "best_id", "best_row", "rows"))
        slot = mph.lookup(digests)
        member = np.flatnonzero(slot >= 0)
        at = slot[member]
        better = (neg[member] < old_neg[at]) | ((neg[member] == old_neg[at]) & (ids[member] < old_id[at]))
        old_rows[at] += rows[member]
        for old, mine in ((old_neg, neg), (old_id, ids), (old_row, row_ids)):
            old[at[better]] = mine[member][better]
        other = np.flatnonzero(slot < 0)
        out = [pd.DataFrame({"digest": [d.tobytes() for d in mph.digests], "neg": old_neg, "id": old_id, "row": old_row, "rows": old_rows, "known": True})]
        if len(other):
            out.append(pd.DataFrame({"digest": [digests[i].tobytes() for i in other], "neg": neg[other], "id": ids[other], "row": row_ids[other], "rows": rows[other], "known": False}))
        return pd.concat(out)

    later = _bucketed(later, buckets)
    return index.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInPandas(one, "digest binary, neg long, id long, row long, rows long, known boolean")


def exact_dedup(docs: DataFrame, is_history: Column | None = None, bucket: int = BUCKET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_history, n_points (code points) of every row of docs.

    is_history marks the rows of earlier batches, over which the perfect hash is built (default: the even half by a
    hash of doc_id, so that one table passes through both paths). Every row takes part and the result does not depend
    on the mark. Of equal normalised texts the row with the most code points, then the smallest doc_id, stays.
    """
    is_history = F.xxhash64("doc_id") % 2 == 0 if is_history is None else is_history
    narrow = materialise(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"), F.coalesce(is_history, F.lit(False)).alias("old"), F.monotonically_increasing_id().alias("row")), "digests")
    history = materialise(grouped(narrow.filter("old")), "history")
    buckets = max(16, -(-history.count() // bucket))
    index = materialise(build_index(history, buckets), "index")
    return _labelled(narrow, materialise(merge(index, grouped(narrow.filter("NOT old")), buckets), "groups"))


def _labelled(narrow: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per input row. The join's hot keys are split by AQE: its other side has one row per digest.

    Rows were numbered as the narrow table was written, so of repeated rows of a winner one alone is kept.
    """
    groups = groups.select(F.col("digest").alias("key"), "neg", "id", F.col("row").alias("best_row"), F.col("rows").alias("group_size"), "known")
    rows = narrow.join(groups, narrow["digest"] == groups["key"])
    return rows.select("doc_id", F.when(F.pmod("neg", F.lit(2)) == 0, F.col("id")).alias("keep_id"), "group_size", (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("known").alias("in_history"), F.col("len").alias("n_points"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    kept = materialise(exact_dedup(docs, **options).filter("kept").select("doc_id", "text_sha256", "n_points"), "kept")
    sha, size = fresh("sha", docs.columns), fresh("size", docs.columns)
    keyed = docs.withColumns({sha: F.sha2(normalised(F.col("text")).cast("binary"), 256), size: F.length(F.coalesce("text", F.lit(""))).cast("long")})
    same = keyed["doc_id"].eqNullSafe(kept["doc_id"]) & (keyed[sha] == kept["text_sha256"]) & (keyed[size] == kept["n_points"])
    # what is left of an id, a text and a length are repeated rows, or such as differ in the kind of white space: one stays
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha, size]).select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("in_history", "n_points")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
