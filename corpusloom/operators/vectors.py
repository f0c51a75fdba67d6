"""The vector store: all-pairs top-k, locality-sensitive candidates, quantised scores, reuse by content key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, quantised
from ..sources.shared import materialise

TOP_K, THRESHOLD = 5, 0.60
TABLES, BITS = 8, 8
#: Vectors up to which the reference compares all pairs.
EXACT_LIMIT = 4096
#: Vectors of a block of buckets; a pair of blocks is one matrix product.
BLOCK = 2048
#: All pairs: vectors of a block at most, blocks that are sought where they would be larger than LEAST, rows of one product.
MOST, SOUGHT, LEAST, ROWS = 16384, 24, 1024, 1024


def similar(vectors: DataFrame, k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, other_id, cosine: each vector's k most alike at or over the threshold, exactly.

    Vectors are dealt into blocks of one packed row each, written once. Every block meets every block by a product of the
    written rows, which shuffles nothing; pairs of blocks are products in single precision, whose bounded error is allowed
    for, and the few pairs of vectors that may be among the k best are taken again in double precision. n^2 products are
    what exactness costs; similar_lsh is the way beyond.
    """
    whole = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    n = whole.count()
    blocks = max(1, -(-n // MOST), min(SOUGHT, -(-n // LEAST)))
    packed = materialise(whole.repartition(blocks).mapInArrow(_packer(), "ids binary, vs binary"), "vectors")
    other = packed.select(F.col("ids").alias("other_ids"), F.col("vs").alias("ws"))
    met = packed.join(other.hint("shuffle_replicate_nl"))
    return _best(met.mapInArrow(searcher(k, threshold), "vec_id long, other_id long, cosine double"), k)


def _packer():
    """Workers get the functions by value and need not have this package."""

    def pack(batches):
        """The vectors of a partition as rows (ids, vs) of up to MOST vectors."""
        import pyarrow as pa

        def row(ids, vs):
            return pa.RecordBatch.from_pydict({"ids": [np.concatenate(ids).tobytes()], "vs": [np.concatenate(vs).tobytes()]}, pa.schema([("ids", pa.binary()), ("vs", pa.binary())]))

        ids, vs, n, dims = [], [], 0, None
        for batch in batches:
            for at in range(0, len(batch), MOST):
                part = batch.slice(at, MOST)
                flat, lengths = part.column(1).flatten(), np.unique(part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                if flat.null_count or len(lengths) != 1 or dims not in (None, lengths[0]):
                    raise ValueError("vectors differ in length or have null elements")
                dims = lengths[0]
                if n + len(part) > MOST:
                    yield row(ids, vs)
                    ids, vs, n = [], [], 0
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                vs.append(flat.to_numpy(zero_copy_only=False))
                n += len(part)
        if n:
            yield row(ids, vs)

    return pack


def searcher(k: int, threshold: float):
    """A function over Arrow batches of (ids, vs, other_ids, ws), blocks that meet. As _packer(), by value."""

    def first(ids: np.ndarray, others: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first k rows of each id by cosine, then the lower other id."""
        order = np.lexsort((others, -cosines, ids))
        ids, others, cosines = ids[order], others[order], cosines[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        return ids[place < k], others[place < k], cosines[place < k]

    def nearest(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, others, cosines: for each row of a the k rows of b most alike at or over the threshold, but for rows of its own id.

        The k-th largest of the maxima of disjoint parts of a row is at most its k-th largest; whatever is less by more than
        the error of single precision and of rounding is none of the k best.
        """
        b32 = b.astype(np.float32)
        longest = float(np.sqrt(np.einsum("ij,ij->i", a, a).max() * np.einsum("ij,ij->i", b, b).max()))
        if not longest < 1e30:
            raise ValueError("vectors are too long, or not numbers")
        slack = 1e-6 + 4 * (a.shape[1] + 2) * 2.0**-24 * longest
        twins = np.isin(ia, ib)
        width = max(1, len(ib) // (8 * k))
        parts = np.arange(0, len(ib), width)
        out = [], [], []
        for at in range(0, len(ia), ROWS):
            own = ia[at : at + ROWS]
            s = a[at : at + ROWS].astype(np.float32) @ b32.T
            for i in np.flatnonzero(twins[at : at + ROWS]):
                s[i, ib == own[i]] = -np.inf
            cut = np.full(len(own), threshold - slack)
            if len(parts) > k:
                most = np.stack([s[:, p : p + width].max(axis=1) for p in parts], axis=1)
                cut = np.maximum(cut, np.partition(most, len(parts) - k, axis=1)[:, len(parts) - k].astype(np.float64) - 2 * slack)
            r, c = np.divmod(np.flatnonzero(s >= np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None]), len(ib))
            exact = np.empty(len(r))
            for p in range(0, len(r), 1 << 16):  # the rows of so many pairs at a time
                exact[p : p + (1 << 16)] = np.einsum("ij,ij->i", a[at + r[p : p + (1 << 16)]], b[c[p : p + (1 << 16)]])
            exact = np.round(exact, 6)
            keep = (exact >= threshold) & (own[r] != ib[c])
            for x, y in zip(out, first(own[r[keep]], ib[c[keep]], exact[keep]), strict=True):
                x.append(y)
        return tuple(map(np.concatenate, out))

    def of(batches):
        import pyarrow as pa

        def row(best):
            return pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["vec_id", "other_id", "cosine"])

        held, best = None, None  # neighbouring rows of one block have one result
        for batch in batches:
            for ids, vs, other, ws in zip(*batch.columns, strict=True):
                ia, ib = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, other))
                a, b = (np.frombuffer(x.as_buffer(), np.float64).reshape(len(i), -1) for x, i in ((vs, ia), (ws, ib)))
                found = nearest(ia, a, ib, b)
                if held == (key := ids.as_py()):
                    best = first(*(np.concatenate(x) for x in zip(best, found, strict=True)))
                    continue
                if best:
                    yield row(best)
                held, best = key, found
        if best:
            yield row(best)

    return of


def _products(met: DataFrame, k: int, threshold: float, both: bool = False) -> DataFrame:
    """vec_id, other_id, cosine: for each row of packed blocks (vs, ws) the k best of ws for each of vs; both: and of vs for each of ws."""

    def product(batches):
        import pandas as pd

        for pdf in batches:
            for vs, ws in zip(pdf["vs"], pdf["ws"], strict=True):
                a, b = (np.array([v["embedding"] for v in x], np.float64) for x in (vs, ws))
                ia, ib = (np.array([v["vec_id"] for v in x]) for x in (vs, ws))
                s = np.round(a @ b.T, 6)
                s[ia[:, None] == ib[None, :]] = -2
                out = []
                for own, other, scores in [(ia, ib, s), (ib, ia, s.T)] if both else [(ia, ib, s)]:
                    for i in np.flatnonzero((scores >= threshold).any(axis=1)):
                        row = scores[i]
                        at = np.flatnonzero(row >= threshold)
                        at = at[np.lexsort((other[at], -row[at]))][:k]
                        out.append(pd.DataFrame({"vec_id": own[i], "other_id": other[at], "cosine": row[at]}))
                yield pd.concat(out) if out else pd.DataFrame({"vec_id": [], "other_id": [], "cosine": []})

    return met.select("vs", "ws").mapInPandas(product, "vec_id long, other_id long, cosine double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def planes(dims: int, tables: int = TABLES, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """Random hyperplanes: tables x bits x dims."""
    return np.random.default_rng(seed).normal(size=(tables, bits, dims))


def signatures(v: Column, dims: int) -> Column:
    """A bucket number for each table: the sides of its hyperplanes on which the vector lies."""
    out = []
    for t in planes(dims):
        bits = [F.when(dot(v, F.array(*[F.lit(float(x)) for x in p])) >= 0, 1 << b).otherwise(0) for b, p in enumerate(t)]
        out.append(sum(bits[1:], bits[0]))
    return F.array(*out)


def similar_lsh(vectors: DataFrame, dims: int, k: int = TOP_K, threshold: float = THRESHOLD, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """As similar(), and by it up to exact_limit vectors; beyond, approximate: for pairs whose buckets in some table differ
    in one side at most. A pair at the threshold of 0.60 meets with probability 0.91, a nearer one more often.

    Buckets are packed in blocks; a pair of blocks is one product, as in similar(). About a quarter of all pairs of
    vectors at random meet in some table.
    """
    if vectors.limit(exact_limit + 1).count() <= exact_limit:
        return similar(vectors, k, threshold)
    keyed = vectors.select("vec_id", "embedding", F.posexplode(signatures(F.col("embedding"), dims)).alias("t", "bucket"))
    sizes = keyed.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = keyed.join(F.broadcast(sizes), ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    packed = dealt.groupBy("t", "bucket", "block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("vs"))
    # the bucket itself, and those with one of its set bits cleared: of two neighbours one has the bit
    near = [F.col("bucket"), *[F.when(F.col("bucket").bitwiseAND(F.lit(1 << b)) != 0, F.col("bucket") - (1 << b)) for b in range(BITS)]]
    left = packed.withColumn("to", F.explode(F.array_compact(F.array(*near)))).withColumnRenamed("block", "own")
    other = packed.select("t", F.col("bucket").alias("to"), F.col("block").alias("there"), F.col("vs").alias("ws"))
    met = left.join(other, ["t", "to"]).filter("to <> bucket OR own <= there")
    return _best(_products(met, k, threshold, both=True).dropDuplicates(["vec_id", "other_id"]), k)


def quantised_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """vec_id, scale, exact and quantised cosine with a query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    codes, scale = quantised(F.col("embedding"))
    rows = vectors.select("vec_id", "embedding", codes.alias("codes"), scale.alias("scale"))
    return rows.select("vec_id", F.round("scale", 9).alias("scale"), F.round(dot(F.col("embedding"), q), 6).alias("exact"), F.round(dot(F.col("codes"), q) * F.col("scale"), 6).alias("quantised"))


def reused(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks with the stored vector of their content key; where it is null, the text has to be embedded."""
    return chunks.join(stored, "chunk_key", "left")


def integrity(vectors: DataFrame, dims: int) -> DataFrame:
    """One row: vectors, those of a wrong length, repeated ids."""
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != dims).alias("wrong_length"), (F.count(F.lit(1)) - F.count_distinct("vec_id")).alias("repeated_ids"))
