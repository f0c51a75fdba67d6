"""A kept index: gram postings for search, token postings for ranking, written once and read by key.

Postings are lists by segment, the texts that a task reads in one go: each task writes its segments sorted by gram or term, so
no pair of key and text is shuffled, and the keys of a query, pushed to the Parquet scan, leave out the pages without them. Grams are three bytes, in hex. An index without a path lies in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regexplan
from ..sources.shared import materialise
from . import grep, rank


@dataclass(frozen=True)
class GramIndex:
    """counts: gram, df, kept (all grams of the corpus); postings: gram, segment, blobs (of kept grams; places in the segment's
    names); names: segment, names (blob_sha)."""

    counts: DataFrame
    postings: DataFrame
    names: DataFrame


@dataclass(frozen=True)
class TokenIndex:
    """postings: term, docs (doc_id, dl, tf of a segment), and a row a segment without a term, of all its documents; stats: n, avgdl."""

    postings: DataFrame
    stats: DataFrame


def _stored(df: DataFrame, path: str | None, name: str) -> DataFrame:
    if path is None:
        return materialise(df, name)
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def blob_grams(content: Column) -> Column:
    """The distinct grams of a text: pieces of three bytes from each of the first three bytes on, in one pass each."""
    data = F.hex(content.cast("binary"))
    cut = [F.regexp_extract_all(F.substring(data, 1 + 2 * i, 2147483647), F.lit(r"(.{6})"), 1) for i in range(3)]
    return F.array_distinct(F.concat(*cut))


def gram_counts(pairs: DataFrame, n_blobs: int, fraction: float) -> DataFrame:
    """gram, df, kept: a gram is kept if at most that fraction (of 0 to 1) of the blobs have it. pairs: gram, blob_sha."""
    return _policy(pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), n_blobs, fraction)


def _policy(df: DataFrame, n_blobs: int, fraction: float) -> DataFrame:
    most = min(1.0, max(0.0, fraction)) * n_blobs
    return df.withColumn("kept", F.col("df") <= F.lit(most))


#: Bytes of a segment, unless one text has more, and its texts, at most.
SEGMENT_BYTES, SEGMENT_TEXTS = 8 << 20, 1 << 14
#: Grams left out that are sent to the postings at once: six characters each.
FEW = 200_000


def _segments(most_bytes: int, most_texts: int):
    """Arrow batches of (blob_sha, content in bytes) as rows (segment, gram, blobs, names): a row a segment and gram, sorted,
    and one with the names. Workers get the function by value and need not have this package."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        digits = np.frombuffer(b"0123456789ABCDEF", np.uint8)
        columns = pa.schema([("segment", pa.int64()), ("gram", pa.string()), ("blobs", pa.list_(pa.int16())), ("names", pa.list_(pa.string()))])
        base, names, keys, n_bytes, made = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def rows():
            segment = base + made
            found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            grams, blobs = (found >> np.uint64(16)).astype(np.uint32), (found & np.uint64(0xFFFF)).astype(np.int16)
            starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            own = grams[starts]
            text = digits[np.stack([(own >> shift) & 15 for shift in (20, 16, 12, 8, 4, 0)], axis=1)]
            gram = pa.StringArray.from_buffers(len(own), pa.py_buffer((np.arange(len(own) + 1) * 6).astype(np.int32).tobytes()), pa.py_buffer(text.tobytes()))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(grams)].astype(np.int32)), pa.array(blobs))
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.nulls(1, pa.string()), pa.nulls(1, columns.field("blobs").type), pa.array([names], columns.field("names").type)], schema=columns)
            for at in range(0, len(own), 10_000):
                part = slice(at, min(at + 10_000, len(own)))
                m = part.stop - at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, segment)), gram.slice(at, m), lists.slice(at, m), pa.nulls(m, columns.field("names").type)], schema=columns)

        for batch in batches:
            for sha, content in zip(*batch.columns, strict=True):
                data = np.frombuffer(content.as_py() or b"", np.uint8)
                if names and (n_bytes + len(data) > most_bytes or len(names) >= most_texts):
                    yield from rows()
                    names, keys, n_bytes, made = [], [], 0, made + 1
                for at in range(0, len(data) - 2, most_bytes):
                    piece = data[at : at + most_bytes + 2].astype(np.uint64)
                    key = piece[:-2] << np.uint64(32) | piece[1:-1] << np.uint64(24) | piece[2:] << np.uint64(16) | np.uint64(len(names))
                    keys.append(key if len(data) <= most_bytes else np.unique(key))
                names.append(sha.as_py())
                n_bytes += len(data)
        if names:
            yield from rows()

    return cut


def build_grams(blobs: DataFrame, fraction: float = 1.0, path: str | None = None) -> GramIndex:
    """The gram index of blobs (blob_sha, content)."""
    cut = _segments(SEGMENT_BYTES, SEGMENT_TEXTS)
    rows = materialise(blobs.select("blob_sha", F.col("content").cast("binary")).mapInArrow(cut, "segment long, gram string, blobs array<short>, names array<string>"), "segments")
    names = _stored(rows.filter("gram IS NULL").select("segment", "names"), path, "gram_names")
    rows = rows.filter("gram IS NOT NULL").select("gram", "segment", "blobs")
    n_blobs = names.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    df = rows.groupBy("gram").agg(F.sum(F.size("blobs")).alias("df"))
    counts = _stored(_policy(df, n_blobs, fraction).repartitionByRange("gram").sortWithinPartitions("gram"), path, "gram_counts")
    out = counts.filter("NOT kept").select("gram")
    few = out.limit(FEW + 1).count() <= FEW
    kept = rows.join(F.broadcast(out) if few else out, "gram", "left_anti").select("gram", "segment", "blobs").sortWithinPartitions("gram", "segment")
    return GramIndex(counts, _stored(kept, path, "gram_postings"), names)


def load_grams(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("gram_counts", "gram_postings", "gram_names")))


def _leaves(need: regexplan.Need) -> set[str]:
    return {need.text.upper()} if need.kind == "has" else set().union(*map(_leaves, need.parts)) if need.kind in ("and", "or") else set()


def candidates(index: GramIndex, need: regexplan.Need) -> DataFrame | None:
    """blob_sha of blobs that may meet a requirement over texts, or None where any blob may.

    A gram that the policy left out asks nothing; one that no blob has is met by none. Only the postings of the
    requirement's own grams are read.
    """
    asked = regexplan.grams(need)
    grams = sorted(_leaves(asked))
    known = {r["gram"]: r["kept"] for r in index.counts.filter(F.col("gram").isin(grams)).collect()}  # at most the query's grams

    def met(n: regexplan.Need, leaf):
        if n.kind == "has":
            g = n.text.upper()
            return leaf(g) if known.get(g) else F.lit(g in known) if leaf is not _absent else g in known
        if n.kind in ("and", "or"):
            parts = [met(p, leaf) for p in n.parts]
            if leaf is _absent:
                return all(parts) if n.kind == "and" else any(parts)
            out = parts[0]
            for p in parts[1:]:
                out = out & p if n.kind == "and" else out | p
            return out
        return True if leaf is _absent else F.lit(True)

    if met(asked, _absent):
        return None
    hits = index.postings.filter(F.col("gram").isin([g for g in grams if known.get(g)])).select("segment", F.explode("blobs").alias("n"), "gram")
    sets = hits.groupBy("segment", "n").agg(F.collect_set("gram").alias("has")).filter(met(asked, lambda g: F.array_contains("has", g))).select("segment", F.col("n").cast("int"))
    return index.names.select("segment", F.posexplode("names").alias("n", "blob_sha")).join(sets, ["segment", "n"]).select("blob_sha")


def _absent(_: str) -> bool:
    """A blob without any of the kept grams."""
    return False


def search(index: GramIndex, files: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matching lines, as grep.regex finds them, reading the texts of candidate blobs only.

    Candidates are hashes of 64 characters; Spark sends them to the files where their measured size allows it, else both
    sides are shuffled by hash.
    """
    near = candidates(index, regexplan.needed(pattern, ignore_case))
    return grep.regex(files if near is None else files.join(near, "blob_sha", "left_semi"), pattern, ignore_case)


def _token_lists():
    """As _segments(), by value."""

    def cut(batches):
        """Arrow batches of (doc_id, dl, tokens) as rows (term, docs): a batch is a segment."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, dl, tokens = batch.columns
            n = len(batch)
            if not n:
                continue
            flat = tokens.flatten().dictionary_encode()
            owner = np.repeat(np.arange(n), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            found, tf = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | owner, return_counts=True)
            code, at = found >> 32, found & 0xFFFFFFFF
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
            docs = lambda rows, tf: pa.StructArray.from_arrays([ids.take(pa.array(rows)), dl.take(pa.array(rows)), pa.array(tf, pa.int64())], ["doc_id", "dl", "tf"])
            whole = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), docs(np.arange(n), np.zeros(n, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, flat.dictionary.type), whole], ["term", "docs"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)].astype(np.int32)), docs(at, tf))
            terms = flat.dictionary.take(pa.array(code[starts]))
            for i in range(0, len(starts), 10_000):
                yield pa.RecordBatch.from_arrays([terms.slice(i, 10_000), lists.slice(i, 10_000)], ["term", "docs"])

    return cut


def build_tokens(docs: DataFrame, path: str | None = None) -> TokenIndex:
    """The token index of documents (doc_id, tokens), cut into tokens once."""
    rows = docs.select("doc_id", F.size("tokens").alias("dl"), "tokens").mapInArrow(_token_lists(), f"term string, docs array<struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, dl: int, tf: bigint>>")
    postings = _stored(rows.sortWithinPartitions("term"), path, "token_postings")
    stats = rank.length_stats(postings.filter("term IS NULL").select(F.explode("docs.dl").alias("dl")))
    return TokenIndex(postings, _stored(stats, path, "token_stats"))


def load_tokens(spark: SparkSession, path: str) -> TokenIndex:
    return TokenIndex(spark.read.parquet(f"{path}/token_postings"), spark.read.parquet(f"{path}/token_stats"))


def bm25(index: TokenIndex, terms: list[str]) -> DataFrame:
    """doc_id, score over 0, from the postings of the query's terms alone."""
    hits = index.postings.filter(F.col("term").isin(list(dict.fromkeys(terms)))).select("term", F.inline("docs"))
    return rank.bm25_scores(hits.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf")), index.stats)
