"""Line search: literals and regular expressions over the contents of files.

A condition that every match must meet is checked on whole texts first, then on lines, then the real predicate
decides; all three stay in generated code and no index is needed. Contents are searched where they are read: only the
places of matches are shuffled, never texts, so a text that several files have is searched once a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regexplan
from .corpus import blobs_of, lines_of


def _matching(files: DataFrame, need: regexplan.Need, match: Column) -> DataFrame:
    """doc_id, repo, rel_path, line of each matching line, once per file; ordered by (repo, rel_path, line)."""
    rows = files.filter(regexplan.contains(F.col("content"), need))
    lines = lines_of(rows, "doc_id", "repo", "rel_path").filter(regexplan.contains(F.col("line_text"), need) & match)
    return lines.select("doc_id", "repo", "rel_path", F.col("line").cast("long").alias("line")).distinct().orderBy("repo", "rel_path", "line")


def literal(files: DataFrame, text: str) -> DataFrame:
    """Lines that contain a text. A text with a line end matches nothing; one shorter than a gram is searched alike."""
    if "\n" in text or not text:
        return _matching(files, regexplan.ALL, F.lit(False))
    need = regexplan.Need("has", text)
    return _matching(files, need, F.contains("line_text", F.lit(text)))


def regex(files: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    need = regexplan.needed(pattern, ignore_case)
    return _matching(files, need, F.rlike("line_text", F.lit(regexplan.java(pattern, ignore_case))))


def stats(files: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """One row: whether nothing could be required, candidate blobs, bytes and lines, lines after the filter, lines that match."""
    need = regexplan.needed(pattern, ignore_case)
    blobs = blobs_of(files.filter(regexplan.contains(F.col("content"), need))).select("blob_sha", "content")  # candidates alone are shuffled
    per = blobs.agg(F.count(F.lit(1)).alias("candidate_blobs"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("candidate_bytes"))
    sums = [F.count(F.lit(1)).alias("candidate_lines"), F.count_if(regexplan.contains(F.col("line_text"), need)).alias("lines_filtered"), F.count_if(F.rlike("line_text", F.lit(regexplan.java(pattern, ignore_case)))).alias("lines_matched")]
    return per.crossJoin(lines_of(blobs, "blob_sha").agg(*sums)).withColumn("query_all", F.lit(need == regexplan.ALL))  # one row each


def occurrences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """at (character offset from 0) of each occurrence of a text, overlapping ones too, where texts contain it.

    Pieces between hits of a zero-width lookahead end where occurrences start; their running lengths are the places.
    """
    pieces = F.split("content", _ahead(text))
    rows = df.filter(F.contains("content", F.lit(text))).select(*keep, F.col("content").startswith(text).alias("at_start"), F.transform(pieces, lambda x: F.length(x)).alias("ns"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(*keep, "at_start", "row", F.posexplode("ns").alias("i", "n"))
    before = F.sum("n").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)))
    return rows.filter("i > 0 OR at_start").select(*keep, F.col("at").cast("long").alias("at"))


def _ahead(text: str) -> str:
    return "(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in text) + ")"


def count_overlapping(content: Column, text: str) -> Column:
    """Occurrences of a text, overlapping ones too: matches of a lookahead, in one pass."""
    return F.regexp_count(content, F.lit(_ahead(text)))


def line_of(content: Column, at: Column) -> Column:
    """Line (from 1) of a character offset."""
    left = F.substring(content, F.lit(1), at)
    return F.length(left) - F.length(F.replace(left, F.lit("\n"), F.lit(""))) + 1


def _byte_text(content: Column) -> Column:
    """A character for each byte, so that places and lengths are those of bytes."""
    return F.decode(content.cast("binary"), "ISO-8859-1")


def gram_postings(blobs: DataFrame, wanted: list[str], all_of: bool = False) -> DataFrame:
    """blob_sha, gram, at (byte offset) of the wanted 3-byte grams alone (hex); all_of: of blobs that have each of them.

    Contents are cut at the grams where they are read, in one pass a gram; lengths of pieces alone are shuffled. A blob may
    have several rows.
    """
    texts = {g.upper(): bytes.fromhex(g).decode("latin-1") for g in wanted}
    has = [F.contains("bytes", F.lit(t)) for t in texts.values()]
    rows = blobs.select("blob_sha", _byte_text(F.col("content")).alias("bytes")).filter(reduce((lambda a, b: a & b) if all_of else (lambda a, b: a | b), has))
    cuts = [F.struct(F.lit(g).alias("gram"), F.startswith("bytes", F.lit(t)).alias("at_start"), F.transform(F.split("bytes", _ahead(t)), lambda x: F.length(x)).alias("ns")) for g, t in texts.items()]
    rows = rows.select("blob_sha", F.explode(F.array(*cuts)).alias("c")).groupBy("blob_sha", "c.gram").agg(F.min(F.struct("c.at_start", "c.ns")).alias("c"))
    rows = rows.select("blob_sha", "gram", "c.at_start", F.posexplode("c.ns").alias("i", "n"))
    before = F.sum("n").over(Window.partitionBy("blob_sha", "gram").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)))
    return rows.filter("i > 0 OR at_start").select("blob_sha", "gram", F.col("at").cast("long").alias("at"))


def positional(blobs: DataFrame, text: str) -> DataFrame:
    """Candidate places of a literal: its first and last gram at the right distance, by an equi-join on (blob, offset).

    blobs: blob_sha, content; files do as well, a blob that several have counts once.
    """
    data = text.encode()
    first, last, gap = data[:3].hex().upper(), data[-3:].hex().upper(), len(data) - 3
    posts = gram_postings(blobs, sorted({first, last}), all_of=True)
    begin = posts.filter(F.col("gram") == first).select("blob_sha", "at")
    end = posts.filter(F.col("gram") == last).select("blob_sha", (F.col("at") - gap).alias("at"))
    return begin.join(end, ["blob_sha", "at"])


def shard_order(found: DataFrame, shards: int) -> DataFrame:
    """Matches with the shard that held them, by repository."""
    return found.withColumn("shard", F.pmod(F.crc32(F.col("repo").cast("binary")), F.lit(shards)))


def limited(found: DataFrame, n: int) -> DataFrame:
    """The first n matches with the total number."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("repo", "rel_path", "line").limit(n).crossJoin(F.broadcast(total))  # one row


def first_per_repo(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo").orderBy("rel_path", "line")
    return found.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
