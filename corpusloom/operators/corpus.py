"""The corpus: files, the distinct texts (blobs) they hold, lines, scopes, and content-addressed storage as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: folders of version control.
VCS_FOLDERS = (".git", ".svn", ".hg", ".bzr")
#: Fixed: file extensions by language.
EXTENSIONS = {"go": ["go"], "csharp": ["cs"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "sql": ["sql"], "html": ["html", "htm"], "cfml": ["cfm", "cfc"]}


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files: repo (source), rel_path (lang/doc_id), blob_sha, content."""
    return docs.select("doc_id", F.col("source").alias("repo"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("rel_path"), "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob_sha"), F.coalesce("text", F.lit("")).alias("content"))


def blobs_of(files: DataFrame) -> DataFrame:
    """One row per distinct content; its first file is the least (repo, rel_path). Contents are combined before the shuffle."""
    first = F.min(F.struct("repo", "rel_path", "doc_id"))
    return files.groupBy("blob_sha").agg(F.count(F.lit(1)).alias("n_files"), first.alias("f"), F.first("content").alias("content")).select("blob_sha", "n_files", F.col("f.repo").alias("repo"), F.col("f.rel_path").alias("rel_path"), F.col("f.doc_id").alias("doc_id"), "content")


def dedup_stats(files: DataFrame) -> DataFrame:
    """Files, blobs, bytes before and after, and their ratio. Only hashes and sizes are shuffled."""
    sized = files.select("blob_sha", F.octet_length("content").cast("long").alias("n"))
    per = sized.groupBy("blob_sha").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    return per.agg(F.sum("c").alias("n_files"), F.count(F.lit(1)).alias("n_blobs"), F.sum(F.col("c") * F.col("n")).alias("raw_bytes"), F.sum("n").alias("kept_bytes")).withColumn("ratio", F.round(F.col("raw_bytes") / F.col("kept_bytes"), 6))


def lines_of(df: DataFrame, *keep: str) -> DataFrame:
    """line (from 1) and content of each line: split at \\n alone, no line after a final \\n, none in an empty text."""
    pieces = F.split("content", "\n")
    pieces = F.when(F.col("content").endswith("\n") | (F.col("content") == ""), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return df.select(*keep, F.posexplode(pieces).alias("p", "line_text")).select(*keep, (F.col("p") + 1).alias("line"), "line_text")


def git_blob_sha1(content: Column) -> Column:
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def chunk_key(content: Column) -> Column:
    """The first 16 bytes of SHA-256, in hex."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 32)


def vcs_internal(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VCS_FOLDERS)))


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it, at a segment boundary."""
    prefix = prefix.strip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def in_scope(files: DataFrame, repo: str | None = None, path_prefix: str | None = None, language: str | None = None) -> DataFrame:
    """Files of a repository, below a path, of a language (by extension). Filters reach the scan."""
    if repo:
        files = files.filter(F.col("repo") == repo)
    if path_prefix:
        files = files.filter(under(F.col("rel_path"), path_prefix))
    if language:
        if language not in EXTENSIONS:
            raise ValueError(f"unknown language {language}")
        files = files.filter(F.lower(F.substring_index("rel_path", ".", -1)).isin(EXTENSIONS[language]))
    return files


def allowed(files: DataFrame, policy: DataFrame, default_level: int = 2) -> DataFrame:
    """Files whose privacy level is over 1: the least of the default and of every override (prefix, level) above the file.

    Every prefix of a path is a key, so the join is an equi-join; one row a file is kept whatever overrides it meets.
    """
    if policy.filter("prefix IS NULL OR level IS NULL OR level < 1").limit(1).count():
        raise ValueError("malformed privacy policy")  # fails closed
    parts = F.split("rel_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ranked = files.select("repo", "rel_path", F.explode(F.array_union(prefixes, F.array(F.lit("")))).alias("prefix")).join(policy, "prefix").groupBy("repo", "rel_path").agg(F.min("level").alias("level"))
    return files.join(ranked, ["repo", "rel_path"], "left").filter(F.least(F.lit(default_level), F.coalesce("level", F.lit(default_level))) > 1).drop("level")


def put_blobs(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose blob the store does not have; putting twice adds nothing."""
    return new.dropDuplicates(["blob_sha"]).join(store, "blob_sha", "left_anti")


def compact(store: DataFrame, files: DataFrame) -> DataFrame:
    """The store without blobs that no file refers to."""
    return store.join(files.select("blob_sha").distinct(), "blob_sha", "left_semi")


def corrupt(store: DataFrame) -> DataFrame:
    """Blobs whose content does not hash to their key; of a sound store none."""
    return store.filter(F.sha2(F.col("content").cast("binary"), 256) != F.col("blob_sha"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash over the sorted distinct blobs of each repository."""
    return files.groupBy("repo").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("blob_sha")), ","), 256).alias("fingerprint"), F.count_distinct("blob_sha").alias("n_blobs"))
