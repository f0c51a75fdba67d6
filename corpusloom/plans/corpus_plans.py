"""Corpus, search and refresh queries. Documents are the files: source is the repository, lang/doc_id the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regexplan
from ..operators import corpus, grep, incremental, index
from ..session import table

_FILES = """
files AS (SELECT doc_id, source AS repo, lang || '/' || doc_id AS rel_path, lang, sha256(coalesce(text, '')) AS blob_sha, coalesce(text, '') AS content FROM documents),
lines AS (SELECT doc_id, repo, rel_path, i + 1 AS line, ls[i + 1] AS line_text FROM (
  SELECT doc_id, repo, rel_path, ls, unnest(range(len(ls) - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END)) AS i
  FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files)))"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.files_of(table(spark, d, "documents"))


def blob_dedup(spark, d):
    return corpus.blobs_of(_files(spark, d)).drop("content")


def dedup_stats(spark, d):
    return corpus.dedup_stats(_files(spark, d))


def line_explode(spark, d):
    return corpus.lines_of(_files(spark, d), "doc_id").select("doc_id", F.col("line").cast("long").alias("line"), F.length("line_text").cast("long").alias("width"))


def scope_filter(spark, d):
    return corpus.in_scope(_files(spark, d), repo="src1", path_prefix="en").select("doc_id", "rel_path")


def privacy_filter(spark, d):
    files = _files(spark, d).select("doc_id", "repo", "rel_path")
    policy = spark.createDataFrame([("de", 1), ("en", 2), ("fr/3", 1)], "prefix string, level int")
    return corpus.allowed(files, policy).select("doc_id", "repo", "rel_path")


def git_blob_sha(spark, d):
    return _files(spark, d).select("doc_id", corpus.git_blob_sha1(F.col("content")).alias("git_sha"), corpus.chunk_key(F.col("content")).alias("chunk_key"))


def repo_fingerprint(spark, d):
    return corpus.fingerprint(_files(spark, d))


def store_put(spark, d):
    files = _files(spark, d).select("doc_id", "repo", "blob_sha")
    return corpus.put_blobs(files.filter("repo = 'src0'"), files.filter("repo <> 'src0'")).select("blob_sha")


def store_compact(spark, d):
    files = _files(spark, d).select("doc_id", "repo", "blob_sha")
    return corpus.compact(files.select("blob_sha").distinct(), files.filter("repo <> 'src0'"))


def store_integrity(spark, d):
    """A store in which the blobs of every ninth document were changed behind their keys."""
    changed = F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit("?"))).otherwise(F.col("content"))
    return corpus.corrupt(corpus.blobs_of(_files(spark, d)).withColumn("content", changed)).select("blob_sha", "doc_id")


def grep_literal(spark, d):
    return grep.literal(_files(spark, d), "License")


def grep_short(spark, d):
    return grep.literal(_files(spark, d), "ß")


def grep_regex(spark, d):
    return grep.regex(_files(spark, d), r"[Ll]icensed under (the )?[A-Z]+")


def grep_alternation(spark, d):
    return grep.regex(_files(spark, d), r"\b(idiot|clown|moron)s?\b.*[a-z]+$")


def grep_ci(spark, d):
    return grep.regex(_files(spark, d), "apache LICENSE", ignore_case=True)


def grep_stats(spark, d):
    return grep.stats(_files(spark, d), r"\d{3}-\d{4}|Apache")


def grep_limit(spark, d):
    return grep.limited(grep.literal(_files(spark, d), "the"), 50)


def grep_first_per_repo(spark, d):
    return grep.first_per_repo(grep.literal(_files(spark, d), "Version"))


def occurrence_count(spark, d):
    return _files(spark, d).select("doc_id", grep.count_overlapping(F.col("content"), "thth").cast("long").alias("n")).filter("n > 0")


def occurrence_locate(spark, d):
    return grep.occurrences(_files(spark, d), "License", "doc_id")


def line_of_offset(spark, d):
    found = grep.occurrences(_files(spark, d), "License", "doc_id", "content")
    return found.select("doc_id", "at", grep.line_of(F.col("content"), F.col("at").cast("int")).cast("long").alias("line"))


def positional_join(spark, d):
    return grep.positional(_files(spark, d), "Apache License")


def gram_policy(spark, d):
    """Grams of the distinct texts, and those that at most a fifth of the texts have."""
    blobs = corpus.blobs_of(_files(spark, d))
    pairs = blobs.select("blob_sha", F.explode(index.blob_grams(F.col("content"))).alias("gram"))
    return index.gram_counts(pairs, blobs.count(), 0.2)


def grep_indexed(spark, d):
    """Search by a gram index without the commonest grams: only candidate texts are read."""
    files = _files(spark, d)
    return index.search(index.build_grams(corpus.blobs_of(files), 0.5), files, r"[Ll]icensed under (the )?[A-Z]+")


def regex_candidates(spark, d):
    """Documents that may match by the required strings alone, and those that do."""
    pattern = r"(idiot|clown)[a-z ]+the"
    need = regexplan.needed(pattern)
    rows = _files(spark, d).filter(regexplan.contains(F.col("content"), need))
    return rows.select("doc_id", F.rlike("content", F.lit(regexplan.java(pattern))).alias("matches"))


def path_segments(spark, d):
    files = _files(spark, d).select("doc_id", "rel_path", corpus.vcs_internal(F.concat(F.element_at(F.array(F.lit(".git/"), F.lit("my.git/"), F.lit("a/.hg/")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("rel_path"))).alias("inside"))
    return files.filter(corpus.under(F.col("rel_path"), "de/1") | F.col("rel_path").endswith("7")).select("doc_id", "inside")


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    old = docs.filter("doc_id % 10 <> 0").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("sha")))
    return old, docs.filter("doc_id % 11 <> 0")


def delta_classify(spark, d):
    """Two states of the corpus: the earlier lacks every tenth document and has an older text of every seventh; the later lacks every eleventh."""
    return incremental.classify(*_snapshots(spark, d), "doc_id", "sha")


def refresh_equals_full(spark, d):
    """Word counts by document, refreshed for the changed ones only, against a full build; every 49th change is missed."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lambda df: df.select("doc_id", F.size(F.split("text", " ")).alias("n"))
    old = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("an older text")).otherwise(F.col("text")))
    changes = incremental.classify(old, docs, "doc_id", "text").filter("change <> 'same' AND doc_id % 49 <> 0")
    again = words(docs.join(changes.select("doc_id"), "doc_id", "left_semi"))
    return incremental.verdict(words(docs), incremental.refreshed(words(old), again, changes, "doc_id"))


def reconcile(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("project"), F.col("source").alias("path"), F.col("n_chars").alias("head"))
    managed = docs.filter("project % 5 <> 0").withColumn("path", F.when(F.col("project") % 13 == 0, F.lit("elsewhere")).otherwise(F.col("path"))).withColumn("head", F.when(F.col("project") % 17 == 0, F.lit(-1)).otherwise(F.col("head")))
    return incremental.reconcile(managed, docs.filter("project % 3 <> 0"))


def _grep_sql(condition: str) -> str:
    return f"WITH {_FILES} SELECT doc_id, repo, rel_path, line FROM lines WHERE {condition}"


QUERIES = {
    "blob_dedup": (blob_dedup, f"WITH {_FILES} SELECT blob_sha, count(*) AS n_files, arg_min(repo, (repo, rel_path, doc_id)) AS repo, arg_min(rel_path, (repo, rel_path, doc_id)) AS rel_path, arg_min(doc_id, (repo, rel_path, doc_id)) AS doc_id FROM files GROUP BY blob_sha"),
    "dedup_stats": (dedup_stats, f"WITH {_FILES}, b AS (SELECT blob_sha, count(*) c, max(strlen(content)) n FROM files GROUP BY 1) SELECT sum(c)::BIGINT AS n_files, count(*) AS n_blobs, sum(c * n)::BIGINT AS raw_bytes, sum(n)::BIGINT AS kept_bytes, round(sum(c * n) / sum(n), 6) AS ratio FROM b"),
    "line_explode": (line_explode, f"WITH {_FILES} SELECT doc_id, line, length(line_text) AS width FROM lines"),
    "scope_filter": (scope_filter, f"WITH {_FILES} SELECT doc_id, rel_path FROM files WHERE repo = 'src1' AND lang = 'en'"),
    "privacy_filter": (privacy_filter, f"WITH {_FILES} SELECT doc_id, repo, rel_path FROM files WHERE lang <> 'de' AND rel_path <> 'fr/3'"),
    "git_blob_sha": (git_blob_sha, f"WITH {_FILES} SELECT doc_id, sha1('blob '::BLOB || strlen(content)::VARCHAR::BLOB || '\\x00'::BLOB || encode(content)) AS git_sha, substr(blob_sha, 1, 32) AS chunk_key FROM files"),
    "repo_fingerprint": (repo_fingerprint, f"WITH {_FILES} SELECT repo, sha256(string_agg(DISTINCT blob_sha, ',' ORDER BY blob_sha)) AS fingerprint, count(DISTINCT blob_sha) AS n_blobs FROM files GROUP BY repo"),
    "store_put": (store_put, f"WITH {_FILES} SELECT DISTINCT blob_sha FROM files WHERE repo <> 'src0' AND blob_sha NOT IN (SELECT blob_sha FROM files WHERE repo = 'src0')"),
    "store_compact": (store_compact, f"WITH {_FILES} SELECT DISTINCT blob_sha FROM files WHERE repo <> 'src0'"),
    "store_integrity": (store_integrity, f"WITH {_FILES} SELECT blob_sha, arg_min(doc_id, (repo, rel_path, doc_id)) AS doc_id FROM files GROUP BY blob_sha HAVING arg_min(doc_id, (repo, rel_path, doc_id)) % 9 = 0"),
    "grep_literal": (grep_literal, _grep_sql("contains(line_text, 'License')")),
    "grep_short": (grep_short, _grep_sql("contains(line_text, 'ß')")),
    "grep_regex": (grep_regex, _grep_sql("regexp_matches(line_text, '[Ll]icensed under (the )?[A-Z]+')")),
    "grep_alternation": (grep_alternation, _grep_sql(r"regexp_matches(line_text, '\b(idiot|clown|moron)s?\b.*[a-z]+$')")),
    "grep_ci": (grep_ci, _grep_sql("regexp_matches(line_text, '(?i)apache LICENSE')")),
    "grep_stats": (grep_stats, f"""WITH {_FILES}, hit AS (SELECT min(doc_id) AS doc_id FROM files GROUP BY content HAVING contains(content, 'Apache') OR contains(content, '-')),
      l AS (SELECT line_text FROM lines WHERE doc_id IN (SELECT doc_id FROM hit))
      SELECT (SELECT count(*) FROM hit) AS candidate_blobs, (SELECT sum(strlen(content)) FROM files WHERE doc_id IN (SELECT doc_id FROM hit))::BIGINT AS candidate_bytes,
      count(*) AS candidate_lines, count(*) FILTER (contains(line_text, 'Apache') OR contains(line_text, '-')) AS lines_filtered, count(*) FILTER (regexp_matches(line_text, '\\d{{3}}-\\d{{4}}|Apache')) AS lines_matched, false AS query_all FROM l""".replace("\\\\", "\\")),
    "grep_limit": (grep_limit, f"WITH {_FILES}, m AS (SELECT doc_id, repo, rel_path, line FROM lines WHERE contains(line_text, 'the')) SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY repo, rel_path, line LIMIT 50"),
    "grep_first_per_repo": (grep_first_per_repo, f"WITH {_FILES} SELECT doc_id, repo, rel_path, line FROM lines WHERE contains(line_text, 'Version') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY rel_path, line) = 1"),
    "occurrence_count": (occurrence_count, f"WITH {_FILES}, p AS (SELECT doc_id, content, unnest(range(1, length(content) - 2)) AS i FROM files WHERE contains(content, 'thth')) SELECT doc_id, count(*) AS n FROM p WHERE substr(content, i, 4) = 'thth' GROUP BY doc_id"),
    "occurrence_locate": (occurrence_locate, f"WITH {_FILES}, p AS (SELECT doc_id, content, unnest(range(1, length(content) - 5)) AS i FROM files WHERE contains(content, 'License')) SELECT doc_id, i - 1 AS at FROM p WHERE substr(content, i, 7) = 'License'"),
    "line_of_offset": (line_of_offset, f"WITH {_FILES}, p AS (SELECT doc_id, content, unnest(range(1, length(content) - 5)) AS i FROM files WHERE contains(content, 'License')) SELECT doc_id, i - 1 AS at, 1 + length(left(content, i - 1)) - length(replace(left(content, i - 1), chr(10), '')) AS line FROM p WHERE substr(content, i, 7) = 'License'"),
    "positional_join": (positional_join, f"WITH {_FILES}, b AS (SELECT DISTINCT blob_sha, hex(encode(content)) AS h FROM files WHERE contains(content, 'Apa') AND contains(content, 'nse')), p AS (SELECT blob_sha, h, unnest(range(0, length(h) // 2 - 13)) AS i FROM b) SELECT blob_sha, i AS at FROM p WHERE substr(h, 2 * i + 1, 6) = '417061' AND substr(h, 2 * i + 23, 6) = '6E7365'"),
    "gram_policy": (gram_policy, f"WITH {_FILES}, b AS (SELECT DISTINCT blob_sha, hex(encode(content)) AS h FROM files), g AS (SELECT unnest(list_distinct(list_concat(list_concat(regexp_extract_all(h, '.{{6}}'), regexp_extract_all(substr(h, 3), '.{{6}}')), regexp_extract_all(substr(h, 5), '.{{6}}')))) AS gram FROM b) SELECT gram, count(*) AS df, count(*) <= 0.2 * (SELECT count(*) FROM b) AS kept FROM g GROUP BY gram"),
    "grep_indexed": (grep_indexed, _grep_sql("regexp_matches(line_text, '[Ll]icensed under (the )?[A-Z]+')")),
    "regex_candidates": (regex_candidates, f"WITH {_FILES} SELECT doc_id, regexp_matches(content, '(idiot|clown)[a-z ]+the') AS matches FROM files WHERE (contains(content, 'idiot') OR contains(content, 'clown')) AND contains(content, 'the')"),
    "path_segments": (path_segments, f"WITH {_FILES} SELECT doc_id, doc_id % 3 <> 1 AS inside FROM files WHERE rel_path = 'de/1' OR rel_path LIKE '%7'"),
    "delta_classify": (delta_classify, """WITH n AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha END AS sha FROM n WHERE doc_id % 10 <> 0), m AS (SELECT * FROM n WHERE doc_id % 11 <> 0)
      SELECT coalesce(o.doc_id, m.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN m.doc_id IS NULL THEN 'removed' WHEN o.sha = m.sha THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN m ON o.doc_id = m.doc_id"""),
    "refresh_equals_full": (refresh_equals_full, "WITH m AS (SELECT count(*) AS n FROM documents WHERE doc_id % 49 = 0 AND len(string_split(coalesce(text, ''), ' ')) <> 3) SELECT n AS missing, n AS extra, CASE WHEN n = 0 THEN 'OK' ELSE 'BOTH' END AS verdict FROM m"),
    "reconcile": (reconcile, """WITH m AS (SELECT doc_id AS project, CASE WHEN doc_id % 13 = 0 THEN 'elsewhere' ELSE source END AS path, CASE WHEN doc_id % 17 = 0 THEN -1 ELSE n_chars END AS head FROM documents WHERE doc_id % 5 <> 0), r AS (SELECT doc_id AS project, source AS path, n_chars AS head FROM documents WHERE doc_id % 3 <> 0)
      SELECT coalesce(m.project, r.project) AS project, CASE WHEN m.project IS NULL THEN 'add' WHEN r.project IS NULL THEN 'missing' WHEN m.path <> r.path THEN 'move' WHEN m.head <> r.head THEN 'update' ELSE 'keep' END AS action FROM m FULL JOIN r ON m.project = r.project"""),
}
