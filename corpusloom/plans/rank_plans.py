"""Ranking, vectors, spans, context and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import tokenize
from ..functions.vector import norm
from ..operators import context, corpus, evaluation, index, rank, spans, vectors
from ..session import table
from ..sources.shared import materialise

#: The query of the ranking plans.
QUERY = ["licensed", "under", "apache", "version", "the"]
TOP = 20
_TOK = """
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}]+')) AS run, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}]+'), 1) AS nr FROM documents),
parts AS (SELECT doc_id, nr, run, string_split(regexp_replace(regexp_replace(run, '([^\\p{Lu}])(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM runs),
tok AS (SELECT doc_id, unnest(list_distinct(list_concat(flatten(list_transform(range(1, len(ps) + 1), lambda i: list_transform(range(i, least(i + 3, len(ps)) + 1), lambda j: lower(array_to_string(ps[i:j], ''))))), [lower(run)]))) AS token FROM parts),
dl AS (SELECT d.doc_id, count(t.token) AS dl FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id)"""
_TERMS = "('" + "', '".join(QUERY) + "')"
_BM25 = f"""{_TOK},
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN {_TERMS} GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl),
bm AS (SELECT tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (token) JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st GROUP BY tf.doc_id)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return rank.with_tokens(table(spark, d, "documents"))


def tokenize_terms(spark, d):
    return _docs(spark, d).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


def term_stats(spark, d):
    return rank.term_totals(_docs(spark, d)).filter("df >= 5")


def doc_len(spark, d):
    docs = _docs(spark, d)
    return rank.doc_lengths(docs).crossJoin(F.broadcast(rank.corpus_stats(docs))).select("doc_id", "dl", "n", F.round("avgdl", 6).alias("avgdl"))  # one row


def _bm25(spark, d):
    return rank.bm25(_docs(spark, d), QUERY).withColumn("score", F.round("score", 6))


def bm25_topk(spark, d):
    return _bm25(spark, d).orderBy(F.desc("score"), "doc_id").limit(TOP)


def bm25_indexed(spark, d):
    """The same from a kept index: postings of the query's terms alone."""
    kept = index.build_tokens(_docs(spark, d))
    return index.bm25(kept, QUERY).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(TOP)


def _paths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))


def path_arm(spark, d):
    return rank.coverage_arm(_paths(spark, d), ["src1", "en", "files"], rank.PATH_COVERAGE)


def symbol_arm(spark, d):
    """First words of lines stand for symbol names."""
    files = corpus.files_of(table(spark, d, "documents"))
    entries = corpus.lines_of(files, "doc_id").select("doc_id", F.col("line").alias("start"), F.array_join(F.slice(F.split("line_text", " "), 1, 3), " ").alias("name"))
    return rank.summed_coverage(entries, ["licensed", "under", "the"]).select("doc_id", F.col("score").cast("long").alias("score"), F.col("start").cast("long").alias("start"))


def _query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def dense_topk(spark, d):
    return rank.dense_topk(table(spark, d, "embeddings"), _query_vector(spark, d), TOP, but=0)


def best_chunk(spark, d):
    """Four vectors are the chunks of a document."""
    chunks = table(spark, d, "embeddings").filter("vec_id <> 0").select(F.floor(F.col("vec_id") / 4).alias("doc_id"), (F.col("vec_id") % 4).alias("chunk"), "embedding")
    return rank.best_chunks(chunks, _query_vector(spark, d))


def _arms(spark, d):
    lexical = rank.ranked(_bm25(spark, d), "score", rank.DENSE_K)
    dense = rank.dense_topk(table(spark, d, "embeddings"), _query_vector(spark, d), rank.DENSE_K)
    dense = rank.ranked(dense.withColumnRenamed("vec_id", "doc_id"), "cosine", rank.DENSE_K)
    path = rank.ranked(rank.coverage_arm(_paths(spark, d), ["src1", "en"], rank.PATH_COVERAGE), "hits", rank.DENSE_K)
    return lexical, dense, path


def hybrid_rank(spark, d):
    """Lexical, dense (a vector's id is its document's) and path arms, fused by reciprocal rank."""
    return rank.fuse(*_arms(spark, d)).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(TOP)


def _features(spark, d):
    parts = [a.select("doc_id", F.lit(name).alias("arm"), "rank") for a, name in zip(_arms(spark, d), ("lexical", "dense", "path"), strict=True)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("doc_id").agg(*[F.round(F.sum(F.when(F.col("arm") == a, rank.rank_reciprocal(F.col("rank"))).otherwise(0.0)), 9).alias(a) for a in ("lexical", "dense", "path")])


def rank_features(spark, d):
    return _features(spark, d)


def reranker_score(spark, d):
    f = _features(spark, d)
    return f.select("doc_id", F.round(rank.rerank([F.col("lexical"), F.col("dense"), F.col("path")], [40.0, 25.0, 10.0], -0.5), 6).alias("score"))


def lexical_spans(spark, d):
    lines = corpus.lines_of(corpus.files_of(table(spark, d, "documents")), "doc_id")
    hits = rank.term_spans(lines, ["licensed", "idiot"])
    hits = materialise(hits.select("doc_id", F.col("line").cast("long").alias("start"), F.col("line").cast("long").alias("end")), "hits")  # counted, then merged
    return spans.merge_spans(hits, ["doc_id"])


def _lineitem_spans(spark, d):
    rows = table(spark, d, "lineitem")
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    return rows.select("l_orderkey", day.cast("long").alias("start"), (day + F.col("l_quantity").cast("int")).cast("long").alias("end"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").cast("long").alias("line"))


def span_merge(spark, d):
    return spans.merge_spans(_lineitem_spans(spark, d).select("l_orderkey", "start", "end"), ["l_orderkey"])


def block_merge(spark, d):
    """Spans of one order merge across a gap of two; the best score and its line stay."""
    return spans.merge_spans(_lineitem_spans(spark, d), ["l_orderkey"], gap=2)


def chunk_windows(spark, d):
    files = corpus.files_of(table(spark, d, "documents"))
    n = F.when(F.col("content") == "", 0).otherwise(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.col("content").endswith("\n"), 0).otherwise(1))
    counted = files.select("doc_id", n.cast("long").alias("n"))
    return spans.chunks(counted, F.col("n"), 10, 3).select("doc_id", "start_line", "end_line")


def import_dominance(spark, d):
    lines = corpus.lines_of(corpus.files_of(table(spark, d, "documents")), "doc_id")
    counts = spans.running_counts(lines, "doc_id")
    blocks = lines.groupBy("doc_id").agg(F.lit(1).alias("start"), F.least(F.lit(5), F.max("line")).alias("end"))
    out = spans.import_dominated(blocks, counts, "doc_id")
    return out.select("doc_id", F.col("end").cast("long").alias("end"), "nonblank", "imports", "dominated")


def block_pack(spark, d):
    """All documents of a source, by length, into a budget of tokens: what fits in order, the first always."""
    docs = table(spark, d, "documents").select("source", "doc_id", context.estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    w = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("tokens"), "doc_id"))
    return context.pack_blocks(docs.withColumn("rank", w), ["source"], 4000).select("source", "rank", "doc_id", "packed_tokens")


def numbered_source(spark, d):
    lines = corpus.lines_of(corpus.files_of(table(spark, d, "documents")), "doc_id")
    return context.numbered_lines(lines, "doc_id").select("doc_id", F.sha2(F.col("source").cast("binary"), 256).alias("sha"))


def cosine_all_pairs(spark, d):
    return vectors.similar(table(spark, d, "embeddings"))


def cosine_near(spark, d):
    """The three most alike at 0.3 or more, a threshold that many vectors meet."""
    return vectors.similar(table(spark, d, "embeddings"), 3, 0.3)


def similar_lsh(spark, d):
    return vectors.similar_lsh(table(spark, d, "embeddings"), 64)


def quantize_int8(spark, d):
    return vectors.quantised_scores(table(spark, d, "embeddings"), _query_vector(spark, d))


def vector_integrity(spark, d):
    return vectors.integrity(table(spark, d, "embeddings"), 64)


def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"))


def vector_reuse(spark, d):
    """Vectors stored are those of the labelled documents' texts."""
    docs = table(spark, d, "documents").select("doc_id", corpus.chunk_key(F.coalesce("text", F.lit(""))).alias("chunk_key"))
    stored = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id").groupBy("chunk_key").agg(F.min("doc_id").alias("stored"))
    return vectors.reused(docs, stored).select("doc_id", F.col("stored").isNotNull().alias("reused"))


def _runs(spark, d):
    """A ranked list for each source: its documents by length; grades are quality, and toxic ones distract."""
    docs = table(spark, d, "documents")
    pos = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("item"), pos.alias("pos"))
    gold = table(spark, d, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), (F.col("quality") - 2 * F.col("toxic")).alias("grade"))
    return ranked, gold


def retrieval_metrics(spark, d):
    return evaluation.metrics(*_runs(spark, d), 10)


def metric_means(spark, d):
    return evaluation.means(evaluation.metrics(*_runs(spark, d), 10))


def tier_precision(spark, d):
    """Suppliers of a nation by balance stand for edges, every third is right."""
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("query"), F.col("s_suppkey").alias("item"), "s_acctbal")
    tier = F.element_at(F.array(*map(F.lit, evaluation.TIER_NAMES)), (F.col("item") % 5 + 1).cast("int"))
    edges = rows.filter("item % 5 <> 4").select("query", "item", tier.alias("tier"), F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s_acctbal"), "item")).alias("pos"))
    return evaluation.tier_precision(edges, rows.filter("item % 3 = 0").select("query", "item", F.lit(1).alias("grade")))


def graph_evaluation(spark, d):
    """Node answers by source as in _runs; edge answers by source are the documents in order, those of quality right."""
    nodes, gold = _runs(spark, d)
    docs = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))
    edges = docs.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("item")))
    right = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"), F.lit(1).alias("grade")).join(docs, "item").select("query", "item", "grade")
    return evaluation.graph_metrics(nodes, gold, edges, right, 10)


def group_kfold(spark, d):
    return evaluation.group_folds(table(spark, d, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "source", F.col("fold").cast("long").alias("fold"))


def reranker_train(spark, d):
    """Quality from length, words and lines of at most 1000 labelled documents, the least doc_ids."""
    import numpy as np

    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", "quality", F.length("text").alias("a"), F.size(F.split("text", " ")).alias("b"), F.size(F.split("text", "\n")).alias("c")).orderBy("doc_id").limit(1000).collect()
    w, b = evaluation.train_reranker(np.array([[r["a"], r["b"], r["c"]] for r in rows], float), np.array([r["quality"] for r in rows], float), epochs=20)
    return spark.createDataFrame([("chars", float(w[0])), ("words", float(w[1])), ("lines", float(w[2])), ("bias", b)], "feature string, weight double")


_LINES = """
files AS (SELECT doc_id, source AS repo, coalesce(text, '') AS content FROM documents),
lines AS (SELECT doc_id, repo, i + 1 AS line, ls[i + 1] AS line_text FROM (
  SELECT doc_id, repo, ls, unnest(range(len(ls) - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END)) AS i
  FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files)))"""
_ARMS = f"""{_BM25},
lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 64),
qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
den AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) DESC, vec_id) AS rank FROM embeddings, qv QUALIFY rank <= 64),
pat AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM (SELECT doc_id, (source = 'src1')::INT + (lang = 'en')::INT AS hits FROM documents) WHERE hits >= 2 QUALIFY rank <= 64),
arms AS (SELECT 'lexical' AS arm, * FROM lex UNION ALL SELECT 'dense', * FROM den UNION ALL SELECT 'path', * FROM pat)"""
_FEATURES = f"{_ARMS}, feat AS (SELECT doc_id, " + ", ".join(f"round(sum(CASE WHEN arm = '{a}' THEN 1.0::DOUBLE / (60 + rank) ELSE 0.0::DOUBLE END), 9) AS {a}" for a in ("lexical", "dense", "path")) + " FROM arms GROUP BY doc_id)"


def _merge_sql(gap: int, extra: str) -> str:
    return f"""WITH s AS (SELECT l_orderkey, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS start, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::INT AS "end", l_extendedprice AS score, l_linenumber::BIGINT AS line FROM lineitem),
      r AS (SELECT *, max("end") OVER (PARTITION BY l_orderkey ORDER BY start, "end", line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
      i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY start, "end", line ROWS UNBOUNDED PRECEDING) AS island FROM r)
      SELECT l_orderkey, min(start)::BIGINT AS start, max("end")::BIGINT AS "end"{extra} FROM i GROUP BY l_orderkey, island"""


_RUNS = """
ranked AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
gold AS (SELECT source AS query, doc_id AS item, quality - 2 * toxic AS grade FROM labels JOIN documents USING (doc_id)),
g AS (SELECT r.*, coalesce(grade, 0) AS grade, least(10, max(pos) OVER (PARTITION BY r.query)) AS kk FROM ranked r LEFT JOIN gold USING (query, item)),
per AS (SELECT query, max(kk) AS kk, count(*) FILTER (grade >= 1 AND pos <= kk) AS hits, coalesce(sum(CASE WHEN pos <= kk AND grade > 0 THEN (pow(2, grade) - 1) / log2(pos + 1) END), 0) AS dcg,
  coalesce(sum(CASE WHEN pos <= kk THEN CASE WHEN grade >= 1 THEN pow(2, grade) - 1 WHEN grade < 0 THEN 1 - pow(2, -grade) ELSE -0.5 END / log2(pos + 1) END), 0) AS u, min(pos) FILTER (grade >= 1) AS fh FROM g GROUP BY query),
good AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS p FROM gold WHERE grade >= 1),
tot AS (SELECT good.query, count(*) AS relevant, sum(CASE WHEN p <= kk THEN (pow(2, grade) - 1) / log2(p + 1) END) AS idcg FROM good JOIN per USING (query) GROUP BY 1),
m AS (SELECT per.query, coalesce(round(hits / relevant, 6), 0.0) AS recall, coalesce(round(hits / kk, 6), 0.0) AS precision, coalesce(round(1 / fh, 6), 0.0) AS mrr, coalesce(round(dcg / idcg, 6), 0.0) AS ndcg, coalesce(round(u / idcg, 6), 0.0) AS udcg FROM per LEFT JOIN tot USING (query))"""

QUERIES = {
    "tokenize_terms": (tokenize_terms, f"WITH {_TOK} SELECT d.doc_id, count(t.token) AS n_tokens, count(DISTINCT t.token) AS n_distinct FROM documents d LEFT JOIN tok t ON d.doc_id = t.doc_id GROUP BY d.doc_id"),
    "term_stats": (term_stats, f"WITH {_TOK} SELECT token AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY token HAVING count(DISTINCT doc_id) >= 5"),
    "doc_len": (doc_len, f"WITH {_TOK} SELECT doc_id, dl, count(*) OVER () AS n, round(sum(dl) OVER () / count(*) OVER (), 6) AS avgdl FROM dl"),
    "bm25_topk": (bm25_topk, f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT {TOP}"),
    "path_arm": (path_arm, "SELECT * FROM (SELECT doc_id, (source = 'src1')::INT + (lang = 'en')::INT AS hits FROM documents) WHERE hits >= 2"),
    "symbol_arm": (symbol_arm, f"WITH {_LINES}, n AS (SELECT doc_id, line, regexp_extract_all(lower(array_to_string(string_split(line_text, ' ')[1:3], ' ')), '[\\p{{L}}\\p{{Nd}}]+') AS ws FROM lines) SELECT doc_id, 3 * count(*) AS score, min(line) AS start FROM n WHERE list_has_all(ws, ['licensed', 'under', 'the']) GROUP BY doc_id"),
    "bm25_indexed": (bm25_indexed, f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT {TOP}"),
    "best_chunk": (best_chunk, "WITH c AS (SELECT vec_id // 4 AS doc_id, vec_id % 4 AS chunk, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS cosine FROM embeddings WHERE vec_id <> 0) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, chunk) = 1"),
    "tier_precision": (tier_precision, "WITH t AS (SELECT unnest(['Candidate', 'Pattern', 'Verified', 'Proven']) AS tier, unnest([0, 1, 2, 3]) AS r), e AS (SELECT s_suppkey % 5 AS r, count(*) AS returned, count(*) FILTER (s_suppkey % 3 = 0) AS hits FROM supplier GROUP BY 1) SELECT tier, coalesce(returned, 0) AS returned, coalesce(hits, 0) AS hits, coalesce(round(hits / returned, 6), 0.0)::DOUBLE AS precision FROM t LEFT JOIN e USING (r)"),
    "graph_evaluation": (graph_evaluation, f"""WITH {_RUNS},
      eg AS (SELECT source AS query, doc_id AS item FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
      er AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
      ek AS (SELECT query, least(10, max(n)) AS kk FROM er GROUP BY query),
      ep AS (SELECT er.query, er.pos, kk, eg.item IS NOT NULL AS hit FROM er JOIN ek USING (query) LEFT JOIN eg ON eg.query = er.query AND eg.item = er.item),
      e1 AS (SELECT query, max(kk) AS kk, count(*) FILTER (hit AND pos <= kk) AS hits, coalesce(sum(1 / log2(pos + 1)) FILTER (hit AND pos <= kk), 0) AS dcg, coalesce(sum(CASE WHEN hit THEN 1 ELSE -0.5 END / log2(pos + 1)) FILTER (pos <= kk), 0) AS u, min(pos) FILTER (hit) AS fh, count(*) FILTER (hit) AS relevant FROM ep GROUP BY query),
      e2 AS (SELECT *, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, least(kk, relevant) + 1)) AS i)) AS idcg FROM e1 WHERE relevant > 0),
      both_ AS (SELECT query, round(hits / relevant, 6) AS recall, round(hits / kk, 6) AS precision, coalesce(round(1 / fh, 6), 0) AS mrr, round(dcg / idcg, 6) AS ndcg, round(u / idcg, 6) AS udcg FROM e2
        UNION ALL SELECT * FROM m WHERE query IN (SELECT query FROM gold WHERE grade >= 1))
      SELECT query, round(avg(recall), 7) AS recall, round(avg(precision), 7) AS precision, round(avg(mrr), 7) AS mrr, round(avg(ndcg), 7) AS ndcg, round(avg(udcg), 7) AS udcg FROM both_ GROUP BY query"""),
    "dense_topk": (dense_topk, f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS cosine FROM embeddings, q WHERE vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT {TOP}"),
    "hybrid_rank": (hybrid_rank, f"WITH {_ARMS} SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM arms GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {TOP}"),
    "rank_features": (rank_features, f"WITH {_FEATURES} SELECT * FROM feat"),
    "reranker_score": (reranker_score, f"WITH {_FEATURES} SELECT doc_id, round(1 / (1 + exp(-(-0.5::DOUBLE + lexical * 40 + dense * 25 + path * 10))), 6) AS score FROM feat"),
    "lexical_spans": (lexical_spans, f"""WITH {_LINES}, h AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM lines WHERE contains(lower(line_text), 'licensed') OR contains(lower(line_text), 'idiot')) SELECT doc_id, min(line) AS start, max(line) AS "end" FROM h GROUP BY doc_id, island"""),
    "span_merge": (span_merge, _merge_sql(1, "")),
    "block_merge": (block_merge, _merge_sql(2, ", max(score) AS score, arg_max(line, (score, -start)) AS line")),
    "chunk_windows": (chunk_windows, f"WITH {_LINES}, n AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), w AS (SELECT doc_id, n, unnest(range(1, n + 1, 7)) AS s FROM n) SELECT doc_id, s AS start_line, least(s + 9, n) AS end_line FROM w WHERE s = 1 OR s + 2 < n"),
    "import_dominance": (import_dominance, f"WITH {_LINES}, c AS (SELECT doc_id, max(line) AS \"end\", count(*) FILTER (trim(line_text) <> '') AS nonblank, count(*) FILTER (regexp_matches(line_text, '^\\s*(import\\b|using\\s+[\\w.=\\s]+;|from\\s+\\S+\\s+import\\b|#include\\b|require\\s*\\(|package\\b)')) AS imports FROM lines WHERE line <= 5 GROUP BY doc_id) SELECT doc_id, \"end\", nonblank, imports, imports * 10 > nonblank * 7 AS dominated FROM c"),
    "block_pack": (block_pack, """WITH RECURSIVE b AS (SELECT source, doc_id, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY ceil(strlen(coalesce(text, '')) / 4) DESC, doc_id) AS rank FROM documents),
      p AS (SELECT source, rank, doc_id, least(tokens, 4000) AS used, true AS fits, least(tokens, 4000) AS packed_tokens FROM b WHERE rank = 1
        UNION ALL SELECT b.source, b.rank, b.doc_id, CASE WHEN p.used + tokens <= 4000 THEN p.used + tokens ELSE p.used END, p.used + tokens <= 4000, tokens FROM p JOIN b ON b.source = p.source AND b.rank = p.rank + 1)
      SELECT source, rank, doc_id, packed_tokens FROM p WHERE fits"""),
    "numbered_source": (numbered_source, f"WITH {_LINES} SELECT doc_id, sha256(string_agg(lpad(line::VARCHAR, 6, ' ') || chr(9) || line_text, chr(10) ORDER BY line)) AS sha FROM lines GROUP BY doc_id"),
    "cosine_all_pairs": (cosine_all_pairs, "SELECT a.vec_id, b.vec_id AS other_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.6 QUALIFY rank <= 5"),
    "cosine_near": (cosine_near, "SELECT a.vec_id, b.vec_id AS other_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3 QUALIFY rank <= 3"),
    "similar_lsh": (similar_lsh, "SELECT a.vec_id, b.vec_id AS other_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.6 QUALIFY rank <= 5"),  # exact up to 4096 vectors
    "quantize_int8": (quantize_int8, """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings)
      SELECT vec_id, round(scale, 9) AS scale, round(list_dot_product(e, q), 6) AS exact, round(list_dot_product(list_transform(e, lambda x: round(x / scale)), q) * scale, 6) AS quantised FROM s, q"""),
    "vector_integrity": (vector_integrity, "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_length, count(*) - count(DISTINCT vec_id) AS repeated_ids FROM embeddings"),
    "vector_norms": (vector_norms, "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings"),
    "vector_reuse": (vector_reuse, "WITH s AS (SELECT DISTINCT sha256(coalesce(text, '')) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT doc_id, sha256(coalesce(text, '')) IN (SELECT k FROM s) AS reused FROM documents"),
    "retrieval_metrics": (retrieval_metrics, f"WITH {_RUNS} SELECT * FROM m"),
    "metric_means": (metric_means, f"WITH {_RUNS} SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(udcg), 6) AS udcg, count(*) AS queries FROM m"),
    "group_kfold": (group_kfold, "SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1) % 5 AS fold FROM documents"),
    "reranker_train": (reranker_train, None),
}
