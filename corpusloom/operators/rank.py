"""Ranked retrieval: BM25, path and symbol coverage, dense cosine, reciprocal-rank fusion, a linear re-scorer.

Query terms are few and known on the driver, so postings of a query are made by filtering the corpus's tokens to them
before any shuffle: the corpus-wide part is one scan, which writes each document's length and hits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import distinct_tokens, tokenize
from ..functions.vector import dot
from ..sources.shared import materialise

K1, B, RRF_K = 1.2, 0.75, 60
SYMBOL_COVERAGE, PATH_COVERAGE, DENSE_TERMS, DENSE_K = 0.67, 0.6, 5, 64
MAX_SPANS, MAX_SPAN_BYTES = 8, 4 << 20


def term_stats(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    return docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_totals(docs: DataFrame) -> DataFrame:
    """term, df, cf: sums by term before the one shuffle, of a text's tokens and then its distinct tokens."""
    rows = docs.select(F.size("tokens").alias("n"), F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("i", "term"))
    repeat = (F.col("i") < F.col("n")).cast("long")
    return rows.groupBy("term").agg(F.sum(1 - repeat).alias("df"), F.sum(repeat).alias("cf"))


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, dl: empty documents count, with 0."""
    return docs.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n, avgdl."""
    return length_stats(docs.select(F.size("tokens").alias("dl")))


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, dl, hits (the query's terms, as often as they occur) of all documents, written once: statistics and postings
    come from it, so that texts are cut into tokens once."""
    wanted = F.array(*map(F.lit, dict.fromkeys(terms)))
    return materialise(docs.select("doc_id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: F.array_contains(wanted, t)).alias("hits")), "counted")


def matched(rows: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf of the query's distinct terms only, from counted()."""
    return rows.select("doc_id", "dl", F.explode("hits").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def length_stats(rows: DataFrame) -> DataFrame:
    """n, avgdl, from lengths (dl)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, score over 0. Statistics are the whole corpus's."""
    rows = counted(docs, terms)
    return bm25_scores(matched(rows), length_stats(rows))


def bm25_scores(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """doc_id, score over 0 from a query's postings (doc_id, dl, term, tf) and the corpus's n and avgdl."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = postings.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # df: a row a query term; statistics: one row
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score")).filter("score > 0")


def min_hits(coverage: float, n_terms: int) -> int:
    return max(1, math.ceil(coverage * n_terms))


def coverage_arm(paths: DataFrame, terms: list[str], coverage: float) -> DataFrame:
    """doc_id, hits: distinct query terms in a document's best path, where they are enough. paths: doc_id, path."""
    terms = list(dict.fromkeys(terms))
    hits = F.size(F.array_intersect(distinct_tokens(F.col("path")), F.array(*map(F.lit, terms))))
    return paths.select("doc_id", hits.alias("hits")).groupBy("doc_id").agg(F.max("hits").alias("hits")).filter(F.col("hits") >= min_hits(coverage, len(terms)))


def summed_coverage(entries: DataFrame, terms: list[str], coverage: float = SYMBOL_COVERAGE) -> DataFrame:
    """doc_id, score, start: hits of all entries (doc_id, name, start) with enough of them, and where the first best stands."""
    terms = list(dict.fromkeys(terms))
    hits = F.size(F.array_intersect(distinct_tokens(F.col("name")), F.array(*map(F.lit, terms))))
    return entries.select("doc_id", "start", hits.alias("hits")).filter(F.col("hits") >= min_hits(coverage, len(terms))).groupBy("doc_id").agg(F.sum("hits").alias("score"), F.min(F.struct((-F.col("hits")).alias("h"), "start")).alias("b")).select("doc_id", "score", F.col("b.start").alias("start"))


def dense_allowed(words: list[str], terms: list[str]) -> bool:
    """Whether a query is long enough for the dense arm."""
    return len(words) >= 2 and len(set(terms)) >= DENSE_TERMS


def dense_topk(vectors: DataFrame, query: list[float], k: int = DENSE_K, but: int | None = None) -> DataFrame:
    """vec_id, cosine of the k nearest unit vectors; ties to the lower id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if but is None else vectors.filter(F.col("vec_id") != but)
    return rows.select("vec_id", F.round(dot(F.col("embedding"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)


def best_chunks(chunks: DataFrame, query: list[float]) -> DataFrame:
    """doc_id, chunk, cosine: of each document (doc_id, chunk, embedding) the chunk nearest to a query, of equal ones the first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = F.min(F.struct((-F.round(dot(F.col("embedding"), q), 6)).alias("c"), "chunk")).alias("b")
    return chunks.groupBy("doc_id").agg(best).select("doc_id", F.col("b.chunk").alias("chunk"), (-F.col("b.c")).alias("cosine"))


def ranked(arm: DataFrame, score: str, k: int, by: str = "doc_id") -> DataFrame:
    """by, rank (from 1) of an arm's first k: pruned by a distributed top-k before the one-partition numbering of k rows."""
    top = arm.select(by, score).orderBy(F.desc(score), by).limit(k)
    return top.select(by, F.row_number().over(Window.orderBy(F.desc(score), by)).alias("rank"))


def fuse(*arms: DataFrame, by: str = "doc_id") -> DataFrame:
    """Sum of 1 / (60 + rank) over arms."""
    both = arms[0]
    for arm in arms[1:]:
        both = both.unionByName(arm)
    return both.groupBy(by).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"))


def rerank(features: list[Column], weights: list[float], bias: float) -> Column:
    """Logistic score of a linear model."""
    z = F.lit(bias)
    for f, w in zip(features, weights, strict=True):
        z = z + f * w
    return 1 / (1 + F.exp(-z))


def rank_reciprocal(rank: Column) -> Column:
    return F.coalesce(1 / (RRF_K + rank), F.lit(0.0))


def term_spans(lines: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, line of lines that contain any term, as a piece of the lower-cased line."""
    low = F.lower("line_text")
    hit = F.lit(False)
    for t in dict.fromkeys(terms):
        hit = hit | F.contains(low, F.lit(t))
    return lines.filter(hit).select("doc_id", "line")
