"""Route templates: parsing URLs into segments, and matching calls with handlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Literal segments that a match needs in common; leading placeholders that a call may lose.
LEAST_LITERALS, MOST_DROPPED = 1, 2
#: Fixed: spellings of a placeholder segment, of a catch-all, of a part of a segment.
PLACEHOLDER = r"^(\$?\{[^{}]*\}|:[A-Za-z_]\w*\??|<[^<>]+>|\[[^\[\].]+\])$"
CATCH_ALL = r"^(\*+\w*|\{\*+\w*\}|\{\w+\.\.\.\}|\[\.\.\.\w+\]|:\w+\*)$"
PART = r"\$?\{[^{}]*\}"


def path_of(url: Column) -> Column:
    """The path of a URL: no query, fragment, scheme or authority, and no slash at either end."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(F.regexp_replace(path, r"^//[^/]*", ""), r"^/+|/+$", "")


def segments(url: Column) -> Column:
    """array<struct<kind, text>>: literal, param ({}), mixed, or all; empty segments go."""
    def segment(s: Column) -> Column:
        kind = F.when(F.rlike(s, F.lit(CATCH_ALL)), "all").when(F.rlike(s, F.lit(PLACEHOLDER)), "param").when(F.rlike(s, F.lit(PART)), "mixed").otherwise("literal")
        text = F.when(kind == "param", "{}").when(kind == "all", "*").when(kind == "mixed", F.regexp_replace(s, PART, "{}")).otherwise(F.lower(s))
        return F.struct(kind.alias("kind"), text.alias("text"))

    return F.transform(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), segment)


def template(url: Column) -> Column:
    """A URL's template as text."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(url), lambda s: s["text"]), "/"))


def _align(call: Column, handler: Column, prefix: Column) -> Column:
    """2: exact, 1: parameterised, 0: no match."""
    nc, nh = F.size(call), F.size(handler)
    all_h = (nh > 0) & (F.get(handler, nh - 1)["kind"] == "all")
    all_c = (nc > 0) & (F.get(call, nc - 1)["kind"] == "all")
    lone = lambda a: F.when(a, 1).otherwise(0)
    # segments that face each other one by one: up to a catch-all at the end of either side
    face = F.least(nc - lone(all_c), nh - lone(all_h))
    pairs = F.when(face > 0, F.arrays_zip(F.slice(call, 1, face).alias("c"), F.slice(handler, 1, face).alias("h"))).otherwise(F.arrays_zip(F.slice(call, 1, 0).alias("c"), F.slice(handler, 1, 0).alias("h")))
    literal = lambda p: (p["c"]["kind"] == "literal") & (p["h"]["kind"] == "literal")
    agree = F.forall(pairs, lambda p: ~literal(p) | (p["c"]["text"] == p["h"]["text"]))
    same = F.forall(pairs, lambda p: (p["c"]["kind"] == p["h"]["kind"]) & (p["c"]["text"] == p["h"]["text"]))
    literals = F.size(F.filter(pairs, literal))
    # what is left over on either side
    rest = (nc == nh) & ~all_c & ~all_h | all_h & (nc - lone(all_c) >= nh - 1) & ((nc >= nh) | all_c) | all_c & (nh >= nc) | prefix & (nc > nh) & ~all_h
    exact = same & (nc == nh) & (all_c == all_h)
    return F.when(agree & rest & (literals >= LEAST_LITERALS), F.when(exact, 2).otherwise(1)).otherwise(0)


def quality(call: Column, handler: Column, prefix: Column | None = None) -> Column:
    """Exact, Parameterized or NoMatch: a call's segments against a handler's, up to MOST_DROPPED leading placeholders lost."""
    prefix = F.lit(False) if prefix is None else prefix
    best = F.when(_align(call, handler, prefix) == 2, "Exact").when(_align(call, handler, prefix) == 1, "Parameterized")
    for n in range(1, MOST_DROPPED + 1):
        lost = F.forall(F.slice(call, 1, n), lambda s: s["kind"].isin("param", "mixed"))
        left = F.slice(call, n + 1, F.greatest(F.size(call) - n, F.lit(0)))
        best = best.when((F.size(call) > n) & lost & (_align(left, handler, prefix) > 0), "Parameterized")
    return best.otherwise("NoMatch")


def match_routes(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """call_id, handler_id, quality, tier of every match. calls: call_id, url, verb; handlers: handler_id, route, verb, repo.

    Only pairs with a literal segment in common can match, so both sides are joined on their literals and each pair is
    compared once. A call with one distinct destination is a Pattern, otherwise a Candidate.
    """
    c = calls.select("call_id", segments(F.col("url")).alias("cs"), F.col("verb").alias("cv"))
    h = handlers.select("handler_id", segments(F.col("route")).alias("hs"), F.col("verb").alias("hv"))
    texts = lambda s: F.array_distinct(F.transform(F.filter(s, lambda x: x["kind"] == "literal"), lambda x: x["text"]))
    met = c.withColumn("t", F.explode(texts(F.col("cs")))).join(h.withColumn("t", F.explode(texts(F.col("hs")))), "t")
    # each pair at its first common literal only
    first = F.get(F.array_intersect(texts(F.col("cs")), texts(F.col("hs"))), F.lit(0))
    met = met.filter((F.col("t") == first) & (F.col("cv").isNull() | F.col("hv").isNull() | (F.col("cv") == F.col("hv"))))
    found = met.withColumn("quality", quality(F.col("cs"), F.col("hs"))).filter("quality <> 'NoMatch'")
    n = F.size(F.collect_set("handler_id").over(Window.partitionBy("call_id")))
    return found.select("call_id", "handler_id", "quality", F.when(n == 1, "Pattern").otherwise("Candidate").alias("tier"))


def report(calls: DataFrame, handlers: DataFrame, found: DataFrame) -> DataFrame:
    """One row: handlers, calls, calls that matched, edges."""
    one = found.agg(F.count_distinct("call_id").alias("matched"), F.count(F.lit(1)).alias("edges"))
    return handlers.agg(F.count(F.lit(1)).alias("handlers")).crossJoin(calls.agg(F.count(F.lit(1)).alias("calls"))).crossJoin(one)  # one row each
