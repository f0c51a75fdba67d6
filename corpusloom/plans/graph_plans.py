"""Routes, manifests, graphs and facts. Foreign keys of the tables are the edges, each kind with its type and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, facts, graph, grep, manifests, routes, symbols
from ..session import table
from ..streaming.ingest import event_windows

#: table, source key, source prefix, target key, target prefix, type, tier
_KEYS = (
    ("nation", "n_nationkey", "n", "n_regionkey", "r", "depends_on", 4),
    ("supplier", "s_suppkey", "s", "s_nationkey", "n", "imports", 3),
    ("customer", "c_custkey", "c", "c_nationkey", "n", "calls", 2),
    ("orders", "o_orderkey", "o", "o_custkey", "c", "calls", 2),
    ("lineitem", "l_orderkey", "o", "l_partkey", "p", "references", 1),
    ("lineitem", "l_partkey", "p", "l_suppkey", "s", "consumes", 2),
)
_EDGES_SQL = "raw AS (" + " UNION ALL ".join(f"SELECT '{sp}' || {s} AS src, '{tp}' || {t} AS dst, '{kind}' AS type, {tier} AS tier, '{tab}' AS evidence FROM {tab}" for tab, s, sp, t, tp, kind, tier in _KEYS) + "), edges AS (SELECT src, dst, type, max(tier) AS tier, min(evidence) AS evidence FROM raw GROUP BY ALL)"


def _raw_edges(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tab, s, sp, t, tp, kind, tier in _KEYS:
        rows = table(spark, d, tab).select(F.concat(F.lit(sp), s).alias("src"), F.concat(F.lit(tp), t).alias("dst"), F.lit(kind).alias("type"), F.lit(tier).alias("tier"), F.lit(tab).alias("evidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _edges(spark, d):
    return graph.deduplicated(_raw_edges(spark, d))


def _roots(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def edges_dedup(spark, d):
    return _edges(spark, d)


def edge_upgrade(spark, d):
    """Every second customer edge is seen again as Proven."""
    raw = _raw_edges(spark, d)
    again = raw.filter("evidence = 'customer' AND CAST(substring(src, 2) AS LONG) % 2 = 0").withColumn("tier", F.lit(4)).withColumn("evidence", F.lit("again"))
    return graph.deduplicated(raw.unionByName(again)).groupBy("type", "tier", "evidence").agg(F.count(F.lit(1)).alias("n"))


def trace_calls(spark, d):
    return graph.traverse(_raw_edges(spark, d), _roots(spark, "o1", "o2", "o3"), 2, graph.TRACES["calls"], direction="out")


def impact_closure(spark, d):
    return graph.traverse(_raw_edges(spark, d), _roots(spark, "r1"), 3)


def trace_consumers(spark, d):
    return graph.traverse(_raw_edges(spark, d), _roots(spark, "s1", "s2"), 1, graph.TRACES["consumers"])


def graph_neighbors(spark, d):
    return graph.traverse(_raw_edges(spark, d), _roots(spark, "n3"), 1, direction="both", floor=2)


def neighbour_lanes(spark, d):
    return graph.neighbours(_edges(spark, d), _roots(spark, "n1", "n2", "c1", "c2"))


def graph_schema(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select(F.substring("node", 1, 1).alias("kind"))
    return graph.schema(nodes, edges)


def tier_counts(spark, d):
    return graph.counts_by_tier(_edges(spark, d)).withColumn("score", graph.tier_score(F.col("tier")))


def fan_out_percentiles(spark, d):
    return graph.fan_out(_edges(spark, d).filter("type = 'references'")).select(*[F.col(c).cast("long").alias(c) for c in ("p50", "p90", "p99")])


def traversal_budget(spark, d):
    return graph.truncated(_edges(spark, d))


def connected_roots(spark, d):
    return graph.connected_roots(_roots(spark, "r1", "r99", "n1"), _edges(spark, d).filter("type = 'depends_on'"))


def result_order(spark, d):
    """Nodes near a region, with customers' and suppliers' segments and names as places, in the order of an answer."""
    edges = _raw_edges(spark, d).filter("type IN ('depends_on', 'imports', 'calls')")
    near = graph.traverse(edges.filter("evidence <> 'orders'"), _roots(spark, "r1"), 2)
    places = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("./a/b/"), F.col("n_nationkey") % 3, F.lit("/x")).alias("path"), F.col("n_name").alias("symbol"), (F.col("n_nationkey") % 2).cast("string").alias("repo"))
    places = places.unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.concat(F.lit("a/"), F.col("c_custkey") % 4, F.lit("/"), F.col("c_custkey") % 3, F.lit("/x")).alias("path"), F.col("c_name").alias("symbol"), (F.col("c_custkey") % 5).cast("string").alias("repo")))
    nodes = near.join(places, F.col("node") == F.col("key")).select("node", "hop", "tier", "symbol", "repo", "path")
    return graph.result_order(nodes, [("1", "a/b/2/root"), ("3", "./a/3/1/root")], 200).select("place", "node", "same_repo", F.col("depth").cast("long").alias("depth"))


def call_audit(spark, d):
    """Orders are call sites, parts their targets, suppliers modulo 3 the repositories; every fourth order is confirmed."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("target"), (F.col("l_suppkey") % 3).alias("repo"))
    return graph.call_audit(rows, rows, rows.filter("site % 4 = 0"))


def name_sweep(spark, d):
    """First words of documents are the names."""
    return symbols.sweep(table(spark, d, "documents").select(F.get(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0)).alias("name")))


def cross_shard(spark, d):
    """Supplier numbers modulo 150 are defined, customer numbers modulo 200 used, in shards by nation."""
    defs = table(spark, d, "supplier").select((F.col("s_suppkey") % 150).alias("name"), (F.col("s_nationkey") % 3).alias("shard"))
    return symbols.cross_shard(defs, table(spark, d, "customer").select((F.col("c_custkey") % 200).alias("name"), (F.col("c_nationkey") % 3).alias("shard")))


def name_join(spark, d):
    """Customers of equal names' last digits, across nations."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.substring("c_name", -4, 4).alias("name"), F.col("c_nationkey").alias("repo"))
    defs = table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("target"), F.substring("s_name", -4, 4).alias("name"), F.col("s_nationkey").alias("repo"))
    return graph.same_name_edges(own, defs)


def communities(spark, d):
    return graph.communities(_edges(spark, d).filter("type IN ('depends_on', 'imports')"))


def list_repos(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("files"))


def file_tree(spark, d):
    """The first 2000 paths of a repository below a folder."""
    files = corpus.files_of(table(spark, d, "documents")).filter("repo = 'src1'").select("doc_id", "rel_path")
    return files.filter(corpus.under(F.col("rel_path"), "en")).orderBy("rel_path").limit(2000)


def read_source(spark, d):
    """Lines 2 to 501 of a file found by its path, or else by the end of one."""
    files = corpus.files_of(table(spark, d, "documents"))
    file = files.filter(F.col("rel_path").endswith("/8")).orderBy(F.length("rel_path"), "repo", "rel_path").limit(1)
    return corpus.lines_of(file, "rel_path").filter(F.col("line").between(2, 501)).select("rel_path", F.col("line").cast("long").alias("line"), "line_text")


def list_symbols(spark, d):
    """The first 200 names by order, shown by kind."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind")).distinct()
    return names.orderBy("name", "kind").limit(200).orderBy("kind", "name")


def url_template(spark, d):
    return table(spark, d, "pages").select("page_id", routes.template(F.col("url")).alias("template"))


_HANDLERS = (("h1", "en/{id}"), ("h2", "/fr/:id"), ("h3", "de/{*rest}"), ("h4", "/{lang}/{id}"), ("h5", "en/770"), ("h6", "es/{id}/more"))


def _calls(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("call_id"), "url", F.lit(None).cast("string").alias("verb"))


def _handlers(spark):
    return spark.createDataFrame([(h, r, None) for h, r in _HANDLERS], "handler_id string, route string, verb string")


def route_match(spark, d):
    return routes.match_routes(_calls(spark, d), _handlers(spark))


def route_report(spark, d):
    calls, handlers = _calls(spark, d), _handlers(spark)
    return routes.report(calls, handlers, routes.match_routes(calls, handlers))


def html_tags(spark, d):
    """Tags of pages and how many pages have them: what a selector registry is joined with."""
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9-]*)[\s>/]"), 1))
    return table(spark, d, "pages").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("pages"))


def dependency_names(spark, d):
    return table(spark, d, "part").select("p_partkey", manifests.normalised_name(F.lit("pypi"), F.regexp_replace("p_name", " ", "_.")).alias("name"))


def manifest_resolve(spark, d):
    """Customers require the Go path of their nation and number; suppliers provide paths."""
    need = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("repo"), F.lit("go").alias("ecosystem"), F.concat(F.lit("x/"), "c_nationkey", F.lit("/"), F.col("c_custkey") % 7, F.lit("/pkg")).alias("name"))
    have = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 40).alias("repo"), F.lit("go").alias("ecosystem"), F.concat(F.lit("x/"), "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/"), F.col("s_suppkey") % 7)).otherwise("")).alias("name"))
    return manifests.resolve(need, have)


def enclosing_span(spark, d):
    """The line around every find of a word, by a range join in bins."""
    files = corpus.files_of(table(spark, d, "documents"))
    at = grep.occurrences(files, "License", "doc_id").select(F.col("doc_id").alias("key"), "at")
    lines = corpus.lines_of(files.filter(F.contains("content", F.lit("License"))), "doc_id")
    before = F.coalesce(F.sum(F.length("line_text") + 1).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    defs = lines.select(F.col("doc_id").alias("key"), F.col("line").cast("string").alias("name"), before.cast("long").alias("start"), F.length("line_text").alias("n")).select("key", "name", "start", (F.col("start") + F.col("n") + 1).alias("body_end"))
    return symbols.enclosing(at, defs)


def _facts(spark, d):
    """Order lines as bindings: a customer's order calls a part, in the source of a supplier."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    bindings = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("binding_id"), F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.col("l_shipmode" if "l_shipmode" in line.columns else "l_linestatus").alias("context_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("end"), F.concat(F.lit("c"), "o_custkey").alias("caller_id"), F.concat(F.lit("p"), "l_partkey").alias("callee_id"))
    sources = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.col("s_nationkey").cast("string").alias("repo"), F.col("s_name").alias("path"))
    impl = table(spark, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 50 + 1).cast("string")).alias("interface_id"), F.concat(F.lit("p"), "p_partkey").alias("implementation_id"))
    return bindings, sources, impl


_FACTS_SQL = "b AS (SELECT l_orderkey || '-' || l_linenumber AS binding_id, 's' || l_suppkey AS source_id, l_linenumber AS start, l_linenumber + l_quantity::INT AS \"end\", 'c' || o_custkey AS caller_id, 'p' || l_partkey AS callee_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey), im AS (SELECT 'p' || (p_partkey % 50 + 1) AS interface_id, 'p' || p_partkey AS implementation_id FROM part)"


def facts_binding_at(spark, d):
    bindings, sources, _ = _facts(spark, d)
    file = sources.filter("source_id = 's3'").first()
    return facts.bindings_at(bindings, sources, file["repo"], file["path"], 10).select("binding_id", "caller_id", "callee_id")


def facts_trace_calls(spark, d):
    bindings, _, _ = _facts(spark, d)
    return graph.traverse(graph.deduplicated(facts.call_edges(bindings)), _roots(spark, "p7"), 2)


def facts_contract_impact(spark, d):
    bindings, _, impl = _facts(spark, d)
    return facts.contract_impact(bindings, impl, "p60")


def facts_integrity(spark, d):
    """Every fifth source is gone, and every seventh line of an order ends before it starts."""
    bindings, sources, _ = _facts(spark, d)
    sources = sources.filter("CAST(substring(source_id, 2) AS LONG) % 5 <> 0")
    bindings = bindings.withColumn("end", F.when(F.col("start") == 7, F.col("start") - 1).otherwise(F.col("end")))
    return facts.dangling(bindings, "source_id", sources, "source_id").agg(F.count(F.lit(1)).alias("dangling")).crossJoin(facts.bad_spans(bindings).agg(F.count(F.lit(1)).alias("bad_spans")))  # one row each


def events_by_hour(spark, d):
    """Event-time windows: beside the reference's own operators, as is the same plan on a stream."""
    return event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


def _lanes_sql() -> str:
    parts = []
    for lane, types, direction in graph.LANES:
        here, to = ("dst", "src") if direction == "in" else ("src", "dst")
        parts.append(f"SELECT '{lane}' AS lane, {here} AS anchor, {to} AS node, tier FROM edges WHERE tier >= 2 AND type IN ('" + "','".join(types) + "')")
    return f"WITH {_EDGES_SQL}, l AS ({' UNION ALL '.join(parts)}), m AS (SELECT lane, anchor, node, max(tier) AS tier FROM l WHERE anchor IN ('n1', 'n2', 'c1', 'c2') GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY lane, anchor ORDER BY tier DESC, node) AS rank FROM m QUALIFY rank <= 25"


def _hops(first: str, step: str, hops: int) -> str:
    """A traversal's SQL: levels, each with the best weakest tier; step gives here, node, edge tier."""
    levels = [f"l0 AS ({first})"]
    for h in range(1, hops + 1):
        levels.append(f"l{h} AS (SELECT s.node, {h} AS hop, max(least(l.tier, s.tier)) AS tier FROM l{h - 1} l JOIN st s ON s.here = l.node GROUP BY s.node)")
    union = " UNION ALL ".join(f"SELECT node, hop, tier FROM l{h}" for h in range(hops + 1))
    return f"WITH {_EDGES_SQL}, st AS ({step}), {', '.join(levels)} SELECT node, min(hop) AS hop, max(tier) AS tier FROM ({union}) GROUP BY node"


def _first(*nodes: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS node, 0 AS hop, 4 AS tier" for n in nodes)


_ROUTES_SQL = r"""WITH c AS (SELECT page_id, string_split(lower(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/')), '/') AS s FROM pages),
      m AS (SELECT page_id AS call_id, 'h1' AS handler_id, 'Parameterized' AS quality FROM c WHERE len(s) = 2 AND s[1] = 'en' UNION ALL SELECT page_id, 'h2', 'Parameterized' FROM c WHERE len(s) = 2 AND s[1] = 'fr' UNION ALL SELECT page_id, 'h3', 'Parameterized' FROM c WHERE s[1] = 'de' AND len(s) >= 2 UNION ALL SELECT page_id, 'h5', 'Exact' FROM c WHERE s = ['en', '770'] UNION ALL SELECT page_id, 'h6', 'Parameterized' FROM c WHERE len(s) = 3 AND s[1] = 'es' AND s[3] = 'more')
      SELECT *, CASE WHEN count(*) OVER (PARTITION BY call_id) = 1 THEN 'Pattern' ELSE 'Candidate' END AS tier FROM m"""

QUERIES = {
    "edges_dedup": (edges_dedup, f"WITH {_EDGES_SQL} SELECT * FROM edges"),
    "edge_upgrade": (edge_upgrade, f"WITH {_EDGES_SQL}, both_ AS (SELECT * FROM raw UNION ALL SELECT src, dst, type, 4, 'again' FROM raw WHERE evidence = 'customer' AND substr(src, 2)::BIGINT % 2 = 0), u AS (SELECT src, dst, type, max(tier) AS tier, arg_min(evidence, (-tier, evidence)) AS evidence FROM both_ GROUP BY ALL) SELECT type, tier, evidence, count(*) AS n FROM u GROUP BY ALL".replace("GROUP BY ALL) SELECT type", "GROUP BY src, dst, type) SELECT type")),
    "trace_calls": (trace_calls, _hops(_first("o1", "o2", "o3"), "SELECT src AS here, dst AS node, tier FROM edges WHERE type = 'calls' AND tier >= 2", 2)),
    "impact_closure": (impact_closure, _hops(_first("r1"), "SELECT dst AS here, src AS node, tier FROM edges WHERE tier >= 2", 3)),
    "trace_consumers": (trace_consumers, _hops(_first("s1", "s2"), "SELECT dst AS here, src AS node, tier FROM edges WHERE tier >= 2 AND type IN ('publishes', 'consumes')", 1)),
    "graph_neighbors": (graph_neighbors, _hops(_first("n3"), "SELECT dst AS here, src AS node, tier FROM edges WHERE tier >= 2 UNION ALL SELECT src, dst, tier FROM edges WHERE tier >= 2", 1)),
    "neighbour_lanes": (neighbour_lanes, _lanes_sql()),
    "graph_schema": (graph_schema, f"WITH {_EDGES_SQL}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT 'node' AS what, left(node, 1) AS kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type".replace("GROUP BY ALL UNION", "GROUP BY left(node, 1) UNION")),
    "tier_counts": (tier_counts, f"WITH {_EDGES_SQL} SELECT type, tier, count(*) AS n, CASE tier WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 WHEN 3 THEN 0.85 ELSE 1.0 END::DOUBLE AS score FROM edges GROUP BY type, tier"),
    "fan_out_percentiles": (fan_out_percentiles, f"WITH {_EDGES_SQL}, k AS (SELECT count(*) AS k FROM edges WHERE type = 'references' GROUP BY src), o AS (SELECT k, row_number() OVER (ORDER BY k) AS r, count(*) OVER () AS n FROM k) SELECT min(k) FILTER (r >= ceil(n * 50 / 100)) AS p50, min(k) FILTER (r >= ceil(n * 90 / 100)) AS p90, min(k) FILTER (r >= ceil(n * 99 / 100)) AS p99 FROM o"),
    "traversal_budget": (traversal_budget, f"WITH {_EDGES_SQL} SELECT count(*) AS edges, count(*) > 10000 AS truncated FROM edges"),
    "connected_roots": (connected_roots, f"WITH {_EDGES_SQL}, r AS (SELECT unnest(['r1', 'r99', 'n1']) AS node), t AS (SELECT node FROM r WHERE node IN (SELECT src FROM edges WHERE type = 'depends_on') OR node IN (SELECT dst FROM edges WHERE type = 'depends_on')) SELECT node FROM r WHERE node IN (SELECT node FROM t) OR NOT EXISTS (SELECT 1 FROM t)"),
    "result_order": (result_order, """WITH p AS (SELECT 'n' || n_nationkey AS node, 1 AS hop, 4 AS tier, n_name AS symbol, n_nationkey % 2 = 1 AS same_repo, 2 + (n_nationkey % 3 = 2)::INT AS depth FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT 'c' || c_custkey, 2, 2, c_name, c_custkey % 5 IN (1, 3), CASE WHEN c_custkey % 4 <> 3 THEN 1 WHEN c_custkey % 3 = 1 THEN 3 ELSE 2 END FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
      SELECT row_number() OVER (ORDER BY hop, tier DESC, same_repo DESC, depth DESC, symbol, node) AS place, node, same_repo, depth FROM p QUALIFY place <= 200"""),
    "call_audit": (call_audit, """WITH p AS (SELECT DISTINCT l_orderkey AS site, l_partkey AS target FROM lineitem), k AS (SELECT site, count(*) AS k FROM p GROUP BY site),
      o AS (SELECT k, row_number() OVER (ORDER BY k) AS r, count(*) OVER () AS n FROM k), s AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) > 1)
      SELECT 'sites' AS measure, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM p UNION ALL SELECT 'max', max(k) FROM k
      UNION ALL SELECT '1', count(*) FROM k WHERE k = 1 UNION ALL SELECT '2-4', count(*) FROM k WHERE k BETWEEN 2 AND 4 UNION ALL SELECT '5-16', count(*) FROM k WHERE k BETWEEN 5 AND 16
      UNION ALL SELECT '17-64', count(*) FROM k WHERE k BETWEEN 17 AND 64 UNION ALL SELECT '65+', count(*) FROM k WHERE k > 64
      UNION ALL SELECT 'definitions', count(DISTINCT target) FROM p UNION ALL SELECT 'p50', min(k) FROM o WHERE r >= ceil(n * 50 / 100) UNION ALL SELECT 'p95', min(k) FROM o WHERE r >= ceil(n * 95 / 100)
      UNION ALL SELECT 'several_repos', count(*) FROM s UNION ALL SELECT 'covered', count(*) FROM k WHERE site % 4 = 0"""),
    "name_sweep": (name_sweep, r"WITH n AS (SELECT DISTINCT string_split(coalesce(text, ''), ' ')[1] AS name FROM documents), g AS (SELECT regexp_matches(name, '^\p{Lu}') AND strlen(name) >= 3 AS ok FROM n) SELECT count(*) AS names, count(*) FILTER (ok) AS generated, count(*) FILTER (NOT ok) AS excluded FROM g"),
    "cross_shard": (cross_shard, "WITH d AS (SELECT s_suppkey % 150 AS name, s_nationkey % 3 AS shard FROM supplier), u AS (SELECT DISTINCT c_custkey % 200 AS name, c_nationkey % 3 AS shard FROM customer) SELECT DISTINCT name FROM u WHERE (SELECT count(DISTINCT shard) FROM d WHERE d.name = u.name) > 1 OR NOT EXISTS (SELECT 1 FROM d WHERE d.name = u.name AND d.shard = u.shard)"),
    "name_join": (name_join, "SELECT c_custkey AS site, -s_suppkey AS target, right(c_name, 4) AS name, CASE WHEN c_nationkey = s_nationkey THEN 2 ELSE 1 END AS tier FROM customer JOIN supplier ON right(c_name, 4) = right(s_name, 4) WHERE c_custkey <> -s_suppkey"),
    "communities": (communities, None),
    "list_repos": (list_repos, "SELECT source AS repo, count(*) AS files FROM documents GROUP BY source"),
    "file_tree": (file_tree, "SELECT doc_id, lang || '/' || doc_id AS rel_path FROM documents WHERE source = 'src1' AND lang = 'en' ORDER BY rel_path LIMIT 2000"),
    "read_source": (read_source, "WITH f AS (SELECT lang || '/' || doc_id AS rel_path, string_split(text, chr(10)) AS ls, text FROM documents WHERE doc_id = 8), l AS (SELECT rel_path, unnest(range(1, len(ls) + 1 - (text LIKE '%' || chr(10))::INT)) AS line, ls FROM f) SELECT rel_path, line, ls[line] AS line_text FROM l WHERE line BETWEEN 2 AND 501"),
    "list_symbols": (list_symbols, "SELECT DISTINCT p_name AS name, p_brand AS kind FROM part ORDER BY name, kind LIMIT 200"),
    "url_template": (url_template, r"SELECT page_id, '/' || lower(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/')) AS template FROM pages"),
    "route_match": (route_match, _ROUTES_SQL),
    "route_report": (route_report, f"SELECT 6 AS handlers, (SELECT count(*) FROM pages) AS calls, count(DISTINCT call_id) AS matched, count(*) AS edges FROM ({_ROUTES_SQL})"),
    "html_tags": (html_tags, r"SELECT tag, count(*) AS pages FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9-]*)[\s>/]', 1))) AS tag FROM pages) GROUP BY tag"),
    "dependency_names": (dependency_names, r"SELECT p_partkey, lower(regexp_replace(trim(replace(p_name, ' ', '_.')), '[-_.]+', '-', 'g')) AS name FROM part"),
    "manifest_resolve": (manifest_resolve, """WITH need AS (SELECT DISTINCT 'c' || c_nationkey AS repo, 'x/' || c_nationkey || '/' || (c_custkey % 7) || '/pkg' AS name, 'x/' || c_nationkey AS k1, 'x/' || c_nationkey || '/' || (c_custkey % 7) AS k2 FROM customer),
      have AS (SELECT DISTINCT 's' || (s_suppkey % 40) AS repo, 'x/' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '/' || (s_suppkey % 7) ELSE '' END AS key FROM supplier),
      met AS (SELECT n.repo, n.name, h.repo AS provider_repo, length(key) AS len FROM need n JOIN have h ON h.key = n.k1 OR h.key = n.k2),
      best AS (SELECT * FROM met QUALIFY len = max(len) OVER (PARTITION BY repo, name))
      SELECT repo, 'go' AS ecosystem, name, provider_repo, CASE WHEN count(*) OVER (PARTITION BY repo, name) = 1 THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM best"""),
    "enclosing_span": (enclosing_span, r"""WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) - 5)) AS i FROM documents WHERE contains(text, 'License')), o AS (SELECT doc_id AS key, i - 1 AS "at", text FROM p WHERE substr(text, i, 7) = 'License'),
      l AS (SELECT key, "at", left(text, "at") AS b, text FROM o) SELECT key, "at", (1 + length(b) - length(replace(b, chr(10), '')))::VARCHAR AS name, length(b) - length(regexp_extract(b, '[^\n]*$')) AS start, "at" + length(regexp_extract(substr(text, "at" + 1), '^[^\n]*')) + 1 AS body_end FROM l"""),
    "facts_binding_at": (facts_binding_at, f"WITH {_FACTS_SQL} SELECT binding_id, caller_id, callee_id FROM b WHERE source_id = 's3' AND start <= 10 AND \"end\" > 10 ORDER BY \"end\" - start, binding_id LIMIT 100"),
    "facts_trace_calls": (facts_trace_calls, f"WITH {_FACTS_SQL} SELECT DISTINCT caller_id AS node, 1 AS hop, 4 AS tier FROM b WHERE callee_id = 'p7' UNION ALL SELECT 'p7', 0, 4"),
    "facts_contract_impact": (facts_contract_impact, f"WITH {_FACTS_SQL} SELECT DISTINCT caller_id, callee_id, callee_id <> 'p60' AS via_interface FROM b WHERE callee_id = 'p60' OR callee_id IN (SELECT interface_id FROM im WHERE implementation_id = 'p60')"),
    "facts_integrity": (facts_integrity, "SELECT count(*) FILTER (l_suppkey % 5 = 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS dangling, count(*) FILTER (l_linenumber = 7) AS bad_spans FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "events_by_hour": (events_by_hour, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
}
