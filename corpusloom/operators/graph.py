"""Typed, tiered relationship graphs: building, hop-limited traversal, neighbours, discovery, communities.

Edges are (src, dst, type, tier, evidence); keys are any ids. Tiers are ordered: Candidate 1, Pattern 2, Verified 3,
Proven 4. Traversals advance a frontier by one join a hop, so a hop costs a shuffle of the frontier and of edges of
the wanted types; what was reached is written to the shared folder, never gathered on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

TIERS = {"Candidate": 1, "Pattern": 2, "Verified": 3, "Proven": 4}
SCORES = {"Candidate": 0.3, "Pattern": 0.6, "Verified": 0.85, "Proven": 1.0}
EDGE_TYPES = ("candidate", "calls", "imports", "uses_type", "references", "sibling_definition", "publishes", "consumes", "similar_to", "http_calls", "depends_on", "extends", "implements", "contains_method", "injects", "queries", "renders")
CLUSTER_TYPES = ("calls", "http_calls", "imports", "depends_on")
MOST_HOPS, EDGE_BUDGET = 10, 10_000
TRACES = {"calls": ("calls",), "consumers": ("publishes", "consumes"), "hierarchy": ("extends", "implements", "contains_method", "injects"), "queries": ("queries",), "renders": ("renders",), "impact": EDGE_TYPES}


def tier_number(name: Column) -> Column:
    return reduce(lambda c, kv: c.when(name == kv[0], kv[1]), TIERS.items(), F.when(F.lit(False), 0))


def tier_score(tier: Column) -> Column:
    return reduce(lambda c, kv: c.when(tier == TIERS[kv[0]], kv[1]), SCORES.items(), F.when(F.lit(False), 0.0))


def deduplicated(edges: DataFrame) -> DataFrame:
    """The strongest edge of each relationship (src, dst, type); ties to the least evidence."""
    best = F.min(F.struct((-F.col("tier")).alias("t"), "evidence")).alias("b")
    return edges.groupBy("src", "dst", "type").agg(best).select("src", "dst", "type", (-F.col("b.t")).alias("tier"), F.col("b.evidence").alias("evidence"))


def traverse(edges: DataFrame, roots: DataFrame, hops: int, types: tuple[str, ...] = EDGE_TYPES, floor: int = 2, direction: str = "in") -> DataFrame:
    """node, hop, tier: nodes within some hops of the roots (node). hop is the first level that meets a node; tier the
    best over paths of the weakest edge on a path, among the paths that the levels up to it saw. Roots have hop 0, tier 4.
    direction: in (who leads here), out, or both.

    Edges need not be deduplicated: the strongest between two nodes counts, taken by a hash aggregate before the shuffle. A
    single hop takes the edges at the roots alone.
    """
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 0 to {MOST_HOPS}")
    own = edges.filter(F.col("type").isin(*types) & (F.col("tier") >= floor))
    step = {"in": own.select(F.col("dst").alias("here"), F.col("src").alias("to"), "tier"), "out": own.select(F.col("src").alias("here"), F.col("dst").alias("to"), "tier")}
    step = step["in"].unionByName(step["out"]) if direction == "both" else step[direction]
    roots = materialise(roots.select("node").distinct(), "roots")  # of known size
    if hops == 1:
        step = step.join(roots.select(F.col("node").alias("here")), "here", "left_semi")
    step = step.groupBy("here", "to").agg(F.max("tier").alias("edge_tier"))
    step = materialise(step, "steps") if hops > 1 else step  # each hop reads it
    seen = roots.select("node", F.lit(0).alias("hop"), F.lit(4).alias("tier"))
    front = seen
    for hop in range(1, hops + 1):
        met = front.select("node", "tier").join(step, F.col("node") == F.col("here")).groupBy(F.col("to").alias("node")).agg(F.max(F.least("tier", "edge_tier")).alias("tier")).withColumn("hop", F.lit(hop))
        both = materialise(seen.unionByName(met.select("node", "hop", "tier")).groupBy("node").agg(F.min("hop").alias("hop"), F.max("tier").alias("tier")), "reached")
        # go on from nodes that are new or whose tier rose
        old = seen.select(F.col("node").alias("n0"), F.col("tier").alias("t0"))
        front = both.join(old, F.col("node") == F.col("n0"), "left").filter(F.col("t0").isNull() | (F.col("tier") > F.col("t0"))).select("node", "hop", "tier")
        seen = both
        if hop < hops and front.isEmpty():
            break
    return seen


def truncated(edges: DataFrame, budget: int = EDGE_BUDGET) -> DataFrame:
    """One row: edges a traversal looked at, and whether they exceed its budget."""
    return edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("truncated", F.col("edges") > budget)


def connected_roots(roots: DataFrame, relations: DataFrame) -> DataFrame:
    """Roots that some relation touches, if any is touched; else all."""
    touched = roots.join(relations.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi")
    return roots if touched.isEmpty() else touched


#: Six directed lanes of a block's neighbours: name, edge types, direction.
LANES = (("callers", ("calls",), "in"), ("callees", ("calls",), "out"), ("consumers", ("consumes", "publishes"), "in"), ("dependencies", ("depends_on", "imports"), "out"), ("dependents", ("depends_on", "imports"), "in"), ("similar", ("similar_to",), "out"))
LANE_LIMIT = 25


def neighbours(edges: DataFrame, anchors: DataFrame, floor: int = 2, limit: int = LANE_LIMIT) -> DataFrame:
    """lane, anchor, node, tier, rank: each anchor's neighbours by lane, strongest first, LANE_LIMIT of each."""
    own = edges.filter(F.col("tier") >= floor)
    parts = []
    for lane, types, direction in LANES:
        here, to = ("dst", "src") if direction == "in" else ("src", "dst")
        parts.append(own.filter(F.col("type").isin(*types)).select(F.lit(lane).alias("lane"), F.col(here).alias("anchor"), F.col(to).alias("node"), "tier"))
    rows = reduce(DataFrame.unionByName, parts).join(anchors.select(F.col("node").alias("anchor")).distinct(), "anchor", "left_semi")
    rows = rows.groupBy("lane", "anchor", "node").agg(F.max("tier").alias("tier"))
    w = Window.partitionBy("lane", "anchor").orderBy(F.desc("tier"), "node")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def result_order(nodes: DataFrame, roots: list[tuple[str, str]], limit: int) -> DataFrame:
    """The first nodes (node, hop, tier, symbol, repo, path; a row a location) of an answer, with their place: fewer hops,
    the higher tier, a repository of the roots, the longer run of folders from the top shared with a root, symbol, node.

    roots are (repo, path), the query's own few. Numbering is of the limited rows, after a distributed top-k.
    """
    folders = {tuple(p.removeprefix("./").split("/")[:-1]) for _, p in roots}
    heads = sorted({"/".join(f[: i + 1]) for f in folders for i in range(len(f))})
    parts = F.split(F.regexp_replace("path", r"^\./", ""), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    depth = F.size(F.array_intersect(above, F.array(*map(F.lit, heads)).cast("array<string>")))
    near = F.coalesce(F.col("repo").isin(sorted({r for r, _ in roots})), F.lit(False))
    own = nodes.groupBy("node", "hop", "tier", "symbol").agg(F.max(near).alias("same_repo"), F.max(F.coalesce(depth, F.lit(0))).alias("depth"))
    by = [F.asc("hop"), F.desc("tier"), F.desc("same_repo"), F.desc("depth"), F.asc("symbol"), F.asc("node")]
    return own.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)))


def schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node or edge), kind, n."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n").unionByName(edges.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def counts_by_tier(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type", "tier").agg(F.count(F.lit(1)).alias("n"))


def fan_out(edges: DataFrame, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Nearest-rank percentiles of targets a source: the value whose cumulative count first reaches ceil(p n / 100)."""
    per = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))  # one row a degree
    run = per.withColumn("upto", F.sum("c").over(Window.orderBy("k"))).crossJoin(per.agg(F.sum("c").alias("n")))
    return run.agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / 100), F.col("k"))).alias(f"p{p}") for p in percents])


#: Fixed: bins of the targets that a call site has, by their largest number.
FAN_BINS = ((1, "1"), (4, "2-4"), (16, "5-16"), (64, "17-64"), (None, "65+"))


def call_audit(calls: DataFrame, site_repos: DataFrame, covered: DataFrame) -> DataFrame:
    """measure, n: sites, edges, definitions, sites by bin of targets, p50, p95 and max of targets a site, sites in several
    repositories, sites that a language server confirmed. calls: site, target; site_repos: site, repo; covered: site."""
    pairs = calls.select("site", "target").distinct()
    per = pairs.groupBy("site").agg(F.count(F.lit(1)).alias("k"))
    bins, low = [], 0
    for high, name in FAN_BINS:
        bins.append(F.count_if((F.col("k") > low) & (F.lit(True) if high is None else F.col("k") <= high)).alias(name))
        low = high
    several = site_repos.groupBy("site").agg((F.count_distinct("repo") > 1).alias("several")).filter("several").join(per, "site", "left_semi")
    parts = [
        per.agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum("k"), F.lit(0)).alias("edges"), F.max("k").alias("max"), *bins),
        pairs.agg(F.count_distinct("target").alias("definitions")),
        fan_out(pairs.select(F.col("site").alias("src")), (50, 95)),
        several.agg(F.count(F.lit(1)).alias("several_repos")),
        per.join(covered.select("site").distinct(), "site", "left_semi").agg(F.count(F.lit(1)).alias("covered")),
    ]
    row = reduce(DataFrame.crossJoin, parts)  # one row each
    shown = [F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0).cast("long")).alias("n")) for c in row.columns]
    return row.select(F.explode(F.array(*shown)).alias("m")).select("m.measure", "m.n")


def audit_sample(calls: DataFrame, limit: int, seed: int) -> DataFrame:
    """site, targets of some sites, the same for the same seed: those of the least hashes."""
    per = calls.groupBy("site").agg(F.count_distinct("target").alias("targets"))
    return per.orderBy(F.xxhash64("site", F.lit(seed)), "site").limit(limit)


def same_name_edges(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """Candidate edges from occurrences (site, name, repo) to definitions (target, name, repo) of the name, not to themselves."""
    met = occurrences.join(definitions.withColumnRenamed("name", "n2").withColumnRenamed("repo", "target_repo"), F.col("name") == F.col("n2")).filter("site <> target")
    return met.select("site", "target", "name", F.when(F.col("repo") == F.col("target_repo"), 2).otherwise(1).alias("tier"))


def communities(edges: DataFrame, most_edges: int = 1_000_000, epsilon: float = 1e-12) -> DataFrame:
    """node, community by greedy modularity moves in node order, over eligible edges (Pattern or better, of CLUSTER_TYPES).

    The moves are sequential by definition, so they run on the driver; above most_edges edges this raises.
    """
    own = edges.filter(F.col("type").isin(*CLUSTER_TYPES) & (F.col("tier") >= 2)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    rows = own.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError("too many edges to cluster")
    near: dict = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    twice = float(sum(sum(x.values()) for x in near.values()))
    degree = {v: float(sum(x.values())) for v, x in near.items()}
    home = {v: v for v in near}
    total = dict(degree)
    moved = True
    while moved:
        moved = False
        for v in sorted(near):
            links: dict = {}
            for u, w in near[v].items():
                links[home[u]] = links.get(home[u], 0.0) + w
            total[home[v]] -= degree[v]
            stay = links.get(home[v], 0.0) - total[home[v]] * degree[v] / twice
            best, gain = home[v], stay
            for c in sorted(links):
                g = links[c] - total[c] * degree[v] / twice
                if g > gain + epsilon:
                    best, gain = c, g
            total[best] += degree[v]
            moved |= best != home[v]
            home[v] = best
    least: dict = {}
    for v in sorted(home):
        least.setdefault(home[v], v)
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    return spark.createDataFrame([(v, least[c]) for v, c in sorted(home.items())], f"node {kind}, community {kind}")
