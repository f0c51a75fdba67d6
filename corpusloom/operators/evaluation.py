"""Retrieval metrics, folds, and training of the linear re-scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNLABELLED_PENALTY = 0.5


def _gain(grade: Column) -> Column:
    return F.when(grade > 0, F.pow(F.lit(2.0), grade) - 1).otherwise(0.0)


def _discount(pos: Column) -> Column:
    return 1 / F.log2(pos + 1)


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query, recall, precision, mrr, ndcg, udcg at k. ranked: query, item, pos (from 1); gold: query, item, grade.

    Grades of 1 and more are relevant, those under 0 distract, unlabelled ones cost half. k under 1 or over the length
    means the length. An item that comes again counts at its first place, but for mrr. Queries without gold get 0.
    """
    own = ranked.join(gold, ["query", "item"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    own = own.withColumn("first", F.row_number().over(Window.partitionBy("query", "item").orderBy("pos")) == 1).withColumn("n", F.max("pos").over(Window.partitionBy("query")))
    kk = F.when((F.lit(k) <= 0) | (F.lit(k) > F.col("n")), F.col("n")).otherwise(F.lit(k))
    own = own.withColumn("kk", kk)
    counts = (F.col("pos") <= F.col("kk")) & F.col("first")
    lost = F.when(F.col("grade") >= 1, _gain(F.col("grade"))).when(F.col("grade") < 0, -_gain(-F.col("grade"))).otherwise(-UNLABELLED_PENALTY)
    per = own.groupBy("query").agg(
        F.max("kk").alias("kk"),
        F.sum(F.when(counts & (F.col("grade") >= 1), 1).otherwise(0)).alias("hits"),
        F.sum(F.when(counts, _gain(F.col("grade")) * _discount(F.col("pos"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(counts, lost * _discount(F.col("pos"))).otherwise(0.0)).alias("u"),
        F.min(F.when(F.col("grade") >= 1, F.col("pos"))).alias("first_hit"),
    )
    good = gold.filter("grade >= 1")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "item"))
    total = good.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    ideal = good.withColumn("p", place).join(per.select("query", "kk"), "query").filter("p <= kk").groupBy("query").agg(F.sum(_gain(F.col("grade")) * _discount(F.col("p"))).alias("idcg"))
    out = per.join(total, "query", "left").join(ideal, "query", "left")
    zero = lambda x, y: F.coalesce(F.round(F.when(y > 0, x / y), 6), F.lit(0.0))
    return out.select("query", zero(F.col("hits"), F.col("relevant")).alias("recall"), zero(F.col("hits"), F.col("kk")).alias("precision"), F.coalesce(F.round(1 / F.col("first_hit"), 6), F.lit(0.0)).alias("mrr"), zero(F.col("dcg"), F.col("idcg")).alias("ndcg"), zero(F.col("u"), F.col("idcg")).alias("udcg"))


METRICS = ("recall", "precision", "mrr", "ndcg", "udcg")
TIER_NAMES = ("Candidate", "Pattern", "Verified", "Proven")
#: Fixed: what floors leave below a reviewed baseline.
MEAN_SLACK, TIER_SLACK = 0.07, 0.10


def graph_metrics(nodes: DataFrame, node_gold: DataFrame, edges: DataFrame, edge_gold: DataFrame, k: int) -> DataFrame:
    """query and the metrics of a graph's answers, for queries with a relevant node or edge: of nodes and of edges, each
    ranked apart, the mean of those with relevant ones. Ranked and gold as in metrics(); an unanswered query counts 0."""
    parts = []
    for ranked, gold in ((nodes, node_gold), (edges, edge_gold)):
        asked = gold.filter("grade >= 1").select("query").distinct()
        parts.append(asked.join(metrics(ranked, gold, k), "query", "left").select("query", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in METRICS]))
    return parts[0].unionByName(parts[1]).groupBy("query").agg(*[F.round(F.avg(c), 7).alias(c) for c in METRICS])


def tier_precision(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """tier, returned, hits, precision of the four tiers: edges (query, item, tier, pos) once each, at their first place."""
    first = edges.groupBy("query", "item").agg(F.min(F.struct("pos", "tier"))["tier"].alias("tier"))
    met = first.join(gold.select("query", "item", "grade"), ["query", "item"], "left").groupBy("tier").agg(F.count(F.lit(1)).alias("returned"), F.sum((F.coalesce("grade", F.lit(0)) >= 1).cast("long")).alias("hits"))
    tiers = edges.sparkSession.createDataFrame([(t,) for t in TIER_NAMES], "tier string")
    zero = F.lit(0).cast("long")
    out = tiers.join(met, "tier", "left").select("tier", F.coalesce("returned", zero).alias("returned"), F.coalesce("hits", zero).alias("hits"))
    return out.withColumn("precision", F.when(F.col("returned") > 0, F.round(F.col("hits") / F.col("returned"), 6)).otherwise(0.0))


def calibrated_floors(report: dict[str, float], tiers: dict[str, float]) -> dict[str, float]:
    """Floors from a reviewed baseline's means and precisions by tier (the lowest tier has none)."""
    floors = {m: max(0.0, report[m] - MEAN_SLACK) for m in ("recall", "mrr", "ndcg")}
    return floors | {t: max(0.0, tiers[t] - TIER_SLACK) for t in TIER_NAMES[1:]}


def below_floors(report: dict[str, float], tiers: dict[str, float], floors: dict[str, float]) -> list[str]:
    """The names of what lies below its floor; a floor that is missing or not from 0 to 1 is an error."""
    got = {m: report[m] for m in ("recall", "mrr", "ndcg")} | {t: tiers[t] for t in TIER_NAMES[1:]}
    for name in got:
        if not 0 <= floors.get(name, float("nan")) <= 1:
            raise ValueError(f"no valid floor for {name}")
    return [name for name, value in got.items() if value < floors[name]]


def means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg", "udcg")], F.count(F.lit(1)).alias("queries"))


def group_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """fold: groups in order, dealt in turn; no group is in two folds."""
    groups = rows.select(group).distinct()
    return rows.join(groups.withColumn("fold", (F.dense_rank().over(Window.orderBy(group)) - 1) % k), group)


def train_reranker(x: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 0.1, l2: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on raw features: z-scores, stochastic gradient descent, the scaler folded in.

    Training pairs are the labelled candidates of a query set, a bounded driver-side sample by nature.
    """
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd == 0, 1.0, sd)
    z, w, b = (x - mean) / sd, np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(z)):
            g = 1 / (1 + np.exp(-(z[i] @ w + b))) - y[i]
            w -= rate * (g * z[i] + l2 * w)
            b -= rate * g
    return w / sd, float(b - (w / sd) @ mean)


def battery(terms: DataFrame, per_bucket: int = 20, seed: int = 20260622) -> DataFrame:
    """bucket, pattern: search queries drawn from a corpus's own terms (term, df), by a seeded hash.

    Frequent and rare terms, terms shorter than a gram, case-folded and non-ASCII ones, and regular expressions made of
    them. The tests search each by the planned and by the unplanned way.
    """
    long = F.length("term") >= 3
    ascii_ = F.rlike("term", F.lit(r"^[\x00-\x7F]+$"))
    kinds = (
        ("common", long & (F.col("df") >= 20), F.col("term")),
        ("rare", long & (F.col("df") <= 2), F.col("term")),
        ("short", ~long, F.col("term")),
        ("folded", long & ascii_, F.concat(F.lit("(?i)"), "term")),
        ("unicode", ~ascii_, F.col("term")),
        ("regex", long & ascii_, F.concat(F.substring("term", 1, 2), F.lit("[a-z]*"), F.expr("substring(term, -1, 1)"))),
    )
    parts = [terms.filter(c).select(F.lit(b).alias("bucket"), p.alias("pattern"), F.xxhash64("term", F.lit(b), F.lit(seed)).alias("h")).orderBy("h", "pattern").limit(per_bucket) for b, c, p in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("bucket", "pattern")


def nearest_rank(values: DataFrame, by: str, column: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Percentiles by bucket: the value at place int(p n / 100) of the sorted ones, from counts of distinct values."""
    per = values.groupBy(by, column).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by).orderBy(column)
    run = per.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return run.groupBy(by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > at(p), F.col(column))).alias(f"p{p}") for p in percents], F.max(column).alias("max"))
