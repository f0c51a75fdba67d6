"""Mixing sources to target weights, by soft membership, in DataFrame functions alone.

A naive Bayes classifier over hashed words (presence, smoothed, each word's log-odds shrunk by its own standard error),
fitted on three quarters of a bounded sample of the labelled table and calibrated on the fourth by a slope and a constant
for each domain, gives each document posteriors over domains (prose, noisy, toxic: see DOMAINS). Nonnegative rates r,
expected copies of each document, are then fitted so that the expected tokens of domain k, the sum of r * tokens * p_k,
match target_k * budget:

    minimise  1/2 sum_k (T_k / N - target_k * budget / N)^2 + RIDGE / 2 sum_d (n_d / N) (r_d - budget)^2   over r >= 0

by projected gradient. A document's gradient is n_d / N times p_d . e plus the ridge, with e the domains' residuals, so
steps are taken along p_d alone: they are preconditioned by n_d / N and by the Gram matrix of the posteriors of documents
whose rate is above zero, and summed before they are projected (dual averaging), so that r_d = max(0, budget - p_d . m)
with three multipliers m. Each step is one distributed aggregate over all documents' unrounded posteriors: residuals and
Gram matrix. No state is kept between steps, and a lost executor repeats one small scan. The fit ends when the conditions
of the minimum hold to TOLERANCE; Fit.gap says how far the totals are from the targets then, Fit.converged whether it did.

Null and empty texts have the calibrated priors as posteriors and one token. Without labelled rows the posteriors are even.
Null labels are ignored; of repeated labels of a document the highest quality and toxicity count. Repeated rows get
equal rates, and very long texts count whole. An empty table gives no rows. Extra columns are not read,
and pass through mix() whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, table
from .packing import estimated_tokens

BUCKETS = 16_384
#: Labelled rows that the classifier is fitted on, about.
SAMPLE = 20_000
#: A word's log-odds x with standard error e weigh x * z^2 / (z^2 + SHRINK), with z = x / e.
SHRINK = 25.0
RIDGE = 1e-4
STEPS, TOLERANCE = 60, 1e-6
DOMAINS = ("prose", "noisy", "toxic")
#: Share of tokens that each domain shall have.
TARGETS = {"prose": 0.86, "noisy": 0.08, "toxic": 0.06}
_BLANK = "\t\n\x0b\x0c\r.,;:?()[]{}\"'"


def words(text: Column) -> Column:
    """Lower-case words between white space and marks."""
    return F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), _BLANK, " " * len(_BLANK)), " "), lambda w: w != "")


def buckets(text: Column) -> Column:
    """Distinct hashes of a text's words."""
    return F.array_distinct(F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def domain(quality: Column, toxic: Column) -> Column:
    """Index into DOMAINS."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).otherwise(0)


def _numbers(values) -> Column:
    """A literal array that the optimiser folds into one constant."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def _summed(bs: Column, weights: Column) -> Column:
    return F.aggregate(bs, F.lit(0.0), lambda s, b: s + F.get(weights, b))


@dataclass
class Classifier:
    """weights: by domain but the first, each bucket's log-odds against the first; slopes and constants: their calibration."""

    weights: list[list[float]]
    slopes: list[float]
    constants: list[float]

    def evidence(self, text: Column) -> Column:
        """array<double>: the sum of weights of each domain but the first."""
        tables = [_numbers(w) for w in self.weights]
        # a one-element array binds the buckets, so that they are computed once
        sums = F.transform(F.array(buckets(text)), lambda bs: F.array(*[_summed(bs, t) for t in tables]))
        return F.get(sums, F.lit(0))

    def posteriors(self, text: Column) -> Column:
        """array<double> over DOMAINS."""
        scores = F.transform(F.array(self.evidence(text)), lambda s: F.array(F.lit(0.0), *[F.get(s, F.lit(k)) * a + c for k, (a, c) in enumerate(zip(self.slopes, self.constants, strict=True))]))
        exps = F.transform(scores, lambda z: F.transform(z, lambda s: F.exp(s - F.array_max(z))))
        return F.get(F.transform(exps, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))), F.lit(0))


def calibrate(evidence: np.ndarray, k: np.ndarray, steps: int = 50) -> tuple[list[float], list[float]]:
    """A slope and a constant for each domain but the first, that make the held-back rows (evidence, domain k) likeliest: Newton's
    method with a small ridge towards a slope of one and the rows' own frequencies."""
    m = evidence.shape[1]
    n = np.bincount(k, minlength=m + 1) + 1.0
    start = np.concatenate([np.ones(m), np.log(n[1:] / n[0])])
    b, ridge = start.copy(), 0.5
    for _ in range(steps if len(k) else 0):
        z = np.concatenate([np.zeros((len(k), 1)), evidence * b[:m] + b[m:]], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        # of each row: the derivatives of its scores by the 2m parameters
        x = np.zeros((len(k), m, 2 * m))
        for j in range(m):
            x[:, j, j], x[:, j, m + j] = evidence[:, j], 1.0
        apart = p[:, 1:] - (k[:, None] == np.arange(1, m + 1))
        g = np.einsum("ij,ijp->p", apart, x) + ridge * (b - start)
        w = np.einsum("ij,jl->ijl", p[:, 1:], np.eye(m)) - p[:, 1:, None] * p[:, None, 1:]
        h = np.einsum("ijp,ijl,ilq->pq", x, w, x) + ridge * np.eye(2 * m)
        step = np.linalg.solve(h, g)
        b -= step / max(1.0, np.abs(step).max() / 2)
    return [float(max(0.0, a)) for a in b[:m]], [float(c) for c in b[m:]]


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """About `sample` labelled rows, chosen by a hash of doc_id, are read: their ids are what is broadcast."""
    own = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    n = own.count()
    own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < 1e6 * min(1.0, sample / max(1, n)))
    own = own.select(F.col("doc_id").alias("labelled_id"), domain(F.col("q"), F.col("t")).alias("k"), (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0).alias("held"))
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("labelled_id")).select("k", "held", buckets(F.col("text")).alias("bs"))
    rows = materialise(rows, "labelled")
    many = len(DOMAINS)
    sizes, counts = np.zeros(many), np.zeros((many, BUCKETS))
    for r in rows.filter("NOT held").groupBy("k").count().collect():
        sizes[r["k"]] = r["count"]
    for r in rows.filter("NOT held").select("k", F.explode("bs").alias("b")).groupBy("k", "b").count().collect():  # domains x BUCKETS rows at most
        counts[r["k"], r["b"]] = r["count"]
    if not sizes.sum():
        return Classifier([[0.0] * BUCKETS] * (many - 1), [1.0] * (many - 1), [0.0] * (many - 1))
    # a word's share of each domain's documents, and one document's share of all: words that no row has tell nothing
    odds = np.log(counts / np.maximum(sizes, 1)[:, None] + 1 / sizes.sum())
    odds = odds[1:] - odds[0]
    z2 = odds**2 / (1 / (counts[1:] + 0.5) + 1 / (counts[0] + 0.5))
    model = Classifier((odds * z2 / (z2 + SHRINK)).tolist(), [], [])
    tables = [_numbers(w) for w in model.weights]
    held = rows.filter("held").select("k", *[_summed(F.col("bs"), t).alias(f"e{i}") for i, t in enumerate(tables)]).collect()  # a fourth of the sample
    evidence = np.array([[r[f"e{i}"] for i in range(many - 1)] for r in held]).reshape(-1, many - 1)
    model.slopes, model.constants = calibrate(evidence, np.array([r["k"] for r in held], np.int64))
    return model


@dataclass
class Fit:
    """multipliers: the sum of all steps; gap: the farthest that a domain's share of tokens is from its target, in shares of
    the tokens that were to be drawn from; converged: whether the conditions of the minimum hold."""

    multipliers: list[float]
    gap: float
    converged: bool
    steps: int = 0


def rate(p: Column, multipliers: list[float], budget: float = 1.0) -> Column:
    """A document's rate: the budget less all steps, projected."""
    moved = F.lit(float(budget))
    for k, m in enumerate(multipliers):
        moved = moved - F.get(p, F.lit(k)) * float(m)
    return F.greatest(F.lit(0.0), moved)


def fit_rates(weighed: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> Fit:
    """weighed: n_tokens and p (posteriors) of all documents; budget: of tokens, as a share of theirs."""
    many = len(DOMAINS)
    n, p = F.col("n_tokens"), [F.get("p", F.lit(k)) for k in range(many)]
    goal = np.array([targets[k] * budget for k in DOMAINS])

    def looked(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual objective, whose minimum has the same rates, the domains' residuals and the Gram matrix."""
        r = rate(F.col("p"), m.tolist(), budget)
        above = F.when(r > 0, n).otherwise(0)
        sums = [F.sum(n * r * x).alias(f"t{k}") for k, x in enumerate(p)] + [F.sum(above * p[i] * p[j]).alias(f"g{i}{j}") for i in range(many) for j in range(many)]
        got = weighed.agg(F.sum(n).alias("n"), F.sum(n * r * r).alias("rr"), *sums).first()
        total = float(got["n"] or 0)
        if not total:
            return 0.0, np.zeros(many), np.zeros((many, many))
        e = np.array([got[f"t{k}"] for k in range(many)]) / total - goal
        return got["rr"] / total / 2 + goal @ m + RIDGE / 2 * (m @ m), e, np.array([[got[f"g{i}{j}"] for j in range(many)] for i in range(many)]) / total

    m, step = np.zeros(many), 1.0
    value, e, gram = looked(m)
    fit = Fit(m.tolist(), float(np.abs(e).max()), bool(np.abs(e).max() < TOLERANCE))
    while not fit.converged and fit.steps < STEPS:
        down = e - RIDGE * m
        move = np.linalg.solve(gram + RIDGE * np.eye(many), down)
        value2, e2, gram2 = looked(m + step * move)
        fit.steps += 1
        if value2 > value - 1e-4 * step * (down @ move) and step > 1e-6:  # too far: rates that the projection stops do not follow
            step /= 2
            continue
        m, value, e, gram, step = m + step * move, value2, e2, gram2, 1.0
        fit.multipliers, fit.gap, fit.converged = m.tolist(), float(np.abs(e).max()), bool(np.abs(e - RIDGE * m).max() < TOLERANCE)
    return fit


def copies(rate_: Column, doc_id: Column) -> Column:
    """Whole copies whose mean over documents is the rate: the fraction is settled by a hash of the id."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    return F.floor(rate_ + u).cast("long")


def rated(docs: DataFrame, labels: DataFrame, keep: list[str], targets: dict[str, float], budget: float) -> tuple[DataFrame, dict[str, str], Fit]:
    """The columns keep of docs, with tokens, posteriors p and rate under fresh names (the dict), and the fit. Texts are classified once."""
    model = fit_classifier(docs, labels)
    name = {c: fresh(c, docs.columns) for c in ("n_tokens", "p", "rate", "time")}
    weighed = materialise(docs.select(*[F.col(f"`{c}`") for c in keep], (estimated_tokens(F.col("text")) + 1).cast("long").alias(name["n_tokens"]), model.posteriors(F.col("text")).alias(name["p"])), "posteriors")
    fit = fit_rates(weighed.select(F.col(name["n_tokens"]).alias("n_tokens"), F.col(name["p"]).alias("p")), targets, budget)
    return weighed.withColumn(name["rate"], rate(F.col(name["p"]), fit.multipliers, budget)), name, fit


def weigh(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, domain, rate and copies of every row of docs; gap: how far the totals are from the targets."""
    out, name, fit = rated(docs, labels, ["doc_id"], targets, budget)
    p = F.col(name["p"])
    best = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), F.array_position(p, F.array_max(p)).cast("int"))
    r = F.col(name["rate"])
    return out.select("doc_id", F.col(name["n_tokens"]).alias("n_tokens"), *[F.get(p, F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], best.alias("domain"), r.alias("rate"), copies(r, F.col("doc_id")).alias("copies"), F.lit(fit.gap).alias("gap"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """The rows of docs, each as often as its rate says, with docs' own columns."""
    out, name, _ = rated(docs, labels, docs.columns, targets, budget)
    times = F.explode(F.array_repeat(F.lit(1), copies(F.col(name["rate"]), F.col("doc_id")).cast("int"))).alias(name["time"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], times).drop(name["time"])


def op5_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
