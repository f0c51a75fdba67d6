"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A text's subwords are the character n-grams (N_GRAMS) of its lower-cased letters, every run of other characters
counting as one space. Each n-gram is hashed to one of BUCKETS rows of an embedding table; a text is the average of
its rows, and a linear softmax over that gives its probabilities. Both are trained together by minibatch stochastic
gradient descent in numpy, on a sample of at most about `sample` labelled rows, dealt evenly over the labels.

A fifth of the sample is held back. On it a temperature is fitted by likelihood, and the rejection threshold is set to
the `reject` quantile of the calibrated probabilities, at most MAX_THRESHOLD: so about that share of texts like the
learned ones is rejected at most. A text that is null or has no letter is `und`, with score 0, and is rejected.

Ties go to the first label in sorted order. Without any labelled row every text is `und`. Only text is read to
predict; extra columns, repeated rows and null ids make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh, table

N_GRAMS = (1, 2, 3)
BUCKETS = 1 << 13
DIMENSIONS = 16
EPOCHS = 12
BATCH = 32
RATE = 4.0
MAX_THRESHOLD = 0.4
UNDETERMINED = "und"
_LETTER = 1 << 16  # code points beyond are looked up one by one


def _letter_table() -> np.ndarray:
    """Code point of the lower-case letter for each code point below 2^16; 32 for anything else."""
    out = np.full(_LETTER, 32, np.uint32)
    for c in range(_LETTER):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text with single spaces between runs of them, and one before and after."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _TABLE[0][np.minimum(points, _LETTER - 1)]
    if len(points) and points.max() >= _LETTER:
        for i in np.flatnonzero(points >= _LETTER):
            x = chr(points[i])
            low[i] = ord(x.lower()[0]) if x.isalpha() else 32
    low = np.concatenate([[np.uint32(32)], low, [np.uint32(32)]])
    keep = low != 32
    keep[1:] |= low[:-1] != 32
    keep[0] = True
    return low[keep]


def bucket_counts(text: str, buckets: int = BUCKETS) -> np.ndarray | None:
    """How often each bucket is hit by the whole text's n-grams; None if it has no letter."""
    x = letters(text).astype(np.uint64)
    if len(x) < 3:
        return None
    total = np.zeros(buckets, np.int64)
    for n in N_GRAMS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + x[k : len(x) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((h >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return total


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # what embedding and softmax make of a bucket together: buckets x labels
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.weights / max(1, counts.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated probability, and whether it is rejected."""
        counts = bucket_counts(text) if text else None
        if counts is None or not self.labels:
            return UNDETERMINED, 0.0, True
        p = softmax(self.logits(counts)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], reject: float, seed: int = 7) -> Model:
    """counts: buckets that are hit and how often, by text."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    order = rng.permutation(len(y))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    embedding = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            x[i, counts[r][0]] = counts[r][1] / counts[r][1].sum()
        return x

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            x = dense(rows)
            h = x @ embedding
            g = softmax(h @ weights + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            step = x.T @ (g @ weights.T)
            weights -= rate * (h.T @ g)
            bias -= 0.1 * rate * g.sum(axis=0)
            embedding -= 50 * rate * step  # an average spreads a text's gradient thinly over its rows
        rng.shuffle(train)
    table_ = embedding @ weights
    temperature, threshold = 1.0, 0.0
    if len(held):
        z = np.concatenate([dense(held[i : i + 256]) @ table_ + bias for i in range(0, len(held), 256)])
        loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.25, 8, 31)}
        temperature = float(min(loss, key=loss.get))
        threshold = min(MAX_THRESHOLD, float(np.quantile(softmax(z / temperature).max(axis=1), reject)))
    return Model(names, table_.astype(np.float32), bias, temperature, threshold)


def train(docs: DataFrame, usable: Column | None = None, sample: int = 4000, reject: float = 0.001, most_labels: int = 4096) -> Model:
    """Fit on about `sample` rows with a label, evenly over the labels; which rows depends on a hash of doc_id alone.

    Every label is learned; more than most_labels of them are no languages, and an error.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(usable) if usable is not None else rows
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_labels + 1).collect()}
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} distinct labels")
    if not sizes:
        return fit([], [], reject)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / len(sizes) / n))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [bucket_counts(t) for t in pdf["text"]]
            rows = [(i, l, np.flatnonzero(c)) + (c,) for i, l, c in zip(pdf["doc_id"], pdf["lang"], found, strict=True) if c is not None]
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "lang": [r[1] for r in rows], "at": [r[2].astype(np.int32).tobytes() for r in rows], "n": [r[3][r[2]].astype(np.int32).tobytes() for r in rows]})

    got = chosen.select("doc_id", "text", "lang").mapInPandas(features, "doc_id long, lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["at"]))
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in got], [r["lang"] for r in got], reject)


def predicted(model: Model) -> Column:
    """The text's language as a struct column (lang, score, rejected)."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return run("text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, usable=crc_mod("doc_id", 4) != 2)
    found = docs.select("doc_id", predicted(model).alias("found"))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))


def keep_recognised(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose language is not rejected, with docs' own columns."""
    name = fresh("found", docs.columns)
    return docs.withColumn(name, predicted(train(docs, **options))).filter(~F.col(name)["rejected"]).select(*docs.columns)
