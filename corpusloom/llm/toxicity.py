"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

Examples are a bounded sample of labelled rows: about SAMPLE of them, and about POSTINGS distinct words in them together.
All their words are the index's terms. A term's weight in a text is (1 + log of its count) * idf * relevance, and vectors
have length one; document frequencies are counted over all documents. Relevance is FAINT for words that the examples' labels
say nothing about and near one for telling ones (by chi-square of presence against the label), so that a few telling words
are not drowned in a long text, and texts without any are compared by plain TF-IDF. A text's words that no example has
have no weight.

Examples are dealt into blocks of BLOCK, alike ones together. A term's posting list holds (example, weight), block by
block, with the highest weight in each block. A text's blocks are looked into in the order of their upper bounds, a
growing number a round, until the next bound is below the K-th best cosine: so the K nearest are exact, ties going to
the smaller doc_id. A neighbour votes with 1 / (distance + 0.05). A logistic curve, fitted on a quarter of the sample
that is kept out of the index and weighted to the labels' own frequencies, turns vote and likeness into a probability;
texts that share no word with any example get the frequency among such texts. The neighbours that voted are evidence.

Null and empty texts have no terms. Null labels are ignored; of repeated labels the highest counts. Without both
labels in the sample every score is 0. Words are runs of letters and digits, lower-cased. Only text is read to score;
extra columns, repeated rows and null ids make no difference, texts of any length count whole, and an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialise, table

WORD = re.compile(r"[^\W_]+")
SAMPLE, POSTINGS, BLOCK, NEIGHBOURS = 2400, 800_000, 32, 15
#: Relevance of a word that tells nothing; chi-square (the 1 % level after correction for about a hundred thousand words)
#: about which it rises to one.
FAINT, TELLING = 0.01, 28.4
#: Blocks that are looked into first; each further round takes twice as many.
FIRST_BLOCKS = 8
#: Fixed: of ASCII letters and digits lower-cased, of the others a space.
_ASCII = "".join(chr(i).lower() if chr(i).isalnum() else " " for i in range(128))


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return text.translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


def relevance(df: np.ndarray, positive: np.ndarray, total: int, toxic: int) -> np.ndarray:
    """By word: df of the examples have it, positive toxic ones among them."""
    bottom = df * (total - df) * float(toxic) * (total - toxic)
    chi = total * (positive * float(total) - df * float(toxic)) ** 2 / np.maximum(bottom, 1)
    return FAINT + (1 - FAINT) * (chi**2 / (chi**2 + TELLING**2)) ** 2


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0] .. stop[0] - 1, start[1] .. stop[1] - 1, and so on."""
    n = stop - start
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """Block-max inverted index. Term t has the runs first[t] .. first[t + 1] - 1, one for each block that has it: the run's
    block, its highest weight (top), and its postings at[r] .. at[r + 1] - 1, each an example's place and weight."""

    terms: dict[str, int]
    scale: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    top: np.ndarray = field(default_factory=lambda: np.zeros(0))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, counts: Counter | dict) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and their weights, of length 1 together."""
        terms = self.terms
        found = sorted([(terms[w], c) for w, c in counts.items() if w in terms])
        at, n = np.array(found, np.int64).reshape(-1, 2).T
        return at, self.weights(at, n)

    def weights(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(n)) * self.scale[at]
        return weight / np.sqrt((weight**2).sum())

    def tally(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and how often it has each."""
        words = tokens(text)
        found = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        found = found[found >= 0]
        found.sort()
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return found[first], np.diff(first, append=len(found))

    def build(self, texts: list[Counter], ids: np.ndarray, toxic: np.ndarray) -> Index:
        vectors = [self.vector(c) for c in texts]
        rows = [i for i, (at, _) in enumerate(vectors) if len(at)]
        rows.sort(key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), int(ids[i])))  # alike ones share a block
        self.ids, self.toxic = ids[rows], toxic[rows]
        if not rows:
            self.first = np.zeros(len(self.terms) + 1, np.int64)
            return self
        term = np.concatenate([vectors[i][0] for i in rows])
        place = np.repeat(np.arange(len(rows)), [len(vectors[i][0]) for i in rows])
        weight = np.concatenate([vectors[i][1] for i in rows])
        order = np.lexsort((place, term))
        term, self.place, self.weight = term[order], place[order].astype(np.int32), weight[order]
        block = self.place // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        self.block, self.top = block[begin], np.maximum.reduceat(self.weight, begin)
        self.at = np.concatenate([begin, [len(term)]])
        self.first = np.searchsorted(term[begin], np.arange(len(self.terms) + 1))
        return self

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """Cosine and place of the k nearest examples with cosine over 0; ties by id."""
        begin, end = self.first[at], self.first[at + 1]
        runs, own = _ranges(begin, end), np.repeat(weight, end - begin)
        block = self.block.take(runs)
        bounds = np.bincount(block, own * self.top.take(runs))
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best: list[tuple[float, int, int]] = []
        size = FIRST_BLOCKS
        while len(order):
            some, order, size = order[:size], order[size:], 2 * size
            chosen = np.zeros(len(bounds), bool)
            chosen[some] = True
            now = np.flatnonzero(chosen.take(block))
            r = runs.take(now)
            start, stop = self.at.take(r), self.at.take(r + 1)
            postings = _ranges(start, stop)
            scores = np.round(np.bincount(self.place.take(postings), np.repeat(own.take(now), stop - start) * self.weight.take(postings)), 9)
            floor = -best[-1][0] if len(best) == k else 0.0
            i = np.flatnonzero((scores > 0) & (scores >= floor))
            i = i[np.lexsort((self.ids[i], -scores[i]))[:k]]
            best = sorted([*best, *zip((-scores[i]).tolist(), self.ids[i].tolist(), i.tolist(), strict=True)])[:k]
            if len(best) == k:
                order = order[bounds[order] + 1e-8 >= -best[-1][0]]
        return [(-s, i) for s, _, i in best]


@dataclass
class Model:
    index: Index
    curve: np.ndarray  # logistic: constant, vote, likeness
    without: float  # probability of texts that share no word with an example
    memory: dict = field(default_factory=dict)

    def features(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list[tuple[float, int]]] | None:
        near = self.index.nearest(at, weight) if len(at) and len(self.index.ids) else []
        if not near:
            return None
        votes = np.array([1 / (1.05 - min(1.0, s)) for s, _ in near])
        share = float((votes * self.index.toxic[[i for _, i in near]]).sum() / votes.sum())
        return np.array([1.0, 6 * (share - 0.5), near[0][0]]), near

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        at, n = self.index.tally(text)
        key = at.tobytes() + n.tobytes()
        if key not in self.memory:  # copies are looked up once, while few others come between
            found = self.features(at, self.index.weights(at, n))
            p = self.without if found is None else float(1 / (1 + np.exp(-np.clip(found[0] @ self.curve, -30, 30))))
            evidence = [] if found is None else [{"doc_id": int(self.index.ids[i]), "cosine": s, "toxic": int(self.index.toxic[i])} for s, i in found[1][:3]]
            if len(self.memory) >= 500:
                self.memory.clear()
            self.memory[key] = (p, evidence)
        return self.memory[key]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b -= np.linalg.solve(h, g)
    return b


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, postings: int = POSTINGS) -> Model:
    """Fit on about `sample` labelled rows, as many of either label where there are, and on about `postings` distinct words
    in them together (fewer rows, if texts are long), chosen by a hash of doc_id. So the index has a bounded size."""
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    own = (own.filter(usable) if usable is not None else own).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.filter("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    share = {k: min(1.0, sample / 2 / n) for k, n in sizes.items()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) / 1e6
    chosen = own.filter(F.when(F.col("toxic") == 1, u < share.get(1, 0.0)).when(F.col("toxic") == 0, u < share.get(0, 0.0)).otherwise(False)).select(F.col("doc_id").alias("labelled_id"), "toxic")
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "toxic", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [sorted(Counter(tokens(t)).items()) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [[w for w, _ in b] for b in bags], "n": [[c for _, c in b] for b in bags]})

    rows = got.mapInPandas(count, "doc_id long, toxic int, words array<string>, n array<int>")
    # An example's copies would be counted as so many witnesses: of equal ones the least doc_id stays.
    rows = materialise(rows.withColumn("sha", F.sha2(F.array_join("words", " ").cast("binary"), 256)), "examples")
    alone = rows.groupBy("sha", "toxic").agg(F.min("doc_id").alias("doc_id")).drop("sha")
    rows = rows.join(alone, ["doc_id", "toxic"], "left_semi").dropDuplicates(["doc_id", "toxic"]).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    words = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < 1e6 * min(1.0, postings / max(1, words)))
    own = rows.select("doc_id", "toxic", "held", "words", "n").orderBy("doc_id").collect()  # the bounded sample
    ids, held = np.array([r["doc_id"] for r in own], np.int64), np.array([r["held"] for r in own], bool)
    toxic = np.array([r["toxic"] for r in own], float)
    total, positive = int((~held).sum()), int(toxic[~held].sum())
    if positive in (0, total):
        return Model(Index({}, np.zeros(0)), np.zeros(3), 0.0)
    bags = [dict(zip(r["words"], r["n"], strict=True)) for r in own]
    have, toxic_have = Counter(), Counter()
    for b, h, y in zip(bags, held, toxic, strict=True):
        if not h:
            have.update(b.keys())
            if y:
                toxic_have.update(b.keys())
    vocabulary = sorted(have)
    terms = {w: i for i, w in enumerate(vocabulary)}
    told = relevance(np.array([have[w] for w in vocabulary], float), np.array([toxic_have[w] for w in vocabulary], float), total, positive)
    n_docs, df = document_frequencies(docs, terms)
    model = Model(Index(terms, (np.log((1 + n_docs) / (1 + df)) + 1) * told), np.zeros(3), 0.0)
    model.index.build([b for b, h in zip(bags, held, strict=True) if not h], ids[~held], toxic[~held])
    del own, have, toxic_have
    real = np.where(toxic == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))  # rows that a sampled one stands for
    found = {int(i): f[0] for i in np.flatnonzero(held) if (f := model.features(*model.index.vector(bags[i])))}
    rest = [int(i) for i in np.flatnonzero(held) if int(i) not in found]
    if found:
        at = list(found)
        model.curve = logistic(np.array([found[i] for i in at]), toxic[at], real[at] / real[at].mean())
    model.without = float(((toxic[rest] * real[rest]).sum() + 0.1) / (real[rest].sum() + 2.0)) if rest else 0.05
    return model


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Documents, and in how many of them each term occurs, over all whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value
        n, df = 0, np.zeros(len(terms) + 1, np.int64)  # the last: of all other words
        for pdf in batches:
            n += len(pdf)
            for some in range(0, len(pdf), 100):
                had = []
                for t in pdf["text"].iloc[some : some + 100]:
                    had += set(map(terms.get, tokens(t), repeat(len(terms))))
                df += np.bincount(np.array(had, np.int64), minlength=len(df))
        df = df[:-1]
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": [-1, *at], "n": [n, *df[at]]})

    rows = docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term at most
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], float)


def scored(model: Model) -> Column:
    """score and evidence (doc_id, cosine, toxic of the nearest examples) of a text."""

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.score(t) for t in texts], columns=["score", "evidence"])

    return run("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), usable=crc_mod("doc_id", 5) != 0)
    found = docs.select("doc_id", scored(model).alias("found"))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("found.score").alias("score"), (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.col("found.evidence").alias("evidence"))
