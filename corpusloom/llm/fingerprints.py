"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are paragraphs: lines, of which long ones are cut after the word that passes a number of characters: few at the
start of a text and LEAF further on (LEAVES), so short texts have several leaves too. Sections are runs of paragraphs;
one ends after an empty line or after a paragraph whose hash says so (one in SECTION), so an edit moves no boundary but
those near it. All hashes have 128 bits. A section's is over its paragraphs' hashes and lengths, the root's over the
sections'. Equal roots mean equal texts; where roots differ, sections and then paragraphs that differ locate the edits.

A fingerprint is the root's hash, then each section as its paragraphs' hashes and lengths. The likeness of two is the
share of characters in paragraphs that both hold (Dice's coefficient over paragraphs weighted by length, 0 to 1);
two empty texts are equal. Null counts as empty. Documents follow each other by descending doc_id, nulls last, then by
a hash of the text; the first follows the last, and a single document follows itself. Repeated rows are documents of
their own.
Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

LEAF, SECTION = 160, 8
MIN_ID = -(1 << 63)
#: Characters that a written hash has.
WIDTH = 22


def _paragraph(leaf: int) -> re.Pattern:
    return re.compile(rf"[^\n]{{1,{leaf}}}\S*[^\S\n]*\n?|\n")


#: Where a leaf starts before the first number, the pattern beside it cuts it: eight leaves or so of each size.
LEAVES = [(160, _paragraph(LEAF // 8)), (480, _paragraph(LEAF // 4)), (1120, _paragraph(LEAF // 2)), (math.inf, _paragraph(LEAF))]


def _hash(data: bytes) -> str:
    """128 bits as URL-safe base64."""
    return base64.urlsafe_b64encode(hashlib.blake2b(data, digest_size=16).digest()).decode()[:WIDTH]


def paragraphs_of(text: str) -> Iterator[str]:
    at = 0
    for end, pattern in LEAVES[:-1]:
        while at < min(end, len(text)):
            x = pattern.match(text, at)[0]
            yield x
            at += len(x)
    yield from LEAVES[-1][1].findall(text, at)


@dataclass
class Tree:
    """sections: of (hash, paragraphs as (hash, length))."""

    root: str
    sections: list[tuple[str, list[tuple[str, int]]]]

    def leaves(self) -> Counter:
        out: Counter = Counter()
        for _, paragraphs in self.sections:
            for h, n in paragraphs:
                out[h, n] += n
        return out

    def __str__(self) -> str:
        return "/".join([self.root, *(".".join(f"{h}{n:x}" for h, n in ps) for _, ps in self.sections)])


def _tree(sections: list[list[tuple[str, int]]]) -> Tree:
    hashed = [(_hash("".join(f"{h}{n:x}." for h, n in ps).encode()), ps) for ps in sections]
    return Tree(_hash("".join(h for h, _ in hashed).encode()), hashed)


def build(text: str | None) -> Tree:
    sections, paragraphs = [], []
    for x in paragraphs_of(text or ""):
        h = _hash(x.encode("utf-8", "surrogatepass"))
        paragraphs.append((h, len(x)))
        if x == "\n" or ord(h[0]) % SECTION == 0:
            sections.append(paragraphs)
            paragraphs = []
    return _tree([*sections, paragraphs] if paragraphs else sections)


def parse(fingerprint: str) -> Tree:
    """The tree that a fingerprint writes out."""
    root, *sections = fingerprint.split("/")
    tree = _tree([[(p[:WIDTH], int(p[WIDTH:], 16)) for p in s.split(".")] for s in sections])
    if tree.root != root:
        raise ValueError("the fingerprint's root does not fit its branches")
    return tree


def likeness(a: Tree, b: Tree, a_leaves: Counter | None = None, b_leaves: Counter | None = None) -> float:
    if a.root == b.root:
        return 1.0
    x, y = a_leaves if a_leaves is not None else a.leaves(), b_leaves if b_leaves is not None else b.leaves()
    if len(y) < len(x):
        x, y = y, x
    total = x.total() + y.total()
    return 2 * sum(min(n, y[k]) for k, n in x.items() if k in y) / total if total else 1.0


def edits(a: Tree, b: Tree) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Character ranges of a that b lacks, and of b that a lacks, found by descending into differing branches only."""

    def lacking(x: Tree, y: Tree) -> list[tuple[int, int]]:
        whole = Counter(h for h, _ in y.sections)
        parts, at, out = Counter(), 0, []
        mine = Counter(h for h, _ in x.sections)
        for h, ps in y.sections:
            if whole[h] > mine[h]:
                parts.update(ps)
        for h, ps in x.sections:
            if whole[h] > 0:
                whole[h] -= 1
                at += sum(n for _, n in ps)
                continue
            for p in ps:
                if parts[p] > 0:
                    parts[p] -= 1
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + p[1])
                else:
                    out.append((at, at + p[1]))
                at += p[1]
        return out

    return ([], []) if a.root == b.root else (lacking(a, b), lacking(b, a))


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _part(bounds: list[int], order: str) -> Column:
    """The part of a row. bounds: descending, equal ones together; a key's part is the number of bounds over it, found
    in one of sqrt(n) runs. A key that is a bound m times holds about m parts' rows and is dealt to m parts by `order`."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    over = lambda xs: F.size(F.filter(xs, lambda b: b > F.col("key")))
    skipped = F.greatest(over(longs(bounds[::width])) - 1, F.lit(0)) * width
    part = skipped + over(F.slice(longs(bounds), skipped + 1, F.lit(width)))
    for key, m in Counter(bounds).items():
        if m > 1:
            share = F.floor((0.5 - F.col(order) / 2.0**64) * m)
            part = F.when(F.col("key") == key, part + F.least(F.greatest(share, F.lit(0)), F.lit(m - 1))).otherwise(part)
    return part.cast("int")


def with_following(docs: DataFrame) -> DataFrame:
    """Rows (part, own, key, doc_id, text), dealt by part and sorted so that each own row is followed by the next document.

    Parts are ranges of doc_id, and within an id that fills several, of a hash of the text, with about as many rows each
    and a task each; the first document of a part also goes, with own false, to the end of the part before. The driver
    sees, and tasks are sent, one id and one hash a part.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MIN_ID)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = keyed.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    keyed = keyed.withColumn("order", F.xxhash64("text"))
    keyed = keyed.withColumn("part", _part(sorted(bounds, reverse=True), "order"))
    heads = sorted((r["part"], *r["head"]) for r in keyed.groupBy("part").agg(F.max(F.struct("key", "order")).alias("head")).collect())
    before = [(heads[i - 1][0], key, order) for i, (_, key, order) in enumerate(heads)]
    # a row a part
    before = F.broadcast(spark.createDataFrame(before, "before int, head long, head_order long"))
    met = keyed.join(before, (F.col("key") == F.col("head")) & (F.col("order") == F.col("head_order")), "left")
    own, copy = F.struct("part", F.lit(True).alias("own")), F.struct(F.col("before").alias("part"), F.lit(False).alias("own"))
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    rows = met.select("key", "order", "doc_id", "text", F.explode(copies).alias("c")).select("c.part", "c.own", "key", "order", "doc_id", "text")
    return rows.repartitionById(n, "part").sortWithinPartitions("part", F.desc("own"), F.desc("key"), F.desc("order")).drop("order")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # part, own, doc_id, text, tree, leaves
        for pdf in batches:
            out = []
            for part, own, doc_id, text in zip(pdf["part"], pdf["own"], pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                tree = build(text)
                leaves = tree.leaves()
                if last and last[1] and last[0] == part:
                    _, _, i, t, a, a_leaves = last
                    other = edited(t, text)
                    b = build(other)
                    out.append((i, len(t), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), str(a), str(b), likeness(a, b, a_leaves), likeness(a, tree, a_leaves, leaves)))
                last = (part, own, doc_id, text, tree, leaves)
            out = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return with_following(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
