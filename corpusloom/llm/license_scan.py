"""Licence scan: Aho-Corasick for tags and notice phrases, a shunting-yard parser for and/or/with expressions.

One automaton over the document's words (each followed by a space) finds every phrase where its words stand
consecutively; places are word indices from 0. A second one over the lower-cased text finds identifier tags, whose
expression runs to the end of its line. The expression is put into postfix form (with binds closest, then and, then
or) and evaluated twice: to the set of its licence labels, and to whether a policy of accepted labels can meet it.

Null and empty texts have no words and no labels, and score 0. Overlapping and repeated places all count. A tag
without a well-formed expression gives the labels of its operands that could be read. The result depends on each
row's text alone, so repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases of the query contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases that the method adds, their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How sure a find is that the text stands under a licence: a tag, a base phrase, a notice phrase.
WEIGHTS = {"tag": 0.95, "base": 0.8, "notice": 0.6}
#: Labels that the default policy accepts.
ACCEPTED = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "public-domain"})
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9.+:_-]+")


def label_of(identifier: str) -> str:
    """The family of a lower-case licence identifier: its version and suffixes go."""
    name = re.sub(r"-(only|or-later)$", "", identifier.rstrip("+"))
    return re.sub(r"-v?\d+(\.\d+)*$|-\d+-clause$", "", name) or identifier


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting yard. ValueError where the expression is not well formed."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t in PRECEDENCE:
            if operand:
                raise ValueError(t)
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand or not stack:
                raise ValueError(t)
            stack.pop()
        elif not operand:
            raise ValueError(t)
        elif t == "(":
            stack.append(t)
        else:
            out.append(t)
            operand = False
    if operand or "(" in stack:
        raise ValueError("unfinished")
    return out + stack[::-1]


def evaluate(postfix: list[str], accepted: frozenset[str] = ACCEPTED) -> tuple[frozenset[str], bool]:
    """Labels of an expression, and whether the accepted labels can meet it. An exception (with) never takes away a right."""
    stack: list[tuple[frozenset[str], bool]] = []
    for t in postfix:
        if t not in PRECEDENCE:
            label = label_of(t)
            stack.append((frozenset({label}), label in accepted))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "with":
            stack.append(left)
        else:
            stack.append((left[0] | right[0], left[1] or right[1] if t == "or" else left[1] and right[1]))
    return stack[0]


def read_expression(line: str, accepted: frozenset[str] = ACCEPTED) -> tuple[frozenset[str], bool | None, str]:
    """Labels, verdict and postfix form of the longest well-formed start of a tag's line."""
    tokens = TOKEN.findall(line.strip().removesuffix("*/").removesuffix("-->"))
    # After an operand only an operator or ) goes on: the expression ends at the first other word.
    end, depth, operand = 0, 0, True
    for t in tokens:
        if operand == (t in PRECEDENCE or t == ")") or (t == ")" and not depth):
            break
        depth += (t == "(") - (t == ")")
        operand = t in PRECEDENCE or t == "("
        end += 1
    tokens = tokens[:end]
    while tokens and (tokens[-1] in PRECEDENCE or tokens[-1] == "("):
        tokens.pop()
    try:
        postfix = to_postfix(tokens)
    except ValueError:
        return frozenset(label_of(t) for t in tokens if t not in PRECEDENCE and t not in "()"), None, ""
    return (*evaluate(postfix, accepted), " ".join(postfix))


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases, each word between single spaces, and of tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, table_ in (("notice", NOTICES), ("base", BASE)):
        for phrase, label in table_.items():
            phrases.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton, accepted: frozenset[str] = ACCEPTED) -> dict:
    """Everything found in one whole text."""
    lowered = (text or "").translate(ASCII_LOWER) if text and not text.islower() else text or ""
    words = WORD.findall(lowered)
    joined = f" {' '.join(words)} "
    finds, at, before = [], 0, 0
    for end, (kind, label, width) in phrases.iter(joined):
        start = end - width  # of the phrase's leading space
        if start >= at:
            before += joined.count(" ", at, start)
            index = before
            at = start
        else:  # a longer phrase that began earlier
            index = before - joined.count(" ", start, at)
        finds.append((index, kind, label))
    base = [i for i, kind, _ in finds if kind == "base"]
    expressions, labels, accept = [], {x for _, _, x in finds}, []
    if ":" in lowered:
        for end, _ in tags.iter(lowered):
            stop = lowered.find("\n", end)
            own, verdict, postfix = read_expression(lowered[end + 1 : stop if stop >= 0 else len(lowered)], accepted)
            labels |= own
            expressions.append(postfix)
            accept.append(bool(verdict))
    miss = 1.0
    for kind in [k for _, k, _ in finds] + ["tag"] * len(expressions):
        miss *= 1 - WEIGHTS[kind]
    base_labels = sorted({x for _, kind, x in finds if kind == "base"})
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
        "base_labels": ",".join(base_labels), "labels": ",".join(sorted(labels)), "score": 1 - miss,
        "expressions": expressions, "acceptable": None if not labels else all(accept) if accept else labels <= accepted,
        "places": [{"word": i, "kind": kind, "label": x} for i, kind, x in sorted(finds)],
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, acceptable boolean, places array<struct<word: long, kind: string, label: string>>"


def license_scan(docs: DataFrame, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """One row per row of docs: counts, places, labels, expressions in postfix form, and the policy's verdict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases, tags = automata()
        for pdf in batches:
            out = pd.DataFrame([scan(t, phrases, tags, accepted) for t in pdf["text"]], columns=[f.split()[0] for f in re.sub(r"<.*?>+", "", SCHEMA).split(", ")[1:]])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")
