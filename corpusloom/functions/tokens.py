"""The identifier-aware tokenizer as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_JOIN = 4
_RUN = r"[\p{L}\p{Nd}]+"


def runs(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(f"({_RUN})"), 1)


def subtokens(run: Column) -> Column:
    """A run cut where a capital follows anything else, and before the last capital of several if a small letter follows."""
    cut = F.regexp_replace(run, r"([^\p{Lu}])(?=\p{Lu})", "$1\u0001")
    cut = F.regexp_replace(cut, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1\u0001")
    return F.split(cut, "\u0001")


def run_tokens(run: Column) -> Column:
    """All joins of up to MAX_JOIN neighbouring subtokens and the whole run, lower-cased, each once."""
    parts = subtokens(run)
    joins = lambda ps: F.flatten(F.transform(F.sequence(F.lit(1), F.size(ps)), lambda i: F.transform(F.sequence(i, F.least(i + MAX_JOIN - 1, F.size(ps))), lambda j: F.lower(F.array_join(F.slice(ps, i, j - i + 1), "")))))
    bound = F.transform(F.array(parts), joins)  # a one-element array: the cut is computed once
    whole = F.array_distinct(F.concat(F.get(bound, F.lit(0)), F.array(F.lower(run))))
    # without a capital after the first character a run is its only subtoken
    return F.when(F.rlike(run, F.lit(r".\p{Lu}")), whole).otherwise(F.array(F.lower(run)))


def tokenize(text: Column) -> Column:
    """Tokens of a text in order. Where no run has a capital after its first character, runs are lower-cased together,
    without a step a run: a separator that no run holds keeps them apart."""
    text = F.coalesce(text, F.lit(""))
    plain = F.split(F.lower(F.array_join(runs(text), "\u0001")), "\u0001")
    plain = F.when(F.rlike(text, F.lit(r"[\p{L}\p{Nd}]")), plain).otherwise(F.array().cast("array<string>"))
    return F.when(F.rlike(text, F.lit(r"[\p{L}\p{Nd}]\p{Lu}")), F.flatten(F.transform(runs(text), run_tokens))).otherwise(plain)


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokenize(text))
