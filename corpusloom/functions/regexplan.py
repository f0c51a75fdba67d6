"""A regular expression as a boolean condition that every matching text meets, and its Java spelling.

The condition is built on the driver from the parsed expression. It may accept too much, never too little: what cannot
be told is "anything". Sets of strings that a part must spell out are crossed while they stay small (limits below);
when they grow, or a part of unknown content comes between, what was gathered becomes a requirement of its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sc
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class, strings of an exact set, strings of a crossing.
CLASS_LIMIT, SET_LIMIT, CROSS_LIMIT = 64, 1024, 4096
#: Spellings of a folded string: more than so many are split into strings that are all required.
FOLD_LIMIT = 8
#: Letters whose other-case forms lie outside ASCII (Kelvin sign, long s).
UNSAFE_FOLD = frozenset("kKsS")


@dataclass(frozen=True)
class Need:
    """kind: all, has (text), and, or."""

    kind: str
    text: str = ""
    parts: tuple = ()


ALL = Need("all")


def need_and(*parts: Need) -> Need:
    parts = tuple(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else Need("and", parts=parts)


def need_or(*parts: Need) -> Need:
    parts = tuple(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else Need("or", parts=parts)


def _spelled(strings: frozenset[str]) -> Need:
    return ALL if not strings or "" in strings else need_or(*(Need("has", s) for s in sorted(strings)))


def case_variants(c: str) -> frozenset[str] | None:
    """ASCII forms of a character under case folding; None where folding leaves ASCII."""
    if c in UNSAFE_FOLD or ord(c) > 127:
        return None
    return frozenset({c.lower(), c.upper()})


def _char(c: str, fold: bool) -> frozenset[str] | None:
    return case_variants(c) if fold else frozenset({c})


def _class(items, fold: bool) -> frozenset[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sc.LITERAL:
            chars = [chr(value)]
        elif op is sc.RANGE and value[1] - value[0] < CLASS_LIMIT:
            chars = [chr(c) for c in range(value[0], value[1] + 1)]
        else:
            return None
        for c in chars:
            own = _char(c, fold)
            if own is None:
                return None
            out |= own
    return frozenset(out) if len(out) <= CLASS_LIMIT else None


def _sequence(items, fold: bool) -> tuple[frozenset[str] | None, Need]:
    """What a sequence can spell exactly, if known, and what it needs besides."""
    run, needs, whole = frozenset({""}), [], True
    for item in items:
        own, need = _item(item, fold)
        needs.append(need)
        if own is not None and len(own) * len(run) <= (FOLD_LIMIT if fold else CROSS_LIMIT) and len(crossed := frozenset(a + b for a, b in product(run, own))) <= SET_LIMIT:
            run = crossed
            continue
        needs.append(_spelled(run))
        whole = False
        run = own if own is not None else frozenset({""})
    return (run, need_and(*needs)) if whole else (None, need_and(*needs, _spelled(run)))


def _item(item, fold: bool) -> tuple[frozenset[str] | None, Need]:
    op, value = item
    if op is sc.LITERAL:
        return _char(chr(value), fold), ALL
    if op is sc.IN:
        return _class(value, fold), ALL
    if op is sc.AT:
        return frozenset({""}), ALL
    if op is sc.SUBPATTERN:
        _, add, remove, inner = value
        return _sequence(inner, (fold or bool(add & re.I)) and not remove & re.I)
    if op is sc.BRANCH:
        arms = [_sequence(arm, fold) for arm in value[1]]
        if all(own is not None and need == ALL for own, need in arms):
            union = frozenset().union(*(own for own, _ in arms))
            if len(union) <= SET_LIMIT:
                return union, ALL
        # Each arm's own requirement stays inside its arm.
        return None, need_or(*(need_and(need, _spelled(own) if own is not None else ALL) for own, need in arms))
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
        least, most, inner = value
        own, need = _sequence(inner, fold)
        if least == 0:
            return None, ALL
        if least == most and own is not None:
            return _sequence(list(inner) * least, fold)
        return None, need_and(need, _spelled(reduce(lambda a, b: frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= SET_LIMIT else a, [own] * least)) if own is not None else ALL)
    if op in (sc.ASSERT, sc.ASSERT_NOT, sc.GROUPREF, sc.GROUPREF_EXISTS):
        raise ValueError("lookaround and backreferences are not supported")
    return None, ALL


def needed(pattern: str, ignore_case: bool = False) -> Need:
    """What every text with a match must contain. Syntax that cannot be read here needs nothing."""
    if re.search(r"\(\?(<?[=!])|\\[1-9]", pattern):
        raise ValueError("lookaround and backreferences are not supported")
    try:
        tree = parser.parse(_without_posix(pattern))
    except (re.error, OverflowError):
        return ALL
    own, need = _sequence(tree, ignore_case or bool(tree.state.flags & re.I))
    return need_and(need, _spelled(own)) if own is not None else need


def grams(need: Need) -> Need:
    """The requirement over 3-byte grams: a string shorter than that, in any arm, needs nothing."""
    if need.kind == "has":
        data = need.text.encode()
        return need_and(*(Need("has", data[i : i + 3].hex()) for i in range(len(data) - 2)))
    if need.kind == "and":
        return need_and(*map(grams, need.parts))
    return need_or(*map(grams, need.parts)) if need.kind == "or" else ALL


def contains(column: Column, need: Need) -> Column:
    """The requirement as a predicate, evaluated in generated code."""
    if need.kind == "has":
        return F.contains(column, F.lit(need.text))
    if need.kind in ("and", "or"):
        parts = [contains(column, p) for p in need.parts]
        return reduce((lambda a, b: a & b) if need.kind == "and" else (lambda a, b: a | b), parts)
    return F.lit(True)


#: Fixed: POSIX classes and what they stand for.
POSIX = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "A-Za-z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "word": "0-9A-Za-z_", "cntrl": r"\x00-\x1F\x7F", "blank": r" \t", "print": " -~", "graph": "!-~"}


def _without_posix(pattern: str) -> str:
    for name, chars in POSIX.items():
        pattern = pattern.replace(f"[:{name}:]", chars)
    return pattern


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Java: lines end at \\n alone, and folding is Unicode's."""
    needed(pattern, ignore_case)
    pattern = _without_posix(pattern)
    fold = ignore_case or bool(re.match(r"\(\?[a-z]*i", pattern))
    return ("(?diu)" if ignore_case else "(?du)" if fold else "(?d)") + pattern
