"""The required condition of a pattern never misses a match."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions.regexplan import ALL, Need, case_variants, grams, java, needed


def holds(need, text):
    if need.kind == "has":
        return need.text in text
    if need.kind == "and":
        return all(holds(p, text) for p in need.parts)
    return need.kind == "all" or any(holds(p, text) for p in need.parts)


atoms = st.sampled_from(["a", "b", "cd", "[ab]", "[a-c]", ".", r"\d", "(ab|c)", "(a|b)?", "x+", "(yz)*", "a{2}", "(abc|abd)", "[^a]", r"\b", "^", "$"])
patterns = st.lists(atoms, min_size=1, max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(patterns, st.text("abcdxyz1 ", max_size=14), st.booleans())
def test_sound(pattern, text, fold):
    try:
        hit = re.search(pattern, text, re.I if fold else 0)
    except re.error:
        return
    if hit:
        assert holds(needed(pattern, fold), text)


def test_values():
    assert needed("hello") == Need("has", "hello")
    assert needed("ab|cd").kind == "or"
    assert needed("a*") == ALL and needed(".") == ALL
    assert needed("foo.*bar") == Need("and", parts=(Need("has", "foo"), Need("has", "bar")))
    # arms are never joined across an alternation
    assert holds(needed("(foo.*bar|qux)"), "qux")
    assert case_variants("k") is None and case_variants("é") is None and case_variants("a") == {"a", "A"}
    assert needed("key", True) == Need("or", parts=tuple(sorted((Need("has", x) for x in ("EY", "Ey", "eY", "ey")), key=lambda n: n.text)))


def test_grams():
    assert grams(needed("ab")) == ALL
    assert grams(needed("abcd")).parts == (Need("has", b"abc".hex()), Need("has", b"bcd".hex()))
    assert grams(needed("abc|x")) == ALL


def test_java():
    assert java("[[:alpha:]]+") == "(?d)[A-Za-z]+"
    assert java("é", True) == "(?diu)é"
    with pytest.raises(ValueError):
        needed("(?=a)b")
