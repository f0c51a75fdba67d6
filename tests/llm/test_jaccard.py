"""The Jaccard join and its components against all pairs."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import components, jaccard_join


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # A-Z alone, as the contract says


def word_sets(rows, k):
    out = {}
    for i, t in rows:
        w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, k, threshold):
    sets = word_sets(rows, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def links_of(rows, k, threshold):
    """Links of each document's class to classes with other sets."""
    sets = {i: frozenset(s) for i, s in word_sets(rows, k).items()}
    distinct = {s for s in sets.values() if s}
    return {i: sum(t != s and 100 * len(s & t) >= threshold * len(s | t) for t in distinct) if s else 0 for i, s in sets.items()}


def same_as_brute(spark, rows, k, threshold, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(df, k, threshold).collect()}
    want, degree = brute(rows, k, threshold), links_of(rows, k, threshold)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == degree
    return degree


@pytest.mark.parametrize("k,threshold,limits", [(3, 90, {}), (5, 80, {}), (2, 60, {"RUN": 3, "BLOCK": 4, "LEADERS": 1, "FEW": 1}), (3, 85, {"SALTED": 3, "CARRY": 8, "COLUMNS": 16, "FEW": 2})])
def test_equals_brute_force(spark, monkeypatch, k, threshold, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "ärger", "ÉTÉ", "été", "İx"]
    rows, bases = [], [rng.choices(vocabulary, k=n) for n in (30, 60, 100, 12)]
    for i in range(170):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        rows.append((i, " ".join(w)))
    rows += [(300, "one two"), (301, "one two"), (302, "ONE two"), (303, ""), (304, None), (305, "  "), (306, "a b c"), (307, "a b c")]
    same_as_brute(spark, rows, k, threshold)


def edited(rng, base, i, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"own{i}x{rng.randrange(9)}"
    return " ".join(w)


def test_five_hundred_near_copies(spark, monkeypatch):
    """Near copies about the threshold: half of the pairs link. Rows made must not grow with the square of the group."""
    made = []
    monkeypatch.setattr(jaccard_join, "drop_table", lambda df: made.append((df.columns, df.count())))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, i, rng.randrange(6))) for i in range(500)]
    degree = same_as_brute(spark, rows, 3, 90)
    assert sum(degree.values()) > 10_000
    assert max(n for _, n in made) < 40 * 500


@pytest.mark.parametrize("limits", [{}, {"RUN": 64, "BLOCK": 32}])
def test_groups_that_all_meet_make_few_rows(spark, monkeypatch, limits):
    """Where each group may link with each other, they become one: not a row for each two of them."""
    made, crossed = [], jaccard_join.crossed
    monkeypatch.setattr(jaccard_join, "crossed", lambda *a: made.append(crossed(*a)) or made[-1])
    monkeypatch.setattr(jaccard_join, "drop_table", lambda df: None)
    monkeypatch.setattr(jaccard_join, "LEADERS", 0)  # so that every class is a group of its own
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(14)
    base, other = [f"w{i}" for i in range(150)], [f"v{i}" for i in range(150)]
    rows = [(i, edited(rng, base, i, 1 + i % 2)) for i in range(240)] + [(1000 + i, edited(rng, other, i, 3)) for i in range(40)]
    degree = same_as_brute(spark, rows, 3, 90)
    assert sum(degree.values()) > 10_000
    assert 0 < made[0].count() < 12 * len(rows)


def test_common_shingle_whose_pairs_fail(spark):
    """Documents that share one passage and are else different: they meet, and verification tells them apart."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage + [f"own{i}x{j}" for j in range(rng.choice([3, 4, 5, 40]))])) for i in range(150)]
    rows += [(1000 + i, edited(rng, passage, i, i % 3)) for i in range(40)]
    same_as_brute(spark, rows, 5, 80)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With more ids than bits every row passes the broadcast filters; joins drop those that are not asked for."""
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", 1 << 15)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(80)]
    rows = [(i * 32768, edited(rng, base, i, i % 4)) for i in range(90)] + [(i, edited(rng, base, i % 7, 2)) for i in range(5000, 5060)]
    same_as_brute(spark, rows, 3, 90)


def test_links_of_a_large_group(spark, monkeypatch):
    """Over 24 classes meet at a shingle: each class's links are counted all the same, by several blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(100, "a b c d e f g h i j k l"), (101, "a b c d e f g h i j k l m"), (102, "alone in the world")]
    want = links_of(rows, 3, 90)
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(want.values()) > 600


def test_odd(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, None, "x"), (4, "", "x"), (5, "z " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [("1", 4, 1), ("1", 4, 1), ("2", 4, 1), ("3", 0, 3), ("4", 0, 4), ("5", 1, 5), ("None", 4, None)]
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "4", "5", "None"]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_bounds():
    for threshold in (50, 80, 90, 100):
        for n in range(1, 60):
            p = jaccard_join.prefix_length(n, threshold)
            least = -(-threshold * n // 100)
            assert p == n - least + 1
            for m in range(1, 60):
                need = next(o for o in range(n + m + 1) if 100 * o >= threshold * (n + m - o))
                assert jaccard_join.spare(n + m, threshold) >= n + m - 2 * need


def test_filter_never_loses():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(20, 400))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 40], rng.integers(0, 2**63, n // 30).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        large = [jaccard_join.signature(s).astype(np.int16).reshape(1, 256) for s in (a, b)]
        small = [jaccard_join.unpacked(*jaccard_join.folded(s).T) for s in large]
        if 100 * both >= 90 * (len(a) + len(b) - both):
            for x, y in (large, small):
                assert jaccard_join.distance(x, y)[0] <= jaccard_join.spare(len(a) + len(b), 90)


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    links = [(a, b) for a, b in links if a != b]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    assert {r.node: r.component for r in components.components(df).collect()} == root
    assert components.components(df.limit(0)).count() == 0
