"""Line dedup against a brute-force version that knows no suffixes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup


def brute(rows, least):
    """Lines in blocks that just reach the word limit, from the left or from the right, and begin with an earlier block alike."""
    seen, out = set(), {}
    for d, text in rows:
        lines = (text or "").split("\n")
        words = [len(re.findall(r"\S+", x)) for x in lines]
        blocks = set()
        for i in range(len(lines)):
            for step in (1, -1):
                total, j = 0, i
                while 0 <= j < len(lines):
                    total += words[j]
                    if total >= least:
                        blocks.add((min(i, j), max(i, j)))
                        break
                    j += step
        gone = set()
        for a, b in sorted(blocks):
            key = tuple(lines[a : b + 1])
            if key in seen:
                gone.update(range(a, b + 1))
            seen.add(key)
        out[d] = sorted(gone)
    return out


def removed(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = line_dedup.removed_lines(df, least)
    return {r.doc: r.removed for r in gone.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdef", k=rng.randrange(4))) for _ in range(6)]
    rows = []
    for d in range(120):
        lines = rng.choices(pool, k=rng.randrange(9)) + ([f"own {d} {rng.random()}"] if rng.random() < 0.5 else [])
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "\n\n"), (205, "a b c d\n" * 70)]
    want = {d: x for d, x in brute(rows, 5).items() if x}
    assert removed(spark, rows, 5) == want


def test_short_runs(spark):
    """Later copies go however short they are, in scripts without spaces too; only blank runs stay."""
    line, kanji = "click here to read the rest of this article", "続きを読むにはここをクリックしてください"
    rows = [(1, f"{line}\none"), (2, f"two\n\n{line}"), (3, f"{kanji}\nthree"), (4, f"four\n{kanji}"), (5, f"five\n\n{line}\n{kanji}\n"), (6, "ok\n\nsix"), (7, "seven\n\nok")]
    want = {d: x for d, x in brute(rows, 1).items() if x}
    gone = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc: r.removed for r in gone.collect()} == want == {2: [2], 4: [1], 5: [1, 2, 3], 7: [2]}


def test_clean(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one\n{passage}\nx", "c"), (2, f"{passage}\ntwo", "c"), (3, "clean", "c"), (4, None, "c"), (None, f"{passage}\nthree", "c"), (2, f"{passage}\ntwo", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = line_dedup.clean(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", f"one\n{passage}\nx"), ("2", "two"), ("2", "two"), ("3", "clean"), ("4", None), ("None", "three")], key=lambda x: (x[0], x[1]))
    assert line_dedup.clean(df.limit(0)).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([([0, 1, 4],), ([],), ([2],)], "r array<int>")
    got = [[(s.start, s.end) for s in r[0]] for r in df.select(line_dedup._spans(F.col("r"))).collect()]
    assert got == [[(0, 2), (4, 5)], [], [(2, 3)]]


def test_hot_content(spark):
    """A content on most documents: dealt into parts, one row a part, the first of all stays."""
    rows = [(i, f"notice of use\nown {i}\n" + ("again\nand again" if i % 3 else "notice of use")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    own = line_dedup.islands(line_dedup.repeated(line_dedup.split_lines(df)))
    assert own.filter("NOT copy").count() == 2 and own.count() == 800
    assert {r.doc: r.removed for r in line_dedup.removed_lines(df).collect()} == {d: x for d, x in brute(rows, 1).items() if x}


def test_sql_on_blank_lines(spark):
    """The SQL against the operator on few, often blank, lines."""
    import duckdb
    import pandas as pd

    rng = random.Random(4)
    pool = ["", "", " ", "a", "b c", "続き", "\t"]
    pdf = pd.DataFrame([(d, "\n".join(rng.choices(pool, k=rng.randrange(8)) + ([f"own {d}"] if d % 3 else []))) for d in range(200)], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", pdf)
    want = {r.doc_id: (r.n_lines, r.n_removed) for r in con.execute(line_dedup.ORACLE_SQL).df().itertuples()}
    df = spark.createDataFrame(pdf)
    gone = {r.doc: len(r.removed) for r in line_dedup.removed_lines(df).collect()}
    assert {d: n for d, (_, n) in want.items() if n} == gone
