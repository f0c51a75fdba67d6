"""Call audit, names across shards, discovery, scoped blocks, identities, blob ids of files."""

import hashlib

from pyspark.sql import functions as F

from corpusloom.operators import context, graph, incremental, symbols
from corpusloom.sources.files import discover_repos, read_files


def test_call_audit(spark):
    rows = [("one", "t", "r")] * 2 + [("four", f"t{i}", "r") for i in range(4)] + [("five", f"t{i}", f"r{i % 2}") for i in range(5)] + [("many", f"m{i}", "r") for i in range(65)]
    df = spark.createDataFrame(rows, "site string, target string, repo string")
    got = {r.measure: r.n for r in graph.call_audit(df, df, df.filter("site IN ('one', 'many')")).collect()}
    assert got == {"sites": 4, "edges": 75, "max": 65, "1": 1, "2-4": 1, "5-16": 1, "17-64": 0, "65+": 1, "definitions": 71, "p50": 4, "p95": 65, "several_repos": 1, "covered": 2}
    empty = {r.measure: r.n for r in graph.call_audit(df.limit(0), df, df).collect()}
    assert set(empty.values()) == {0}
    sample = graph.audit_sample(df, 2, 7).collect()
    assert sample == graph.audit_sample(df.repartition(5), 2, 7).collect() and len(sample) == 2


def test_names(spark):
    names = spark.createDataFrame([("Run",), ("Run",), ("ru",), ("Ru",), ("Été",), (None,)], "name string")
    assert symbols.sweep(names.filter("name IS NOT NULL")).first() == (4, 2, 2)
    defs = spark.createDataFrame([("own", 1), ("two", 1), ("two", 2), ("far", 2)], "name string, shard int")
    uses = spark.createDataFrame([("own", 1), ("two", 1), ("far", 1), ("none", 1)], "name string, shard int")
    assert {r.name for r in symbols.cross_shard(defs, uses).collect()} == {"two", "far", "none"}


def test_discovery(spark, tmp_path):
    paths = ["/r/a/.git/HEAD", "/r/a/.git/modules/x/.git/HEAD", "/r/a/b/.git", "/r/my.git/x", "/r/.gitignore", ".git/HEAD", "/r/c/.git/config"]
    got = discover_repos(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert {r.repo for r in got.collect()} == {"/r/a", "/r/a/b", "", "/r/c"}
    (tmp_path / "x.txt").write_bytes(b"\xef\xbb\xbfhello")
    row = read_files(spark, str(tmp_path), "r").first()
    assert row.content == "hello" and row.blob_sha == hashlib.sha1(b"blob 8\0\xef\xbb\xbfhello").hexdigest()


def test_scoped_blocks(spark):
    lines = ["é", "def f():", "  a", "  b", "end", ""]
    body = (3, 3 + len("def f():\n  a\n  b\n"))
    assert context.expand_scoped(lines, 3, 3, body) == (2, 4)
    assert context.expand_scoped(lines, 3, 3, None) == context.expand_scoped(lines, 3, 3, (5, 5)) == context.expand_block(lines, 3, 3)
    assert context.expand_scoped(lines, 3, 3, (3, 4)) == (2, 2) and context.expand_scoped(lines, 1, 1, (0, 10_000)) == (1, 6)
    at = spark.createDataFrame([("k", 12)], "key string, at long")
    defs = spark.createDataFrame([("k", "f", *body)], "key string, name string, start long, body_end long")
    found = symbols.enclosing(at, defs).select(F.col("start"), F.col("body_end")).first()
    assert context.expand_scoped(lines, 3, 3, tuple(found)) == (2, 4)


def test_identities():
    left, right = {"corpus": "x", "blobs": ["b", "a"], "cacheable": True}, {"corpus": "x", "blobs": ["a"], "generation": 3, "cacheable": True}
    got = incremental.merged_identity(left, right)
    assert got["blobs"] == ["a", "b"] and got["cacheable"] and got["generation"] == 3 and got["graph_corpus"] is None
    assert not incremental.merged_identity(left, right | {"corpus": "y"})["cacheable"]
    assert incremental.merged_identity(left, right | {"corpus": "y"})["graph_corpus"] == "y"
    assert not incremental.merged_identity(left | {"unanchored": ["p"]}, right)["cacheable"]
    assert incremental.merged_identity({"cacheable": True}, {"corpus": "y", "cacheable": True})["corpus"] == "y"
