"""Operators on the small cases of the reference's own tests, and hand-computed ones."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.tokens import tokenize
from corpusloom.operators import context, corpus, evaluation, facts, graph, grep, incremental, manifests, rank, relations, routes, spans, symbols, vectors
from corpusloom.plans import rank_plans
from corpusloom.sources.files import Snapshots, read_files


def files(spark, *rows):
    return spark.createDataFrame([(i, r, p, "x", s, c) for i, (r, p, s, c) in enumerate(rows)], "doc_id long, repo string, rel_path string, lang string, blob_sha string, content string")


def test_dedup_and_fan_out(spark):
    fs = files(spark, ("r", "a.cs", "same", "hello world\nfoo bar\n"), ("r", "b.cs", "same", "hello world\nfoo bar\n"), ("r", "c.cs", "other", "nothing"))
    assert corpus.blobs_of(fs).count() == 2
    assert [(r.rel_path, r.line) for r in grep.literal(fs, "hello").collect()] == [("a.cs", 1), ("b.cs", 1)]
    assert grep.literal(fs, "a\nb").count() == 0 and grep.literal(fs, "").count() == 0


def test_lines(spark):
    fs = files(spark, ("r", "a", "1", ""), ("r", "b", "2", "x\n"), ("r", "c", "3", "x\r\ny"))
    got = [(r.rel_path, r.line, r.line_text) for r in corpus.lines_of(fs, "rel_path").orderBy("rel_path", "line").collect()]
    assert got == [("b", 1, "x"), ("c", 1, "x\r"), ("c", 2, "y")]


def test_regex_dialect(spark):
    fs = files(spark, ("r", "a", "1", "a\r\nxa\nK"), ("r", "b", "2", "É"))
    assert [r.line for r in grep.regex(fs, "a$").collect()] == [2]
    assert grep.regex(fs, "k", True).count() == 1 and grep.regex(fs, "é", True).count() == 1


def test_positional_and_occurrences(spark):
    fs = files(spark, ("r", "a", "1", "abcabcabc"), ("r", "b", "2", "éabcab"))
    assert sorted((r.blob_sha, r.at) for r in grep.positional(corpus.blobs_of(fs), "abcab").collect()) == [("1", 0), ("1", 3), ("2", 2)]
    assert sorted((r.rel_path, r.at) for r in grep.occurrences(fs, "abcab", "rel_path").collect()) == [("a", 0), ("a", 3), ("b", 1)]


def test_positional_in_bytes(spark):
    """Byte places in one pass, also of grams that cut a character; a blob of two files counts once, no content is shuffled."""
    texts = ["aaaaa é aaaaa", "éé😀é😀éé", "x" * 50_000 + "aaaa", "", "aab"]
    fs = files(spark, *[(r, str(i), f"{i}", t) for i, t in enumerate(texts) for r in "rs"])
    for text in ("aaaa", "aaa", "é😀é", "aé"):
        data = text.encode()
        want = sorted((str(i), at) for i, t in enumerate(map(str.encode, texts)) for at in range(len(t) - len(data) + 1) if t[at : at + 3] == data[:3] and t[at + len(data) - 3 : at + len(data)] == data[-3:])
        got = grep.positional(fs, text)
        assert sorted((r.blob_sha, r.at) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "content" in line]


TOKENS = {
    "ReIssueCertificate": {"re", "reissue", "reissuecertificate", "issue", "issuecertificate", "certificate"},
    "HTTPServer": {"http", "httpserver", "server"},
    "foo2Bar": {"foo2", "foo2bar", "bar"},
    "": set(),
}


@pytest.mark.parametrize("text", TOKENS)
def test_tokens(spark, text):
    assert set(spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0]) == TOKENS[text]


def test_bm25(spark):
    docs = rank.with_tokens(spark.createDataFrame([(0, "cat dog cat"), (1, "dog bird"), (2, "fooBar cat")], "doc_id long, text string"))
    assert sorted((r.doc_id, r.dl) for r in rank.doc_lengths(docs).collect()) == [(0, 3), (1, 2), (2, 4)]
    got = {r.doc_id: r.score for r in rank.bm25(docs, ["cat", "cat"]).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    want = {0: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 3)), 2: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / 3))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert rank.min_hits(0.67, 3) == 3 and rank.min_hits(0.6, 1) == 1
    assert not rank.dense_allowed(["a"], list("abcde")) and rank.dense_allowed(["a", "b"], list("abcde"))


def test_bm25_cuts_texts_once(spark):
    """Statistics and postings read what one pass over the texts wrote."""
    docs = rank.with_tokens(spark.createDataFrame([(0, "cat dog cat"), (1, None)], "doc_id long, text string"))
    assert "regexp" in docs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in rank.bm25(docs, ["cat"])._jdf.queryExecution().optimizedPlan().toString()


def test_span_merge(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 4, 5), ("k", 7, 9), ("j", 7, 9)], "k string, start long, end long")
    assert sorted(tuple(r) for r in spans.merge_spans(df, ["k"]).collect()) == [("j", 7, 9), ("k", 1, 5), ("k", 7, 9)]
    assert sorted(tuple(r) for r in spans.merge_spans(df, ["k"], 2).collect()) == [("j", 7, 9), ("k", 1, 9)]


def test_span_merge_tasks(spark, monkeypatch):
    """Spans are dealt by their number, which AQE leaves as it is."""
    df = spark.range(1000).selectExpr("id % 100 AS k", "id AS start", "id + 50 AS end")
    want = sorted(tuple(r) for r in spans.merge_spans(df, ["k"], 50).collect())
    monkeypatch.setattr(spans, "TASK_SPANS", 40)
    got = spans.merge_spans(df, ["k"], 50)
    assert got.rdd.getNumPartitions() == 25 and sorted(tuple(r) for r in got.collect()) == want == [(k, k, k + 950) for k in range(100)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, 40), (2, 41), (3, 0), (4, 100)], "b long, n long")
    got = [(r.b, r.start_line, r.end_line) for r in spans.chunks(df, F.col("n")).orderBy("b", "start_line").collect()]
    assert got == [(1, 1, 40), (2, 1, 40), (2, 31, 41), (4, 1, 40), (4, 31, 70), (4, 61, 100)]


def test_context(spark):
    df = spark.createDataFrame([("q", 1, 9000), ("q", 2, 10)], "q string, rank int, tokens long")
    assert [(r.rank, r.packed_tokens) for r in context.pack_blocks(df, ["q"]).collect()] == [(1, 8000)]
    df = spark.createDataFrame([("q", 1, 50), ("q", 2, 60), ("q", 3, 50)], "q string, rank int, tokens long")
    assert [r.rank for r in context.pack_blocks(df, ["q"], 100).collect()] == [1, 3]
    assert context.clip_around(["aaaa"] * 9, 4, 15) == (3, 5) and context.utf8_prefix("aé", 2) == "a"


ROUTES = [
    ("/api/orders/${id}", "api/orders/:id", "Exact"), ("https://orders-svc/api/orders", "api/orders", "Exact"), ("/api/orders?page=2", "api/orders", "Exact"), ("/api/orders/42", "api/orders/{id}", "Parameterized"),
    ("/{host}/{stage}/api/orders", "api/orders", "Parameterized"), ("/{a}/{b}/{c}/api/orders", "api/orders", "NoMatch"), ("/v1/api/orders", "api/orders", "NoMatch"), ("/{a}/{b}", "orders/{id}", "NoMatch"),
    ("/files/a/b/c", "files/{*rest}", "Parameterized"), ("/x", "x/{id}", "NoMatch"),
]


def test_routes(spark):
    df = spark.createDataFrame(ROUTES, "c string, h string, want string")
    got = df.select("c", "h", "want", routes.quality(routes.segments(F.col("c")), routes.segments(F.col("h"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_manifests(spark):
    mod = "module x.org/me\nrequire (\n\tx.org/you/v2 v2.1.0 // indirect\n)\nrequire y.org/a v1.0.0\n"
    assert [(r["name"], r["indirect"], r["provides"]) for r in manifests.parse("go", mod)] == [("x.org/me", False, True), ("x.org/you/v2", True, False), ("y.org/a", False, False)]
    assert [(r["name"], r["dev"]) for r in manifests.parse("npm", '{"name": "a", "dependencies": {"b": "1"}, "devDependencies": {"c": "2"}}')] == [("a", False), ("b", False), ("c", True)]
    assert manifests.parse("nuget", '<Project><ItemGroup><PackageReference Include="A.B" Version="1"/></ItemGroup></Project>')[0]["name"] == "A.B"
    assert [r["name"] for r in manifests.parse("pypi", "a_b[c]>=1 ; x\n# no\n-r y\nd\n")] == ["a_b", "d"]
    assert manifests.parse("pypi", '[project]\nname = "p"\ndependencies = ["q>1"]\n')[1]["version"] == ">1"
    df = spark.createDataFrame([("go.mod",), ("a/vendor/go.mod",), ("b/package.json",), ("x.csproj",), ("requirements-dev.txt",), ("y.txt",)], "p string")
    assert [r[0] for r in df.select(manifests.kind_of(F.col("p"))).collect()] == ["go", None, "npm", "nuget", "pypi", None]
    need = spark.createDataFrame([("r", "pypi", "My_Pkg"), ("r", "npm", "own"), ("r", "go", "x/y/z")], "repo string, ecosystem string, name string")
    have = spark.createDataFrame([("s", "pypi", "my.pkg"), ("t", "pypi", "my-pkg"), ("r", "npm", "own"), ("s", "npm", "own"), ("s", "go", "x"), ("u", "go", "x/y")], "repo string, ecosystem string, name string")
    got = sorted((r.name, r.provider_repo, r.confidence) for r in manifests.resolve(need, have).collect())
    assert got == [("My_Pkg", "s", 0.9), ("My_Pkg", "t", 0.9), ("x/y/z", "u", 1.0)]


def test_symbols(spark):
    go = "package a\n\nfunc Save(x int) {\n\tStore(x) // Load()\n}\n\ntype Card struct {\n}\n"
    got = symbols.extract("a.go", go)
    assert [(n, k) for n, k, *_ in got] == [("Save", "func"), ("Card", "type"), ("Store", "call")]
    sql = "CREATE TABLE dbo.Refund (a int);\nCREATE PROCEDURE dbo.Pay AS\nSELECT 1\n"
    assert [(n, k) for n, k, *_ in symbols.extract("a.sql", sql)] == [("Refund", "type"), ("Pay", "func")]
    cs = 'public class OrderConsumer : IConsumer<OrderSubmitted> {\n  public void Run(int a)\n  {\n    if (a > 0) { Go("x()"); }\n  }\n}\n'
    names = {(n, r) for n, _, _, _, r in symbols.extract("a.cs", cs)}
    assert {("OrderConsumer", "definition"), ("Run", "definition"), ("Go", "reference")} <= names and ("if", "reference") not in names
    fs = files(spark, ("r", "a.go", "1", go), ("r", "b.cs", "2", cs))
    found = symbols.symbols(fs)
    assert found.filter("role = 'definition'").count() == 4
    assert {(r.name, r.kind) for r in symbols.classify(fs).collect()} == {("OrderSubmitted", "event")}
    defs = spark.createDataFrame([("k", "outer", 0, 9000), ("k", "inner", 10, 20)], "key string, name string, start long, body_end long")
    at = spark.createDataFrame([("k", 15), ("k", 8000), ("k", 9500)], "key string, at long")
    assert {(r.at, r.name) for r in symbols.enclosing(at, defs).collect()} == {(15, "inner"), (8000, "outer"), (9500, None)}


EDGES = [("Root", "Save", "calls", 2, "e"), ("Root", "Card", "calls", 1, "e"), ("Save", "Database", "uses_type", 4, "e"), ("Consumer", "Submitted", "consumes", 3, "e")]


def test_graph(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, type string, tier int, evidence string")
    root = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    got = {r.node: (r.hop, r.tier) for r in graph.traverse(edges, root("Database"), 3).collect()}
    assert got == {"Database": (0, 4), "Save": (1, 4), "Root": (2, 2)}
    assert {r.node for r in graph.traverse(edges, root("Root"), 1, ("calls",), direction="out").collect()} == {"Root", "Save"}
    assert {r.node for r in graph.traverse(edges, root("Root"), 1, ("calls",), floor=1, direction="out").collect()} == {"Root", "Save", "Card"}
    up = graph.deduplicated(edges.unionByName(spark.createDataFrame([("Root", "Card", "calls", 3, "z")], edges.schema)))
    assert up.filter("dst = 'Card'").select("tier", "evidence").first() == (3, "z")
    two = [(a, b, "calls", 2, "e") for g in ("abc", "xyz") for a in g for b in g if a < b] + [("a", "x", "imports", 2, "e")]
    own = {r.node: r.community for r in graph.communities(spark.createDataFrame(two, edges.schema)).collect()}
    assert own["a"] == own["b"] == own["c"] != own["x"] == own["y"] == own["z"]


def test_traverse_raw_edges(spark):
    """Edges as they come give what deduplicated ones give, and no sort by evidence is needed; one hop reads the roots' edges."""
    raw = [(f"n{i}", f"n{i * j % 7}", t, tier, e) for i in range(7) for j in (1, 2, 3) for t in ("calls", "imports") for tier, e in ((1 + (i + j) % 4, "a"), (1 + i * j % 4, "b"))]
    edges = spark.createDataFrame(raw, "src string, dst string, type string, tier int, evidence string")
    roots = spark.createDataFrame([("n3",), ("n3",), ("n9",)], "node string")
    for hops in (0, 1, 2, 3):
        for direction in ("in", "out", "both"):
            rows = lambda e: sorted(tuple(r) for r in graph.traverse(e, roots, hops, ("calls", "imports"), 2, direction).collect())  # noqa: B023, E731
            assert rows(edges) == rows(graph.deduplicated(edges))
    from corpusloom.plans import graph_plans

    steps = []
    keep = graph.materialise
    graph.materialise = lambda df, name: (steps.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1]
    try:
        graph_plans.trace_consumers(spark, "/root/testdata/sf0.001")
    finally:
        graph.materialise = keep
    assert "steps" not in dict(steps) and not any("SortAggregate" in plan or "evidence" in plan for _, plan in steps)


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("axdyz")], "query string, item string, pos int")
    gold = spark.createDataFrame([("q", x, 1) for x in "abcd"], "query string, item string, grade int")
    at = lambda k: evaluation.metrics(ranked, gold, k).first()
    assert (at(3).recall, at(1).recall, at(0).recall) == (0.5, 0.25, 0.5)
    assert at(3).precision == round(2 / 3, 6) and at(3).mrr == 1.0


def test_reranker():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 10, 100]
    y = (x[:, 1] > 0).astype(float)
    w, b = evaluation.train_reranker(x, y, epochs=20)
    assert (((x @ w + b) > 0) == (y > 0)).mean() > 0.95


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 64))
    v[1] = v[0] + 0.1 * v[1]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    s = v @ v.T - 2 * np.eye(60)
    want = {(i, j) for i in range(60) for j in range(60) if s[i, j] >= 0.6}
    assert {(r.vec_id, r.other_id) for r in vectors.similar(df).collect()} == want
    assert {(r.vec_id, r.other_id) for r in vectors.similar_lsh(df, 64).collect()} <= want


def test_all_pairs_in_blocks(spark, monkeypatch):
    """Blocks of three sizes, ties, copies and null vectors against all pairs; what meets is shuffled by no key."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    v[30:50] = v[3]
    v[50:60] = 2 * v[4]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([*rows, (200, None), (None, rows[0][1])], "vec_id long, embedding array<float>")
    s = np.round(v.astype(np.float64) @ v.T.astype(np.float64), 6)
    want = {(i, int(j), s[i, j]) for i in range(90) for j in [j for j in np.lexsort((np.arange(90), -s[i])) if j != i and s[i, j] >= 0.3][:3]}
    for least, most in ((1024, 16384), (10, 16384), (10, 7)):
        monkeypatch.setattr(vectors, "LEAST", least)
        monkeypatch.setattr(vectors, "MOST", most)
        got = vectors.similar(df, 3, 0.3)
        assert {(r.vec_id, r.other_id, r.cosine) for r in got.collect()} == want
        assert "collect_list" not in (plan := got._jdf.queryExecution().toString()) and "CartesianProduct" in plan


def test_lsh_recall(spark):
    """At least 0.9 of similar()'s pairs just over the threshold, by buckets; all of them up to the exact limit."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 600, 2):  # pairs with a cosine of 0.60 to 0.66
        c = rng.uniform(0.601, 0.66)
        side = v[i + 1] - (v[i + 1] @ v[i]) * v[i]
        v[i + 1] = c * v[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    pairs = lambda d: {(r.vec_id, r.other_id, r.cosine) for r in d.collect()}
    want, got = pairs(vectors.similar(df)), pairs(vectors.similar_lsh(df, 64, exact_limit=0))
    assert len(want) >= 600 and got <= want and len(got) >= 0.9 * len(want)
    assert pairs(vectors.similar_lsh(df, 64)) == want


def test_whole_sources(spark, tmp_path):
    """All lines of all documents are numbered; documents past a source's 40th are offered to the packing."""
    long = "\n".join(f"line {i}" for i in range(1, 701))
    sizes = [3000, *[1001] * 42, 300, 200]
    rows = [(i, "x" * 4 * n, "en", "a", 4 * n) for i, n in enumerate(sizes)] + [(100, long, "en", "b", len(long))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    packed = {r.doc_id for r in rank_plans.block_pack(spark, str(tmp_path)).collect()}
    assert packed == {0, 43, 44, 100}
    got = {r.doc_id: r.sha for r in rank_plans.numbered_source(spark, str(tmp_path)).collect()}
    want = "\n".join(f"{i:6d}\tline {i}" for i in range(1, 701))
    assert len(got) == len(rows) and got[100] == hashlib.sha256(want.encode()).hexdigest()


def test_refresh(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, s string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, s string")
    got = lambda **o: {r.k: r.change for r in incremental.classify(old, new, "k", "s", **o).collect()}
    assert got() == {"a": "same", "b": "changed", "c": "removed", "d": "added"}
    assert got(failed=old.filter("k = 'c'"))["c"] == "carried"
    assert incremental.verdict(old, new).first().verdict == "BOTH" and incremental.verdict(old, old).first().verdict == "OK"


def test_store_and_policy(spark):
    fs = files(spark, ("r", "a/b/c.go", "1", "x"), ("r", "a/bc.go", "2", "y"), ("r", ".git/x", "3", "z"))
    policy = spark.createDataFrame([("a/b", 1), ("a", 2)], "prefix string, level int")
    assert {r.rel_path for r in corpus.allowed(fs, policy).collect()} == {"a/bc.go", ".git/x"}
    with pytest.raises(ValueError):
        corpus.allowed(fs, spark.createDataFrame([("a", None)], "prefix string, level int"))
    assert {r.rel_path for r in fs.filter(corpus.vcs_internal(F.col("rel_path"))).collect()} == {".git/x"}
    assert corpus.put_blobs(fs.filter("blob_sha < '2'"), fs).count() == 2
    assert {r.rel_path for r in corpus.in_scope(fs, "r", "a/b", "go").collect()} == {"a/b/c.go"}


def test_facts(spark):
    b = spark.createDataFrame([("b1", "s", "x", 0, 10, "c1", "i"), ("b2", "s", "x", 2, 5, "c2", "m")], "binding_id string, source_id string, context_id string, start int, end int, caller_id string, callee_id string")
    sources = spark.createDataFrame([("s", "r", "p")], "source_id string, repo string, path string")
    impl = spark.createDataFrame([("i", "m")], "interface_id string, implementation_id string")
    assert [r.binding_id for r in facts.bindings_at(b, sources, "r", "p", 3).collect()] == ["b2", "b1"]
    assert {(r.caller_id, r.via_interface) for r in facts.contract_impact(b, impl, "m").collect()} == {("c1", True), ("c2", False)}
    assert facts.dangling(b, "source_id", sources, "source_id").count() == 0


def test_sources(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "a").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a/x.go").write_bytes(b"\xef\xbb\xbfpackage a\n")
    (root / "bin").write_bytes(b"a\0b")
    (root / ".git/HEAD").write_text("ref")
    got = read_files(spark, str(root), "r").collect()
    assert [(r.rel_path, r.content) for r in got] == [("a/x.go", "package a\n")]
    snaps = Snapshots(spark, str(tmp_path / "snaps"))
    own = snaps.commit({"t": spark.range(3).toDF("x")}, "g1")
    assert snaps.current() is None and snaps.ids() == ["g1"]
    snaps.set_current(own)
    assert snaps.current() == "g1" and snaps.load("t").count() == 3
    with pytest.raises(ValueError):
        snaps.commit({"t": spark.range(1).toDF("x")}, "g1")
    with pytest.raises(ValueError):
        snaps.set_current("g2")


def test_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import ingest

    schema = "doc_id long, text string, lang string, source string"
    docs = lambda *ts: spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(ts)], schema)
    src = str(tmp_path / "in")
    docs("a", "b").coalesce(1).write.parquet(src)
    docs("b", "c").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        ingest(spark, docs("x").schema, src, str(tmp_path / "store"), str(tmp_path / "check"))
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "store")).select("content").collect()) == ["a", "b", "c"]


BILLING = """public interface IRefund { }
public class Refund : Base, IRefund {
  private readonly Store store;
  public Refund(Store store, int n) { }
  public void Run() { db.Orders.First(); // db.Cards
    bus.Publish<Submitted>(x); var s = "db.Cards"; }
}
public class Base { }
public class Store { public DbSet<Order> Orders { get; set; } }
public class Order { }
public class Submitted { }
public class Consumer : IConsumer<Submitted> { }
"""
WEB = """import x from 'y';
@Component({ selector: 'app-card', template: `<app-badge></app-badge>` })
export class Card extends Panel implements OnInit { }
@Component({ selector: 'app-badge' })
export class Badge { }
export class Panel { }
"""


def test_relations(spark):
    fs = files(spark, ("r", "a.cs", "1", BILLING), ("r", "b.ts", "2", WEB), ("r", "c.html", "3", "<app-card></app-card>"), ("q", "d.cs", "4", "class Base { }\nclass C : Base { }"))
    got = {(r.src, r.dst, r.type, r.tier) for r in relations.relation_edges(fs).collect()}
    assert {("Refund", "IRefund", "implements", 2), ("Refund", "Base", "extends", 2), ("Refund", "Base", "extends", 1), ("C", "Base", "extends", 2)} <= got
    assert {("Refund", "Store", "injects", 2), ("Refund", "Order", "queries", 2), ("Refund", "Submitted", "publishes", 2), ("Consumer", "Submitted", "consumes", 2)} <= got
    assert {("Card", "Badge", "renders", 2), ("c.html", "Card", "renders", 2), ("Card", "Panel", "extends", 2)} <= got
    assert not any(t == "queries" and d != "Order" for _, d, t, _ in got)
    inside = {(r.src, r.dst) for r in relations.containment(symbols.symbols(fs)).collect()}
    assert ("Refund", "Run") in inside
    names = spark.createDataFrame([("Submitted",), ("Orders",)], "name string")
    uses = {(r.name, r.use, r.tier) for r in relations.verified_uses(fs, names).collect()}
    assert ("Orders", "identifier", 1) in uses and ("Submitted", "type", 2) in uses


def test_verify_use():
    text = "import a.Save\nSave(1)\nvar x = new Save()\n// Save(2)\n"
    at = [i for i in range(len(text)) if text.startswith("Save", i)]
    assert [relations.verify_use("x.cs", text, "Save", i) for i in at] == ["import", "call", "type", "masked"]


def test_expand_block():
    code = "func a() {\n  x\n  y\n  z\n  w\n  v\n}\nfunc b() {\n}".split("\n")
    assert context.expand_block(code, 1, 1, 0) == (1, 7) and context.expand_block(code, 7, 7, 0) == (1, 7)
    assert context.expand_block(code, 3, 3, 0) == (1, 6) and context.expand_block(["a", "b", "c"], 2, 2, 0) == (2, 2)
    assert context.expand_block(code, 3, 3, 1) == (1, 6) and context.expand_block(["a {"], 1, 1, 3) == (1, 1)


def test_domain_facts(spark):
    own = "symbol:" + "a" * 64
    rows = [
        ("ok", "di_registration", "csharp-framework-v1", "scoped", None, [("service", own), ("implementation", own)]),
        ("kind", "other", "csharp-framework-v1", None, None, []),
        ("rule", "message_publish", "csharp-framework-v4", None, None, [("message", own)]),
        ("lifetime", "di_registration", "csharp-framework-v1", "once", None, [("service", own), ("implementation", own)]),
        ("roles", "message_publish", "csharp-framework-v1", None, None, [("entity", own)]),
        ("route", "endpoint_post_configuration", "csharp-endpoint-v1", None, " ", [("handler", own)]),
        ("target", "message_publish", "csharp-framework-v1", None, None, [("message", "symbol:x")]),
    ]
    df = spark.createDataFrame(rows, "fact_id string, kind string, rule string, lifetime string, route_pattern string, targets array<struct<role: string, symbol_id: string>>")
    assert {(r.fact_id, r.reason) for r in facts.bad_domain_facts(df).collect()} == {(k, k) for k in ("kind", "rule", "lifetime", "roles", "route", "target")}


def test_battery_and_planned_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    terms = rank.term_stats(rank.with_tokens(docs)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = evaluation.battery(terms, 2).collect()
    assert {r.bucket for r in rows} == {"common", "rare", "short", "folded", "unicode", "regex"}
    assert [tuple(r) for r in rows] == [tuple(r) for r in evaluation.battery(terms.repartition(3), 2).collect()]
    fs = corpus.files_of(docs)
    lines = corpus.lines_of(fs, "doc_id").cache()
    for r in rows[::3]:
        from corpusloom.functions.regexplan import java

        plain = lines.filter(F.rlike("line_text", F.lit(java(r.pattern)))).select("doc_id", "line").distinct().count()
        assert grep.regex(fs, r.pattern).count() == plain
    df = spark.createDataFrame([("a", x) for x in range(1, 101)], "b string, ms int")
    assert tuple(evaluation.nearest_rank(df, "b", "ms").first()) == ("a", 100, 51, 96, 100)


def test_pack_blocks_by_brute_force(spark):
    """Every greedy packing in rank order, with sizes over the budget, of zero, and repeated."""
    rng = random.Random(7)
    rows = [(q, i, rng.choice([0, 0, 1, 2, 3, 5, 8, 30, 41, 60])) for q in range(12) for i in range(rng.randrange(1, 120))]
    want = set()
    for q in range(12):
        used, first = 0, True
        for _, i, n in sorted(r for r in rows if r[0] == q):
            n = min(n, 40) if first else n
            if first or used + n <= 40:
                used, first = used + n, False
                want.add((q, i, n))
    got = context.pack_blocks(spark.createDataFrame(rows, "q int, rank int, tokens long"), ["q"], 40)
    assert got.columns == ["q", "rank", "tokens", "packed_tokens"]
    assert {(r.q, r["rank"], r.packed_tokens) for r in got.collect()} == want and got.count() == len(want)
