"""The kept index against a scan of all texts, graph evaluation and result order by hand."""

import random

import pytest

from corpusloom.functions import regexplan
from corpusloom.operators import corpus, evaluation, graph, grep, index, rank

ROWS = [(1, "Apache License\nx", "en", "s"), (2, "apache\n\nlicense", "en", "s"), (3, None, "de", "t"), (4, "", "de", "t"), (5, "Straße ß 😀 License", "fr", "s"), (6, "ab", "fr", "t"), (7, "Apache License\nx", "en", "t"), (None, "the License", None, None)]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, "".join(rng.choice("abLcense \n") for _ in range(40)), "en", "s") for i in range(60)]
    return corpus.files_of(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def test_blob_grams(spark, files):
    got = files.select("content", index.blob_grams(files.content).alias("g")).collect()
    for content, grams in got:
        data = content.encode()
        assert sorted(grams) == sorted({data[i : i + 3].hex().upper() for i in range(len(data) - 2)})


@pytest.mark.parametrize("fraction", [1.0, 0.1, 0.0])
def test_search_equals_scan(spark, files, tmp_path, fraction):
    index.build_grams(corpus.blobs_of(files), fraction, str(tmp_path))
    kept = index.load_grams(spark, str(tmp_path))
    assert kept.postings.select("gram").distinct().count() == kept.counts.filter("kept").count()
    for pattern, fold in ((r"License", False), (r"apache", True), (r"ß", False), (r"(Lic|the) ?[a-z]+", False), (r"nowhere", False), (r"x|License", False), (r".*", False), (r"😀", False)):
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(index.search(kept, files, pattern, fold)) == rows(grep.regex(files, pattern, fold)), pattern
    near = index.candidates(kept, regexplan.needed("License"))
    if fraction == 1.0:
        assert near.count() == 3 and index.candidates(kept, regexplan.needed("nowhere")).count() == 0
    if fraction == 0.0:
        assert near is None


@pytest.mark.parametrize("most", [(8 << 20, 7), (50, 1 << 14), (3, 3)])
def test_segments(spark, files, monkeypatch, most):
    """Postings are a list a segment and gram, not a row a gram and blob; texts longer than a segment have all their grams."""
    monkeypatch.setattr(index, "SEGMENT_BYTES", most[0])
    monkeypatch.setattr(index, "SEGMENT_TEXTS", most[1])
    blobs = corpus.blobs_of(files)
    kept = index.build_grams(blobs)
    got = kept.postings.selectExpr("gram", "segment", "explode(blobs) AS n").join(kept.names.selectExpr("segment", "posexplode(names) AS (n, blob_sha)"), ["segment", "n"])
    want = {(r.blob_sha, r.content.encode()[i : i + 3].hex().upper()) for r in blobs.collect() for i in range(len(r.content.encode()) - 2)}
    assert sorted((r.blob_sha, r.gram) for r in got.collect()) == sorted(want)
    assert kept.postings.count() == kept.postings.select("gram", "segment").distinct().count()
    assert {r.gram: r.df for r in kept.counts.collect()} == {g: sum(x == g for _, x in want) for _, g in want}
    assert sorted(r.content for r in index.search(kept, files, "(Lic|the) ?[a-z]+").join(files, ["doc_id"]).collect()) == sorted(r.content for r in grep.regex(files, "(Lic|the) ?[a-z]+").join(files, ["doc_id"]).collect())


def test_grams_of_nothing(spark, files):
    kept = index.build_grams(corpus.blobs_of(files.limit(0)))
    assert kept.counts.count() == 0 and index.search(kept, files.limit(0), "License").count() == 0


def test_bm25_equals_scan(spark, tmp_path):
    docs = rank.with_tokens(spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string"))
    index.build_tokens(docs, str(tmp_path))
    kept = index.load_tokens(spark, str(tmp_path))
    for terms in (["license", "apache"], ["the", "the"], ["nowhere"]):
        rows = lambda df: sorted((str(r.doc_id), round(r.score, 9)) for r in df.collect())
        assert rows(index.bm25(kept, terms)) == rows(rank.bm25(docs, terms))
    plan = index.bm25(kept, ["license"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan


def test_token_lists(spark):
    """Postings are a list a segment and term, made without a shuffle; lengths and counts of all documents, of empty ones too."""
    texts = [(i, " ".join(["cat"] * (i % 4) + ["dog", f"w{i}"] * (i % 3))) for i in range(50)] + [(None, "cat")]
    docs = rank.with_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    kept = index.build_tokens(docs)
    want = {(i, w, len(t.split()), t.split().count(w)) for i, t in texts for w in t.split()}
    got = kept.postings.filter("term IS NOT NULL").selectExpr("term", "inline(docs)").collect()
    assert {(r.doc_id, r.term, r.dl, r.tf) for r in got} == want and len(got) == len(want)
    assert kept.postings.filter("term = 'dog'").count() <= 3
    assert tuple(kept.stats.first()) == (51, sum(len(t.split()) for _, t in texts) / 51)
    assert index.build_tokens(docs.limit(0)).stats.first().n == 0


def test_graph_metrics(spark):
    """Nodes alone are judged for a, both for b; c has no relevant label; d is not answered."""
    nodes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("c", "x", 1)], "query string, item string, pos int")
    node_gold = spark.createDataFrame([("a", "y", 1), ("b", "x", 1), ("c", "x", 0), ("d", "x", 1)], "query string, item string, grade int")
    edges = spark.createDataFrame([("b", "e", 1), ("b", "f", 2), ("b", "f", 3)], "query string, item string, pos int")
    edge_gold = spark.createDataFrame([("b", "f", 2)], "query string, item string, grade int")
    got = {r.query: r for r in evaluation.graph_metrics(nodes, node_gold, edges, edge_gold, 2).collect()}
    assert sorted(got) == ["a", "b", "d"] and (got["a"].recall, got["a"].mrr, got["d"].recall) == (1, 0.5, 0)
    assert (got["b"].recall, got["b"].precision, got["b"].mrr) == (1, 0.75, 0.75)
    tiers = edges.selectExpr("query", "item", "CASE WHEN pos = 3 THEN 'Proven' ELSE 'Pattern' END AS tier", "pos")
    assert {r.tier: (r.returned, r.hits, r.precision) for r in evaluation.tier_precision(tiers, edge_gold).collect()} == {"Candidate": (0, 0, 0.0), "Pattern": (2, 1, 0.5), "Verified": (0, 0, 0.0), "Proven": (0, 0, 0.0)}


def test_floors():
    report, tiers = {"recall": 0.9, "mrr": 0.05, "ndcg": 0.8}, {"Pattern": 0.5, "Verified": 1.0, "Proven": 0.05}
    floors = evaluation.calibrated_floors(report, tiers)
    assert floors["mrr"] == floors["Proven"] == 0 and abs(floors["recall"] - 0.83) < 1e-9 and abs(floors["Verified"] - 0.9) < 1e-9
    assert evaluation.below_floors(report, tiers, floors) == []
    assert evaluation.below_floors(report | {"ndcg": 0.7}, tiers | {"Verified": 0.8}, floors) == ["ndcg", "Verified"]
    for bad in ({}, floors | {"recall": 1.5}, floors | {"Proven": float("nan")}):
        with pytest.raises(ValueError):
            evaluation.below_floors(report, tiers, bad)


def test_result_order(spark):
    rows = [("far", 2, 4, "a", "r", "a/b/x"), ("weak", 1, 2, "a", "r", "a/b/x"), ("other", 1, 4, "a", "q", "a/b/x"), ("deep", 1, 4, "z", "r", "./a/b/c/x"), ("flat", 1, 4, "a", "r", "x"), ("flat", 1, 4, "a", "r", None), ("twin", 1, 4, "a", None, "z/a/x"), ("twin", 1, 4, "a", "r", "a/x")]
    nodes = spark.createDataFrame(rows, "node string, hop int, tier int, symbol string, repo string, path string")
    got = graph.result_order(nodes, [("r", "a/b/root")], 5).orderBy("place").collect()
    assert [(r.node, r.same_repo, r.depth) for r in got] == [("deep", True, 2), ("twin", True, 1), ("flat", True, 0), ("other", False, 2), ("weak", True, 2)]
    assert graph.result_order(nodes, [], 9).count() == 6
