"""The pipeline's stages against plain versions, and the registry."""

import re

import pytest

import corpus_pipeline
from corpusloom.llm import packing, registry

from .test_jaccard import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from corpusloom.llm.common import materialise

    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    columns = docs.columns
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(f(spark, docs, DIR), "test")
        assert i + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns
        out.append({"rows": docs.collect(), "columns": docs.columns})
    return out


def test_stages(spark, stages):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    first = {r.doc_id for r in stages[0]["rows"]}
    assert len(first) >= 0.98 * len(rows)  # the documents are in known languages
    groups = {}
    for r in stages[0]["rows"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    second = {min(g)[1] for g in groups.values()}
    assert {r.doc_id for r in stages[1]["rows"]} == second
    split = [(r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in stages[1]["rows"]]
    third = {i for i, (_, c) in brute(split, 5, 80).items() if i == c}
    assert {r.doc_id for r in stages[2]["rows"]} == third
    assert {r.doc_id for r in stages[3]["rows"]} <= third
    want = sum(-(-len((r.text or "").encode()) // 4) + 1 for r in stages[3]["rows"])
    assert sum(r.piece_tokens for r in stages[4]["rows"]) == want
    bins = {}
    for r in stages[4]["rows"]:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.piece_tokens, r.bin_tokens, r.bin_capacity))
    for pieces in bins.values():
        at = 0
        for offset, n, total, capacity in sorted(pieces):
            assert offset == at
            at += n
        assert at == total <= capacity in packing.CAPACITIES


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DIR)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[4]["rows"]))


def test_registry():
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(names)
