"""The pipeline, stage by stage on its own input, and how its queries are registered."""

import hashlib
import importlib
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_corpus_operators import plain_components, plain_overlaps
from test_text_operators import plain_spans

import corpus_pipeline
from ledgerlight.llm import byte_bpe, registry, toxicity
from ledgerlight.llm import factorisation as fm


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage, with some rows that the tables don't have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [(100_000, None, None, None, None), (100_001, "", "en", "s", 0), (100_002, first["text"], "en", "s", 1), (None, "no id", "en", "s", 5)]
    planted += [(100_003, "before " * 9 + item + " after" * 9, "en", "s", 1), (100_004, 'clean words, password = "hunter2hunter2" and more', "en", "s", 49)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema)).withColumn("extra", F.lit("kept"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, out[-1], sf_dir)
        out.append(spark.createDataFrame(done.collect(), done.schema))
    return out


def rows(df):
    return sorted(map(repr, df.collect()))


def test_all_but_the_last_keep_the_columns(stages):
    assert len(stages) == 6 and all(s.columns == stages[0].columns for s in stages[:5])


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in stages[0].collect() if model.score(fm.features(r["text"] or "", (), model.spec)) < 0.5]
    assert rows(stages[1]) == sorted(map(repr, want))
    assert any(r["doc_id"] == 100_001 for r in want)


def test_one_of_each_group_stays(stages):
    held = stages[1].collect()
    label = plain_components([(r["doc_id"], r["text"]) for r in held], 5, 80, 100)
    want = [r for r, (i, _, c) in zip(held, label, strict=True) if c is None or i == c]
    assert rows(stages[2]) == sorted(map(repr, want))
    assert not any(r["doc_id"] == 100_002 for r in want)


def test_benchmark_passages_go(spark, sf_dir, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = stages[2].collect()
    taken = {i for i, t in ((r["doc_id"], r["text"]) for r in held) if any(u and u in (t or "") for _, u in items)}
    kept = {r["doc_id"] for r in stages[3].collect()}
    assert 100_003 in taken and not taken & kept
    gone = [(r["doc_id"], r["text"]) for r in held if r["doc_id"] not in kept]
    assert {r[0] for r in plain_overlaps(gone, items)} == {i for i, _ in gone}


def test_secrets_are_blanked(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not plain_spans(r["text"])
        if not plain_spans(before[i]["text"]):
            assert r == before[i]
        else:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
    assert "[SECRET]" in after[100_004]["text"]


def test_tokens_are_those_of_the_library(stages):
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in stages[4].collect():
        ids = bpe.encode_ordinary(r["text"] or "")
        want.append(repr((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())))
    assert sorted(repr(tuple(r)) for r in stages[5].collect()) == sorted(want)


def test_run_applies_all_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_stages_over_no_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_queries_are_there_only_with_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES} and "pipeline" in names
    assert set(entry.oracle_sql()) >= set(registry.SQL)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        assert set(importlib.reload(entry).queries()) == names - set(registry.QUERIES) - {"pipeline"}
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import oracle

    differences, n = oracle.compare(spark, oracle.connect(sf_dir), registry.QUERIES[name], registry.SQL[name], sf_dir)
    assert not differences and n, differences
