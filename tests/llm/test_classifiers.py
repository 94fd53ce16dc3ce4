"""Factorisation machines: interactions, held-out accuracy, bounds and edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import factorisation as fm
from ledgerlight.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LARGER = "/root/testdata/sf0.1"


def test_scores_are_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = fm.Model(fm.Spec(), np.arange(9), 0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32))
    for held in ([], [2], [0, 3, 8], list(range(9)), [50, 60]):
        known = [i for i in held if i < 9]
        z = 0.3 + sum(float(model.weights[i]) for i in known)
        z += sum(float(model.factors[i] @ model.factors[j]) for i in known for j in known if i < j)
        assert model.score(np.array(held, np.int64)) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_pairs_count_for_more_than_words():
    # A label that no additive weights give: exactly one of two words.
    texts = [("insult", 0), ("group", 0), ("insult group", 1), ("other", 1)]
    spec = fm.Spec(epochs=60)
    rows = [(i, float(y), fm.features(t, (), spec).astype(np.int32).tobytes()) for i, (t, y) in enumerate(texts * 40)]
    keep = fm.informative
    try:
        fm.informative = lambda sparse, labels, most: np.unique(np.concatenate(sparse))
        model = fm.fit(rows, spec)
    finally:
        fm.informative = keep
    got = {t: model.score(fm.features(t, (), spec)) for t, _ in texts}
    assert all((got[t] > 0.5) == bool(y) for t, y in texts), got


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the larger tables")
@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity, "toxic", 0.98), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    scored = operator.score(docs, labels).join(labels, "doc_id").where("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    recall = scored.where(f"{label} = {int(label == 'toxic')}").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least and recall >= 0.85, (right, recall)


EDGES = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n", None, None, -5), (None, "no id", "x", "y", 5), (5, "w " * 100_000, "en", "s", 200_000), (6, "same", "a", "b", 4), (6, "same", "c", "d", 4)]


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_edges(spark, sf_dir, operator):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = operator.train(docs, labels)
    frame = spark.createDataFrame(EDGES, DOCS).withColumn("score", F.lit("clash")).withColumn("id", F.lit(1))
    rows = fm.score_documents(frame, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    # Languages, sources and ids change nothing; a table without the metadata is scored too.
    other = frame.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(str, rows)) == sorted(map(str, fm.score_documents(other, model).collect()))
    assert fm.score_documents(frame.drop("n_chars"), model).count() == len(EDGES)
    assert fm.score_documents(frame.limit(0), model).count() == 0
    none = operator.score(frame, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["held_out"] for r in none if r["doc_id"] is None} == {False}
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (6, 1, 1), (6, 0, 0), (2, 0, 0)], LABELS)
    assert operator.score(frame, odd).count() == len(EDGES)


def test_sample_is_bounded(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert len(fm.sample_features(docs, toxicity.training_labels(labels), fm.Spec(sample=7), "doc_id", "text")) == 7


def test_sample_takes_one_row_of_a_repeated_id(spark):
    texts = [(i, f"text of {i}", "en", "s", i) for i in range(5)] + [(3, f"other {k % 20}", "en", "s", k) for k in range(200)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(5)], LABELS)
    spec = fm.Spec(sample=5, metadata=("n_chars",))
    got = [
        fm.sample_features(spark.createDataFrame(rows, DOCS), toxicity.training_labels(labels), spec, "doc_id", "text")
        for rows in (texts, texts[::-1], texts[3:4] + texts[:3] + texts[4:])
    ]
    assert len({r[0] for r in got[0]}) == len(got[0]) == 5 and got[0] == got[1] == got[2]


def test_toxic_documents_are_dropped(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    kept = toxicity.drop(docs.withColumn("doc_id2", F.col("doc_id")), model)
    scores = {r["doc_id"]: r["score"] for r in fm.score_documents(docs, model).collect()}
    assert kept.columns == [*docs.columns, "doc_id2"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in scores.items() if s < 0.5)
