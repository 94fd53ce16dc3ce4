"""Toxicity: a factorisation machine over hashed terms.

Pairs of terms have a weight of their own, so an insult together with the mention of a group can count for more than
the sum of both. Terms are words and beginnings of words, and how often they occur counts. Only terms are features; ids, languages, sources and labels are not.

Defined results: null and empty texts are scored from the bias alone; texts of any length are read whole; equal texts
have equal scores; without labelled rows every score is 0.5; a null id stays null and is held out of nothing; an empty
table gives an empty one; further columns are not read by ``score`` and are handed on by ``drop``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import factorisation as fm

#: ``sample`` bounds the labelled rows that training reads.
SPEC = fm.Spec(beginnings=(4, 5, 6, 7), levels=3, sample=8000)
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string")) % folds


def training_labels(labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    return labels.where(fold("doc_id", folds) != held_out).select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


def train(docs: DataFrame, labels: DataFrame, spec: fm.Spec = SPEC) -> fm.Model:
    return fm.train(docs, training_labels(labels), spec)


def with_decision(scores: DataFrame, folds: int, held_out: int, threshold: float = THRESHOLD) -> DataFrame:
    return scores.select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def score(docs: DataFrame, labels: DataFrame, spec: fm.Spec = SPEC) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    return with_decision(fm.score_documents(docs, train(docs, labels, spec)), FOLDS, HELD_OUT)


def drop(docs: DataFrame, model: fm.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model doesn't take for toxic, with all their columns."""
    return fm.keep_below(docs, model, threshold)
