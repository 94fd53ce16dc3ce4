"""Quality classifier: a factorisation machine over hashed words, statistics of a text's structure, and metadata.

Interactions between, say, a share of bars and a share of repeated words are learned from the labels; a text is scored
in time linear in its features by the identity of the sum of squares. ``n_chars`` is the only metadata; ids, languages,
sources and labels are not read.

Defined results: null and empty texts are scored from their structure; texts of any length are read whole; equal texts
with equal metadata have equal scores; null metadata is a value of its own, as is a missing column; without labelled
rows every score is 0.5; a null id stays null; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import factorisation as fm
from .toxicity import training_labels, with_decision

#: ``sample`` bounds the labelled rows that training reads.
SPEC = fm.Spec(structure=True, metadata=("n_chars",), sample=8000)
FOLDS, HELD_OUT = 3, 1


def train(docs: DataFrame, labels: DataFrame, spec: fm.Spec = SPEC) -> fm.Model:
    return fm.train(docs, training_labels(labels, "quality", FOLDS, HELD_OUT), spec)


def score(docs: DataFrame, labels: DataFrame, spec: fm.Spec = SPEC) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    return with_decision(fm.score_documents(docs, train(docs, labels, spec)), FOLDS, HELD_OUT)
