"""Documents to tokens, in five stages over the table ``documents``.

Toxic documents go, one document of each group of near copies stays, documents with benchmark passages go, secrets are
blanked out, and the rest is encoded. Every stage works on all that the stage before it kept; all but the last return
the columns of ``documents``. Each is written to the shared folder and read again, so a lost executor, or a stage that is
run once more, never goes back to the beginning.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import byte_bpe, decontamination, jaccard_join, secret_scan, toxicity
from ledgerlight.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of ``sf_dir`` and drops what it takes for toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on shingles of five words, the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, n=5, num=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Items of fewer words than a window are left out: a word or two would condemn every text that holds them."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"), min_words=decontamination.WINDOW)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", blank_secrets),
    ("byte-level BPE", encode),
]

#: No SQL expresses a trained model, a component or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
