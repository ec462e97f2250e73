"""Documents to packed training sequences: toxicity, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Stages are written to the shared folder between each other, as a scheduler would.

Defined results: a null text counts as empty, which is never toxic by more than the model's bias, alike only to other
empty texts, and one piece of one id; rows that repeat are near-duplicates, of which one stays; rows with a null id stay
unless their text has a copy; an empty table gives an empty one; texts of any length are taken whole; further columns,
whatever their names, go through all stages but the last. ``PII_KEY`` in the environment is the pseudonyms' key.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import packing, pii, probminhash, toxicity
from palimpsest.llm.queries import KEY, table, vocabulary
from palimpsest.llm.shared import spool


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores under one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(F.col("text")) < 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return probminhash.deduplicate(docs)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced; n_chars follows the text."""
    out = pii.pseudonymize(docs, os.environ.get("PII_KEY", KEY))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its sequence and its place there."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("pii", with_pseudonyms),
    ("packing", packed),
]

#: Three of the stages have no SQL form; tests/llm holds the whole run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, f"stage-{name}")
    return docs
