"""Five stages from documents to training sequences, each one operator of ``vektra.llm``.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``docs``. Classifiers learn from the labelled documents
in ``sf_dir``, never from held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektra.llm import packing, pii, quality, simhash, toxicity
from vektra.llm.shared import cut, table, unused

#: The key of the pseudonyms; a real run passes its own.
KEY = "vektra"
LEAST_QUALITY, MOST_TOXIC = 0.7, 0.3
#: Words of a shingle and the similarity, as a fraction, from which documents are near copies.
WIDTH, NEAR = 5, (4, 5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, threshold=LEAST_QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, threshold=MOST_TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word similarities of 0.8 or more connect."""
    return simhash.survivors(docs, width=WIDTH, near=NEAR)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; n_chars follows the text."""
    (found,) = unused(docs, "_found")
    hidden = pii.pseudonymise(docs, KEY, found_col=found)
    length = F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return hidden.withColumn("n_chars", length).drop(found)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack_tokens),
]

#: Trained classifiers, a tokenizer and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut in the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
