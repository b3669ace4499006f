"""The corpus pipeline: five stages, each a table of documents to a table of documents.

toxicity (rejected documents go), near duplicates (one document of each class stays),
benchmark decontamination (contaminated documents go), personal data (replaced by its
kind in the text), BPE (adds the ids). All stages but the last return the columns of
``documents``. Each stage decides on rows, not on ids: a repeated or null ``doc_id`` is no
reason for a row to stay or go with another.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import chunkreuse, ngramjoin, posindex, skipchain, toxicity
from kinfold.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model does not predict as toxic.

    Null and empty texts are scored as texts without hits; equal texts are decided alike; a
    score of one half is toxic; an empty table stays empty; other columns are kept.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: five words, a similarity of 0.8.

    The row with the smallest id stays (a null id counts as larger than any), of rows with
    that id the first in the files. Null, empty and blank texts are duplicates of nothing
    and all stay; an empty table stays empty; other columns are kept.
    """
    return ngramjoin.keep_first(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which under a twentieth of the words stand in windows of benchmark items.

    Texts without words stay; equal texts are decided alike; an empty benchmark or table
    changes nothing; other columns are kept.
    """
    return posindex.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced, and ``n_chars`` counted again where there is such a column.

    A null text stays null; its ``n_chars`` is null too. Other columns are kept.
    """
    masked = skipchain.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of its text, for every row; null and empty texts have none."""
    return chunkreuse.encode_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", encode_text),
]

#: The learned stages cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            discard(before)
    return docs
