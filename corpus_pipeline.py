"""The corpus pipeline: documents in, tokenized clean documents out.

Each stage works on all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurewatch.llm import bpe, decontaminate, langid, pii, simhash
from lurewatch.llm.common import documents
from lurewatch.session import shared_folder, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# In every stage rows keep all their columns, also such with names the operators use, and
# repeated rows are treated alike. Texts are read whole, however long. An empty table
# gives an empty table.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the models know; those that are rejected go.

    Null, empty and letterless texts are rejected. Of languages that fit equally well
    the first in order counts. Without any labelled text to learn from all stay.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Null, empty and blank texts are alike and leave one. Of rows with the same id, and of
    those without one, the smallest hash of the text decides; rows without an id
    stay only where no row of the group has one. Repeated rows leave one.
    """
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by test items.

    Null, empty and wordless texts are clean. At exactly one word in twenty a document is
    contaminated. Without items all stay; repeated items count once.
    """
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; `n_chars` is that of the masked text.

    A null text stays null with its `n_chars`, an empty one stays empty. Spans that
    overlap become one, named by the one that begins first, of equal ones the shorter.
    """
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with the text that these decode to; null and empty texts have none."""
    return bpe.add_tokens(docs, bpe.public_path("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: Hashing, language models and merges cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents`."""
    docs = documents(ship_package(spark), sf_dir)
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
