"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardfile.llm import decontaminate, pack, pii, quality, simhash
from cardfile.sources.store import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels outside the held-out fifth.

    Null, empty and very long texts are scored like any, repeated rows each; no rows give none.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Texts without words are one group; rows with a null id stay; of rows that repeat the smallest id all stay.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth occurs in benchmark items.

    Null and empty texts stay; repeated rows are judged each; without items all stay.
    """
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it replaced; n_chars follows the text.

    Null texts stay null with their n_chars; repeated rows are rewritten alike; no rows give none.
    """
    own = pii.sanitise(docs)
    return own.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 256 to 2048 tokens, with their ids.

    A null text is packed as an empty one; very long texts are cut into windows; repeated rows are packed each.
    """
    return pack.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokenizer; tests/llm/test_pipeline.py holds each stage against its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
