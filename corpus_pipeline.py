"""From raw documents to packed sequences: five stages over Parquet.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written to the shared folder as Parquet and read again as the next one's docs.  All
but the last return the columns of documents.

Defined results.  Documents with null, empty or blank texts go in the first stage.  Documents of null doc_id aren't compared
with others; they are kept, mixed (first in their source) and packed.  Repeated rows are rejected or kept one by one until near-dedup leaves one.  Null languages and
sources are the empty one to the quality rules and to mixing; language ID keeps documents without a declared language.  A text longer than a sequence
is cut, without loss.  Ties are broken as the stages' modules say.  Extra columns go through all stages but the last under any name.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, quality, simhash
from tessera.llm.common import mark, materialize, sweep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    return quality.filter_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose declared language isn't ruled out by their text."""
    return langid.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.filter_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, repeated where a source is asked for more than it has."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences, which are in the order of training by stretches."""
    return packing.pack_in_order(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Language scores sum over segmentations and near duplicates need bit sketches: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of what they write only the result stays."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, since, keep=docs)
    return docs
