"""From raw documents to packed training sequences: quality rules, language ID, near-dedup, packing.

Quality rules drop what fails the rules of ``quality``; language ID keeps the texts of LANGUAGES, told by their n-grams;
near-dedup keeps one document of each group of texts whose sets of five-word shingles are 0.8 alike or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm import common, langid, packing, quality, similar


#: Languages wanted in the training data; None for all that are learned.
LANGUAGES = ("en",)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, LANGUAGES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: Near-dedup and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another; each writes its documents to the shared folder, where the next one reads them."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
