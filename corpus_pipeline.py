"""Corpus pipeline: documents through language ID, line dedup, near-dedup, decontamination and source mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; what it decides takes effect in the
rows (and texts) it returns, which have the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tieline.llm import decontaminate, language, mixing, near_duplicates, site_lines
from tieline.session import shared_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is close enough to a language learned from the labelled rows; others go."""
    profiles = language.train_profiles(language.training_rows(docs))
    return language.keep_languages(docs, profiles, least=0.05)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; documents of which no word is left go."""
    return site_lines.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    return near_duplicates.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage of ten words (nor a whole shorter item) with the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half of the tokens whose sources, languages and kinds of text follow the target shares."""
    return mixing.mix_sources(docs).where("sampled").select(*[f"`{c}`" for c in docs.columns])


STAGES = [("language", known_language), ("lines", line_dedup), ("near_duplicates", near_dedup), ("benchmark", decontamination), ("mix", source_mix)]

#: Hyperdimensional profiles and winnowing with extension have no SQL form; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another; each result is written to the shared folder and read again as the next input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
