"""Registered queries of the text operators: thin steps from the given tables to an operator and its results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.llm import bloom_lm, decontaminate, fill_middle, label_pieces, language, mixing, near_duplicates, site_lines, site_quality, url_filter, warc, whiten
from tieline.llm.oracles import mix_sql, quality_score_sql, site_lines_sql
from tieline.session import shared_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.train_profiles(language.training_rows(docs))
    out = language.identify_language(docs, profiles, ["doc_id"])
    return out.withColumn("held_out", language.is_held_out(F.col("doc_id"), 4, 2))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = language.is_held_out(F.col("doc_id"), 10, 0)
    model = bloom_lm.train_model(docs.where(~held_out))
    out = bloom_lm.score_texts(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, share=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "n_tokens", "topic", "probability", "sampled")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.quality_rules(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", *[F.round(c, 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "score")], "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("xml"))
    made = fill_middle.fill_in_middle(fill_middle.store_frames(docs))
    out = fill_middle.restore_labels(made, ["path", "n", "form", "prefix_units", "middle_units", "output_sha256"])
    return out.select(F.col("path").cast("bigint").alias("doc_id"), "n", "form", F.col("prefix_units").alias("prefix_chars"),
                      F.col("middle_units").alias("middle_chars"), "output_sha256", "restored_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("spectrum"))
    return whiten.whiten_spectra(cube, whiten.fit_whitening(cube), ["vec_id"])


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """model: path of a model file; without it the public tokenizers' 32k BPE model."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    labels = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("xml"))
    return label_pieces.encode_and_decode(labels, label_pieces.load_model(model)).withColumnRenamed("path", "doc_id")


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_language_id, op3_line_dedup, op4_lm_scoring, op5_near_duplicates, op6_decontamination,
                            op7_mixing, op8_quality_rules, op9_warc, op10_quality_classifier, op11_fill_in_middle, op12_whitening, op13_sentencepiece)}

LLM_ORACLES: dict[str, str] = {"op3_line_dedup": site_lines_sql(), "op7_mixing": mix_sql(), "op10_quality_classifier": quality_score_sql()}
