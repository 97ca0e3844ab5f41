"""Thin queries over the operators: each reads its table, applies the operator, derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, langid, license_scan, ngram_join, packing, pii, quality, resample, secrets, url_rules, vector_join
from .oracles import ORACLES  # noqa: F401


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_docs(spark, sf_dir))


def _spans(got: DataFrame, base: tuple[str, ...]) -> DataFrame:
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in base]
    return got.select("doc_id", *counts, F.sha2(_digest(_of("spans", *base)), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secrets.scan(_docs(spark, sf_dir), secrets.infer(secrets.labelled_credentials())), secrets.BASE)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = langid.held_out()
    model = langid.train(docs.where(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    got = license_scan.scan(docs, license_scan.document_frequency(docs))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return got.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "blocks.label")).alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )


def op7_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(pii.scan(_docs(spark, sf_dir)), pii.BASE)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    got = quality.assess(docs, quality.references(docs))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_class", "js_common")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_docs(spark, sf_dir))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(_docs(spark, sf_dir), _benchmark(spark, sf_dir))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word"])
    return got.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_docs(spark, sf_dir), _benchmark(spark, sf_dir)).select("doc_id", "n_features", "weight", "score", "rank")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_vector_near_dup": op5_vector_near_dup,
    "op6_license_scan": op6_license_scan,
    "op7_pii_scan": op7_pii_scan,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_phrase_collocations": op13_phrase_collocations,
    "pipeline": pipeline,
}
