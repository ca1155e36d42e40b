"""One registered query for each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import read
from .contamination import contaminated
from .drake import fixed_point, drake_means
from .filter_audit import filter_audit
from .imatch import edited_likeness
from .license_index import base_places, license_scan
from .linedup import dedup_lines
from .mixing import mix
from .ngram_join import ngram_jaccard_components
from .pii_bootstrap import personal_data, written
from .preference import preference_format
from .pseudo_lm import pseudo_likelihood
from .quality_fm import quality_scores
from .toxicity_crf import toxicity_scores


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    written = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", written.alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", F.col("lines_gone").cast("long").alias("lines_gone"), "text_kept", "emptied")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read(spark, sf_dir, "documents"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format(read(spark, sf_dir, "conversations"), foreign=True)


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read(spark, sf_dir, "documents"))


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    starts = F.transform(base_places(F.col("places")), lambda p: p["start"])
    named = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base_places(F.col("places"))).alias("base_labels"), named(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_drake_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = fixed_point(read(spark, sf_dir, "embeddings"), width=64, scale=64)
    found = drake_means(vectors, clusters=16, rounds=3)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
