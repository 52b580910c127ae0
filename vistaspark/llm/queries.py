"""The corpus operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistaspark.llm import anisotropic, chaining, content_sort, filter_audit, kd_shards, mixing, packing, page_text, partenum, resampling, suffix_levels, token_cache, toxicity
from vistaspark.llm.common import documents, scratch_path


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(documents(spark, sf_dir), leaves=24)


def op2_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(documents(spark, sf_dir))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own that starts empty, so every distinct content is encoded."""
    return token_cache.cached_counts(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")).drop("ids")


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return anisotropic.nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir))


def op11_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.repeats_removed(documents(spark, sf_dir))


def op12_lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_partenum": op2_partenum,
    "op3_page_differencing": op3_page_differencing,
    "op4_chaining": op4_chaining,
    "op5_token_cache": op5_token_cache,
    "op6_content_sort": op6_content_sort,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_toxicity": op8_toxicity,
    "op9_anisotropic": op9_anisotropic,
    "op10_mixing": op10_mixing,
    "op11_suffix_levels": op11_suffix_levels,
    "op12_lattice_edges": op12_lattice_edges,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op6_content_sort": content_sort.SQL,
    "op10_mixing": mixing.SQL,
    "op12_lattice_edges": filter_audit.SQL,
    "op13_importance_resampling": resampling.SQL,
}
