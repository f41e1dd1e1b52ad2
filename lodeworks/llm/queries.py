"""The subpackage's queries, each over its whole tables, and the SQL that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factors, html_text, jaccard, licenses, lines, mixing, packing, quality, quantiles, sharding, substrings, vectors, whitening
from .common import cut, table
from .oracles import ORACLES


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, part, parts, least = ["stream", "grp"], "batch", 10, 20
    rows = quantiles.streams(*(table(spark, sf_dir, t) for t in ("clicks", "sale_lines", "items")))
    counts, made = quantiles.summaries(rows, keys, part, quantiles.BATCHES, F.col("c"), error=0.05, most=400)
    found = cut(quantiles.answers(made.where(F.col("n") >= least), parts))
    out = quantiles.checked(counts, found, keys, part, parts, least)
    out = out.withColumn("rank_error", F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto")))
    return out.withColumn("within", 1000 * F.col("rank_error") <= 50 * F.col("n"))


def op12_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = factors.remove_repeats(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES = {"op1_mixing": op1_mixing, "op2_licenses": op2_licenses, "op3_quality": op3_quality, "op4_jaccard": op4_jaccard, "op5_vectors": op5_vectors, "op6_packing": op6_packing, "op7_sharding": op7_sharding, "op8_html_text": op8_html_text, "op9_lines": op9_lines, "op10_substrings": op10_substrings, "op11_quantiles": op11_quantiles, "op12_factors": op12_factors, "op13_whitening": op13_whitening}
__all__ = ["ORACLES", "QUERIES"]
