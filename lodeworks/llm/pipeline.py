"""A corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, whatever these are besides doc_id, text,
lang, source and n_chars. A stage handles rows, not ids: doc_ids may be null or repeated.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, lines, mixing, packing, quality
from .common import WORD, drop, noted, shared_folder, table


def __getattr__(name: str) -> str:
    """TOKENIZER, the file of the tokenizer that packing counts tokens with; looked for when it is asked for."""
    if name != "TOKENIZER":
        raise AttributeError(name)
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the stage called last has cut; its result is written by the time the next one is called.
_LEFT: list[str] = []


def _stage(build):
    """A stage that first drops the tables that the stage before it left in the shared folder, and no others."""

    @functools.wraps(build)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _LEFT)
        _LEFT.clear()
        with noted() as paths:
            out = build(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out

    stage.build = build
    return stage


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars brought up to date, if it is among its columns."""
    return (docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs).select(*(F.col(f"`{c}`") for c in columns))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (quality.judge), as they are.

    Each row is judged by its own text and language, so equal rows stay or go together. Null, empty and short
    texts go; a null lang is a language of its own; an empty table gives none.
    """
    return quality.judge(docs, full=True).where("kept").select("row.*")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat an earlier one (lines.clean); those left without words go.

    Earlier is by doc_id (null first), then line; rows of one doc_id and different texts come in the order of the
    texts' hashes, and equal rows are one document and stay equal. Null and empty texts have no lines to lose and stay as
    they are; an empty table gives none.
    """
    return _counted(lines.clean(docs), docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word 5-grams at Jaccard similarity 0.8, one: that of the smallest doc_id.

    Null doc_ids come last; of rows with one doc_id that of the least hash stays, and of equal rows any one. Texts
    without words link with nothing: their rows stay. An empty table gives none.
    """
    rows = jaccard.joined(docs, n=5, num=8, den=10, passes=4).where("group is not null")
    rows = rows.groupBy("group", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("times"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "times")).alias("f"))
    first = first.select(F.col("f.k1").alias("_lw_k1"), F.col("f.k2").alias("_lw_k2"), F.col("f.times").alias("_lw_times"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(*names, *(k.alias(f"_lw_own{i}") for i, k in enumerate(jaccard.row_keys(F.col("text"))))).join(first, (F.col("_lw_own0") == F.col("_lw_k1")) & (F.col("_lw_own1") == F.col("_lw_k2")))
    once = kept.where("_lw_times = 1").select(*names)
    twice = kept.where("_lw_times > 1").dropDuplicates(["_lw_own0", "_lw_own1"]).select(*names)
    return once.union(twice).union(docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (mixing.mix); the last, unfinished copy ends after its last word taken.

    Each row is taken by itself, so repeated rows and doc_ids take what falls to each. Texts without words are not
    taken; a null source is a source of its own; an empty table gives none.
    """
    taken = mixing.mix(docs, full=True).where("taken > 0").select("row.*", F.col("copies").alias("_lw_copies"), F.col("part").alias("_lw_part"))
    copies = taken.withColumn("_lw_copy", F.explode(F.sequence(F.lit(1), (F.col("_lw_copies") + (F.col("_lw_part") > 0).cast("long")).cast("int"))))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))  # each with the white space before it
    cut_off = F.array_join(F.slice(words, 1, F.col("_lw_part").cast("int")), "")
    return _counted(copies.withColumn("text", F.when(F.col("_lw_copy") > F.col("_lw_copies"), cut_off).otherwise(F.col("text"))), docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens (packing.pack); a null text counts as empty, an empty table gives none."""
    return packing.pack(docs, __getattr__("TOKENIZER"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Packing by a tokenizer can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other. What a stage cut and read goes as soon as its result is written;
    the last stage's input stays in the shared folder, since the result returned reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        with noted() as paths:
            stage.build(spark, docs, sf_dir).write.parquet(path)
        drop(spark, paths + before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1].build(spark, docs, sf_dir)
