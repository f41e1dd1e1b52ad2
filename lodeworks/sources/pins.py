"""The pins document: one nested JSON object that names every input with its size and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema(native: str) -> str:
    file = "struct<url:string,bytes:bigint,sha256:string>"
    return (
        f"format_version bigint, python struct<version:string,release:string,targets:map<string,{file}>>,"
        f"packages map<string,struct<version:string,sha256:map<string,string>>>, `{native}` struct<version:string,url:string,sha256:string,max_order:bigint>,"
        "build_tools array<string>, model struct<name:string,url:string,download_urls:array<string>,gzip_bytes:bigint,gzip_sha256:string,bytes:bigint,sha256:string,alphabet:string,source:string,permission:string>"
    )


def read_pins(spark: SparkSession, path: str, native: str = "native") -> DataFrame:
    """One row; native names the object of the library that is built from source, which comes back as `native`."""
    out = spark.read.schema(schema(native)).option("multiLine", True).json(path)
    return out.withColumnRenamed(native, "native")


def python_pins(pins: DataFrame) -> DataFrame:
    """(target, url, bytes, sha256), one row per target."""
    return pins.select(F.explode("python.targets").alias("target", "f")).select("target", "f.*")


def package_pins(pins: DataFrame) -> DataFrame:
    """(name, version, key, digest), one row per package and key (a target or 'any')."""
    return pins.select(F.explode("packages").alias("name", "p")).select("name", "p.version", F.explode("p.sha256").alias("key", "digest"))


def model_urls(pins: DataFrame) -> DataFrame:
    """(rank, url) in the order in which sources are tried."""
    return pins.select(F.posexplode("model.download_urls").alias("rank", "url"))
