"""Targets, layouts, requirement lines and the invariants of the pins document."""

from __future__ import annotations

import platform

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import present
from ..sources.pins import model_urls, package_pins, python_pins

# The targets, and the interpreter's version as it stands in paths.
WINDOWS, MAC_ARM, MAC_INTEL = "x86_64-pc-windows-msvc", "aarch64-apple-darwin", "x86_64-apple-darwin"
TARGETS = [WINDOWS, MAC_ARM, MAC_INTEL]
PYTHON = "3.12"

DIGEST = "^[0-9a-f]{64}$"


def host_target(system: Column, machine: Column, strict: bool = True) -> Column:
    """Target of a host: system is case-sensitive, machine is not; others are errors, or null where not strict."""
    m = F.lower(machine)
    out = F.when((system == "Windows") & m.isin("amd64", "x86_64"), WINDOWS).when((system == "Darwin") & m.isin("arm64", "aarch64"), MAC_ARM).when((system == "Darwin") & (m == "x86_64"), MAC_INTEL)
    if strict:
        out = out.otherwise(F.raise_error(F.format_string("No runtime for %s %s", system, machine)))
    return out


def host(system: str | None = None, machine: str | None = None) -> tuple[str, str]:
    """System and machine of this computer; given ones come first, '' counts as not given."""
    return system or platform.system(), machine or platform.machine()


def venv_python(target: Column) -> Column:
    """Where the interpreter stands in a virtual environment."""
    return F.when(target.endswith("windows-msvc"), F.lit("Scripts/python.exe")).otherwise(F.lit("bin/python"))


def layout(target: Column) -> Column:
    """struct(python, stdlib, site): paths by target; whatever is not Windows counts as macOS."""
    at = lambda *paths: F.struct(*(F.lit(p).alias(n) for p, n in zip(paths, ("python", "stdlib", "site"), strict=True)))
    lib = f"lib/python{PYTHON}"
    return F.when(target.endswith("windows-msvc"), at("python.exe", "Lib", "Lib/site-packages")).otherwise(at(f"bin/python{PYTHON}", lib, f"{lib}/site-packages"))


def lookup(rows: DataFrame, keyed: DataFrame, on: str, key: Column, fallback: Column, value: str, out: str) -> DataFrame:
    """rows with `out`: keyed's value for (on, key), else for (on, fallback); '' counts as missing.

    keyed: (on, 'key', value) with one row per (on, key). Two left joins, which Spark broadcasts by size.
    """
    exact = keyed.select(F.col(on).alias("_on1"), F.col("key").alias("_key1"), present(F.col(value)).alias("_v1"))
    other = keyed.select(F.col(on).alias("_on2"), F.col("key").alias("_key2"), present(F.col(value)).alias("_v2"))
    both = rows.join(exact, (F.col(on) == F.col("_on1")) & (key == F.col("_key1")), "left").join(other, (F.col(on) == F.col("_on2")) & (fallback == F.col("_key2")), "left")
    return both.withColumn(out, F.coalesce("_v1", "_v2")).drop("_on1", "_key1", "_v1", "_on2", "_key2", "_v2")


def requirement_rows(digests: DataFrame, target: str) -> DataFrame:
    """(name, line) of every package of a table (name, version, key, digest), a row for each digest, in any order: the
    target's digest or that for any target, '' counting as missing; a package without either is an error. One partial aggregation."""
    of = lambda key: F.max(F.when(F.col("key") == key, present(F.col("digest"))))
    held = digests.groupBy("name", "version").agg(F.coalesce(of(target), of("any")).alias("digest"))
    sure = F.coalesce("digest", F.raise_error(F.concat(F.lit("No pinned "), "name", F.lit(f" for {target}"))).cast("string"))
    return held.select("name", F.concat("name", F.lit("=="), "version", F.lit(" --hash=sha256:"), sure).alias("line"))


def requirements(pins: DataFrame, target: str) -> DataFrame:
    """(name, line) of every package of a pins document for a target, sorted by name."""
    packages = pins.select(F.explode("packages").alias("name", "p")).select("name", "p.version", F.explode_outer("p.sha256").alias("key", "digest"))
    return requirement_rows(packages, target).orderBy("name")


def python_pin(pins: DataFrame, target: str) -> DataFrame:
    """The interpreter's pin of one target; a target that is not pinned is an error."""
    found = F.try_element_at("python.targets", F.lit(target))
    return pins.select(F.when(found.isNull(), F.raise_error(F.lit(f"{target} is not pinned"))).otherwise(found).alias("f")).select("f.*")


def alphabet_check(text: Column) -> Column:
    """Whether all characters differ and one is a space."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return (F.size(letters) == F.size(F.array_distinct(letters))) & F.array_contains(letters, " ")


def violations(pins: DataFrame, mirror: str, packages: list[str]) -> DataFrame:
    """(rule, subject): each broken invariant of a pins document; mirror is how the first model URL starts."""
    files = python_pins(pins).crossJoin(F.broadcast(pins.select("python.release", "python.version")))  # one row each
    escaped = F.concat(F.lit("cpython-"), "version", F.lit("%2B"))
    rule = lambda rows, number, ok, subject: rows.where(~F.coalesce(ok, F.lit(False))).select(F.lit(number).alias("rule"), subject.cast("string").alias("subject"))
    keys = F.array_sort(F.map_keys("python.targets"))
    urls = model_urls(pins).crossJoin(F.broadcast(pins.select("model.url", F.size("model.download_urls").alias("n")).withColumnRenamed("url", "own")))
    out = [
        rule(pins, "I1", keys == F.array_sort(F.array(*map(F.lit, TARGETS))), F.array_join(keys, ",")),
        rule(files, "I2", F.contains("url", "target") & F.contains("url", "release") & F.contains("url", escaped), F.col("target")),
        rule(files, "I3", F.col("sha256").rlike(DIGEST), F.col("target")),
        rule(package_pins(pins), "I3", F.col("digest").rlike(DIGEST), F.concat_ws(":", "name", "key")),
        rule(pins, "I4", F.array_sort(F.map_keys("packages")) == F.array_sort(F.array(*map(F.lit, packages))), F.array_join(F.map_keys("packages"), ",")),
        rule(pins.select(F.explode("build_tools").alias("tool")), "I5", F.col("tool").rlike(r"^[a-z]+==[0-9.]+( --hash=sha256:[0-9a-f]{64})+$"), F.col("tool")),
        rule(pins, "I6", F.col("native.max_order") == 12, F.col("native.max_order")),
        rule(urls, "I7", F.when(F.col("rank") == F.col("n") - 1, F.col("url") == F.col("own")).when(F.col("rank") == 0, F.col("url").startswith(mirror)).otherwise(F.lit(True)), F.col("url")),
        rule(pins, "I8", alphabet_check(F.col("model.alphabet")), F.col("model.alphabet")),
        rule(pins, "I10", F.substring_index("python.version", ".", 2) == PYTHON, F.col("python.version")),
    ]
    for digest in ("native.sha256", "model.sha256", "model.gzip_sha256"):
        out.append(rule(pins, "I3", F.col(digest).rlike(DIGEST), F.lit(digest)))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole
