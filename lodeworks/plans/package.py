"""The packaging job: from pins to a checked, archived runtime. Compiling, installing and trying it out are passed in."""

from __future__ import annotations

import argparse
import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import name
from ..operators import native, pins, rules, sequences, sets
from ..sources.fetch import Fetcher
from ..sources.pins import read_pins
from ..sources.trees import copied, read_tar, read_tree, write_tree
from . import dependencies, sinks

COLUMNS = ["path", "is_dir", "mode", "content", "link"]


def no_step(*_: object) -> None:
    """A step that is left out."""


@dataclass
class Job:
    """Arguments of a job. Steps that need programs beyond this library are functions:

    install(folder, requirements file) puts packages into a folder; commands(native paths) lists load commands as
    (path, line_no, line); check(runtime folder) tries the runtime out and raises if it fails.
    """

    pins: str
    output: str
    work: str
    system: str = ""
    machine: str = ""
    library: str = "native"
    name: str = "runtime"
    versions: dict[str, str] = field(default_factory=lambda: {"python": "python.version"})
    install: Callable[[str, str], None] = no_step
    commands: Callable[[DataFrame], DataFrame] | None = None
    check: Callable[[str], None] = no_step
    fetcher: Fetcher = field(default_factory=Fetcher)
    notices: Callable[[DataFrame, str], str] | None = None


def licence_files(source: DataFrame, root: str, verbatim: dict[str, str], comment: dict[str, str], passage: dict[str, str]) -> DataFrame:
    """(name, content) of licence texts in a source archive: members as they are, the first block comment of a member,
    and the passage of line comments of another; the latter two end in one newline. Keys are names, values members."""
    names = [(title, f"{root}/{at}", kind) for kind, held in (("whole", verbatim), ("comment", comment), ("passage", passage)) for title, at in held.items()]
    wanted = source.sparkSession.createDataFrame(names, "name string, at string, kind string")
    found = source.where(F.col("path").isin(sorted({at for _, at, _ in names}))).select("path", "content")  # one scan for all
    held = wanted.join(found, F.col("at") == F.col("path"), "left").groupBy("name", "at", "kind").agg(F.count("path").alias("n"), F.min("content").alias("content"))
    text = F.col("content").cast("string")
    made = lambda body: F.concat(body, F.lit("\n")).cast("binary")
    body = F.when(F.col("kind") == "comment", made(sequences.block_comment(text))).when(F.col("kind") == "passage", made(sequences.comment_block(text))).otherwise(F.col("content"))
    error = F.raise_error(F.concat(F.lit("one "), F.col("at"), F.lit(" expected, found "), F.col("n").cast("string")))
    return held.select("name", F.when(F.col("n") == 1, body).otherwise(error.cast("binary")).alias("content"))


def built(tree: DataFrame, pattern: Column) -> DataFrame:
    """The one file of a build whose name matches; none or several are an error."""
    return sets.only(tree.where(~F.col("is_dir") & pattern).select("path"), "path", "built file")


def package(spark: SparkSession, job: Job) -> str:
    """Fetches, unpacks, trims, installs, cleans, describes, checks and archives; returns the archive's path."""
    document = read_pins(spark, job.pins, native=job.library).cache()
    system, machine = pins.host(job.system, job.machine)
    target = spark.range(1).select(pins.host_target(F.lit(system), F.lit(machine))).first()[0]
    paths = spark.range(1).select(pins.layout(F.lit(target)).alias("l")).first()["l"]
    for folder in (job.work, job.output):
        os.makedirs(folder, exist_ok=True)
    pin = pins.python_pin(document, target).first()
    archive = job.fetcher.fetch(pin["url"], os.path.join(job.work, f"python-{target}.tar.gz"), pin["sha256"], pin["bytes"])

    runtime = os.path.join(job.work, "runtime")
    shutil.rmtree(runtime, ignore_errors=True)
    write_tree(rules.trim(copied(read_tar(spark, archive), "", "python").select(*COLUMNS), target, paths["site"]), runtime)

    lines = os.path.join(job.work, "requirements.txt")
    sinks.write_lines((r.line for r in pins.requirements(document, target).collect()), lines)  # one per package
    job.install(os.path.join(runtime, paths["site"]), lines)
    cleaned(spark, runtime, paths["site"])
    model = document.select("model.*").first().asDict()
    os.makedirs(os.path.join(runtime, "model"))
    job.fetcher.fetch_packed(model, job.work, os.path.join(runtime, "model", model["name"]))
    if job.notices:
        os.makedirs(os.path.join(runtime, "notices"))
        with open(os.path.join(runtime, "notices", "NOTICE.md"), "w", newline="\n") as f:
            f.write(job.notices(document, target))
    with open(os.path.join(runtime, "manifest.json"), "w", newline="\n") as f:
        f.write(sinks.manifest(document, target, job.versions))
    job.check(runtime)
    cleaned(spark, runtime, paths["site"])
    native.gate(problems(spark, runtime, target, job.commands))

    out = os.path.join(job.output, f"{job.name}-{target}.zip")
    sinks.write_zip(read_tree(spark, runtime, content=True), out)
    sinks.write_checksum(out)
    return out


def cleaned(spark: SparkSession, runtime: str, site: str) -> None:
    """Cleans a runtime on disk: what the rules remove goes, and the records that change are written again."""
    before = read_tree(spark, runtime, content=True).select("path", "is_dir", "mode", "content", F.lit(None).cast("string").alias("link"))
    after = rules.clean(before, site)
    changed = after.where(name(F.col("path")) == "RECORD").select("path", "content").collect()  # one per package
    gone = before.select("path", "is_dir").join(after.select("path"), "path", "left_anti").orderBy(F.length("path")).collect()  # what installers leave
    for r in gone:
        at = os.path.join(runtime, r.path)
        if os.path.isdir(at) and not os.path.islink(at):
            shutil.rmtree(at)
        elif os.path.lexists(at):
            os.unlink(at)
    for r in changed:
        with open(os.path.join(runtime, r.path), "wb") as f:
            f.write(bytes(r.content))


def problems(spark: SparkSession, runtime: str, target: str, commands: Callable | None) -> DataFrame:
    """(path, missing) of a runtime by its target."""
    if target.endswith("windows-msvc"):
        return dependencies.windows_problems(spark, runtime)
    if commands is None:
        raise ValueError("a macOS runtime needs a function that lists load commands")
    return dependencies.mac_problems(spark, runtime, commands(dependencies.mac_natives(spark, runtime)))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """The job's command line: --pins, --output, --work, --system, --machine."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--pins", required=True)
    parser.add_argument("--output", default="artifacts")
    parser.add_argument("--work", default="work")
    parser.add_argument("--system", default="")
    parser.add_argument("--machine", default="")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    print(package(spark, Job(a.pins, os.path.abspath(a.output), os.path.abspath(a.work), a.system, a.machine)))


if __name__ == "__main__":
    main()
