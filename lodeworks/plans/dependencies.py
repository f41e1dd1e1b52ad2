"""The dependency gate over a tree on disk, from scan to problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.native import is_mac_native, is_windows_native, missing_mac, missing_windows, pe_imports
from ..operators.sequences import load_commands
from ..sources.trees import contents, read_tree


def windows_problems(spark: SparkSession, root: str) -> DataFrame:
    """(path, missing) of a Windows tree; contents are read for native files alone, one at a time."""
    files = read_tree(spark, root).where(~F.col("is_dir"))
    decoded = pe_imports(contents(files.where(is_windows_native(F.col("suffix"))), root))
    bad = decoded.where("error is not null").select("path", F.array("error").alias("missing"))
    return missing_windows(files, decoded.where("dll is not null").select("path", "dll")).union(bad)


def mac_natives(spark: SparkSession, root: str) -> DataFrame:
    """(path) of a macOS tree's native files, by the first four bytes of every file."""
    files = read_tree(spark, root).where(F.col("inside") & ~F.col("is_dir"))
    return contents(files, root, head=4).where(is_mac_native(F.col("content"))).select("path")


def mac_problems(spark: SparkSession, root: str, commands: DataFrame) -> DataFrame:
    """(path, missing) of a macOS tree; commands: (path, line_no, line), the load-command listing of its native files.

    Libraries may be reached through linked folders, as long as they lie in the tree.
    """
    return missing_mac(read_tree(spark, root, follow=True), load_commands(commands.join(mac_natives(spark, root), "path", "left_semi")))
