"""Removal rules over file trees as one table of patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_pattern
from ..shared import cut
from .pins import PYTHON
from .record import prune_records
from .rule_tables import apply_table, as_table

# Parts of the standard library that are never imported.
UNUSED = ["test", "tkinter", "idlelib", "ensurepip", "lib2to3", "turtledemo", "pydoc_data", "unittest/test", "ctypes/test", "sqlite3/test", "distutils/tests", "site-packages"]
# What goes on each platform, as globs from the root.
WINDOWS_TRIM = ["include", "libs", "Scripts", "tcl", "pythonw.exe", "DLLs/_tkinter.pyd", "DLLs/tcl*.dll", "DLLs/tk*.dll", "DLLs/_test*.pyd", "DLLs/_ctypes_test.pyd", "**/*.pdb"]
MAC_TRIM = [
    "include", "share", "lib/pkgconfig", f"lib/python{PYTHON}/config-{PYTHON}-darwin", "lib/tcl[89]*", "lib/tk[89]*", "lib/itcl*", "lib/thread*", "lib/libtcl*", "lib/libtk*",
    f"lib/libpython{PYTHON}.dylib", f"lib/python{PYTHON}/lib-dynload/_test*", f"lib/python{PYTHON}/lib-dynload/_ctypes_test*", f"lib/python{PYTHON}/lib-dynload/_tkinter*",
]
# What installers and builds leave in the folder of packages; '<site>' stands for it.
CLEAN_FILES = ["<site>/*.exp", "<site>/*.whl", "<site>/.lock", "<site>/**/*.lib", "<site>/kenlm.dll", "<site>/libkenlm.dylib", "<site>/*.dist-info/direct_url.json", "<site>/*.dist-info/uv_cache.json", "<site>/*.dist-info/REQUESTED"]
CLEAN_TREES = ["<site>/numpy/**/tests", "<site>/bin", "**/__pycache__"]


@dataclass(frozen=True)
class Rule:
    """Removes what matches glob, with all beneath it if tree; keep turns it round: in that folder only matches stay."""

    glob: str
    tree: bool = True
    keep: str = ""

    def removes(self, path: Column, is_dir: Column | None = None) -> Column:
        if self.keep:
            return path.startswith(self.keep + "/") & ~path.rlike(glob_pattern(f"{self.keep}/{self.glob}"))
        pattern = glob_pattern(self.glob)
        if self.tree:
            return path.rlike(pattern[:-1] + "(?:/.*)?$")
        return path.rlike(pattern) if is_dir is None else path.rlike(pattern) & ~is_dir


def trim_rules(target: str) -> list[Rule]:
    """What a runtime of the target does not need."""
    windows = target.endswith("windows-msvc")
    library = "Lib" if windows else f"lib/python{PYTHON}"
    rules = [Rule(f"{library}/{x}") for x in UNUSED] + [Rule(x) for x in (WINDOWS_TRIM if windows else MAC_TRIM)]
    return rules if windows else [*rules, Rule(f"python{PYTHON}", keep="bin")]


def clean_rules(site: str) -> list[Rule]:
    """What installing leaves behind in the folder of packages, and caches anywhere."""
    at = lambda x: x.replace("<site>", site)
    return [Rule(at(x), tree=False) for x in CLEAN_FILES] + [Rule(at(x)) for x in CLEAN_TREES]


def apply_rules(tree: DataFrame, rules: list[Rule], path: str = "path") -> DataFrame:
    """tree without the rows that a rule removes: one filter of constant patterns, no join; for a handful of rules.
    Larger sets are tables, see rule_tables.

    Rules for files leave folders alone where the tree tells them apart (is_dir).
    """
    is_dir = F.col("is_dir") if "is_dir" in tree.columns else None
    gone = F.lit(False)
    for rule in rules:
        gone = gone | rule.removes(F.col(path), is_dir)
    return tree.where(~gone)


def trim(tree: DataFrame, target: str, site: str) -> DataFrame:
    """A runtime's tree (path, is_dir, ...) without what the target does not need, and with an empty folder for packages."""
    left = apply_table(tree, as_table(tree.sparkSession, trim_rules(target)))
    folder = tree.sparkSession.range(1).select(*(F.lit(site).alias(c) if c == "path" else F.lit(True).alias(c) if c == "is_dir" else F.lit(0o755).cast(k).alias(c) if c == "mode" else F.lit(None).cast(k).alias(c) for c, k in tree.dtypes))
    return left.unionByName(folder)


def clean(tree: DataFrame, site: str) -> DataFrame:
    """A runtime's tree (path, is_dir, content, ...) without what installing leaves, its records pruned; doing it twice changes nothing."""
    left = cut(apply_table(tree, as_table(tree.sparkSession, clean_rules(site))))  # read three times below
    return prune_records(left, site)
