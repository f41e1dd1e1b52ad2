"""Queries of the artifact operators over the shared tables, and the SQL each is held against."""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import table_queries
from .functions import paths
from .functions.paths import components, lines, normalized, present, suffix, uint_le
from .operators import native, pins, record, rules, sequences, sets
from .plans import dependencies, package, sinks
from .shared import new_folder
from .sources import fetch, records, trees
from .sources.archives import local_path
from .sources.pins import read_pins


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see, in the shared one."""
    at = local_path(new_folder(spark))
    os.makedirs(at, exist_ok=True)
    return at


def _supplier_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files: nation 0's in the root, nation 1's in a folder of shared libraries, the others' by nation."""
    s = _t(spark, sf_dir, "supplier")
    parent = F.when(F.col("s_nationkey") == 0, "").when(F.col("s_nationkey") == 1, "pkg/one.libs").otherwise(F.concat(F.lit("pkg/"), F.col("s_nationkey").cast("string")))
    return s.select(parent.alias("parent"), F.col("s_name").alias("name"), F.concat(F.when(parent != "", F.concat(parent, F.lit("/"))).otherwise(""), "s_name").alias("path"))


def _nation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files with contents and modes, in folders by region whose names sort unlike their strings."""
    n = _t(spark, sf_dir, "nation")
    folder = F.when(F.col("n_regionkey") == 0, "a").when(F.col("n_regionkey") == 1, "a-b").when(F.col("n_regionkey") == 2, ".hidden").otherwise("_under/a")
    mode = F.when(F.col("n_nationkey") % 2 == 0, F.lit(0o700)).otherwise(F.lit(0o640))
    return n.select(F.concat(folder, F.lit("/"), "n_name").alias("path"), F.lit(False).alias("is_dir"), mode.alias("mode"), F.encode("n_name", "UTF-8").alias("content"), F.lit(None).cast("string").alias("link"))


# ------------------------------------------------------------------------------- lookups and projections


def lookup_fallback(spark, sf_dir):
    """Quality by a document's source and language, else by its source alone."""
    docs = _t(spark, sf_dir, "documents")
    both = docs.join(_t(spark, sf_dir, "labels"), "doc_id")
    exact = both.where("lang in ('en', 'de')").groupBy("source", F.col("lang").alias("key")).agg(F.min("quality").cast("string").alias("v"))
    other = both.groupBy("source").agg(F.max("quality").cast("string").alias("v")).select("source", F.lit("any").alias("key"), "v")
    out = pins.lookup(docs.select("doc_id", "source", "lang"), exact.unionByName(other), "source", F.col("lang"), F.lit("any"), "v", "quality")
    return out.select("doc_id", "quality")


def host_case(spark, sf_dir):
    """Targets of hosts made of market segments, with null for unknown ones, and the layout of each."""
    c = _t(spark, sf_dir, "customer")
    system = F.when(F.col("c_custkey") % 3 == 0, "Windows").when(F.col("c_custkey") % 3 == 1, "Darwin").otherwise("Linux")
    machine = F.when(F.col("c_mktsegment") == "BUILDING", "AMD64").when(F.col("c_mktsegment") == "MACHINERY", "arm64").otherwise("x86_64")
    target = pins.host_target(system, machine, strict=False)
    return c.select("c_custkey", target.alias("target"), F.when(target.isNotNull(), pins.layout(target)["site"]).alias("site"))


def map_lookup(spark, sf_dir):
    """A key of a JSON map, else another."""
    m = F.from_json("props", "map<string,string>")
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(present(F.try_element_at(m, F.lit("any"))), present(F.try_element_at(m, F.lit("k")))).alias("v"))


def mode_bits(spark, sf_dir):
    """Archive attributes of modes made of quantities."""
    line = _t(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", sinks.entry_mode(F.col("l_quantity").cast("int")).alias("attributes"))


def suffix_parts(spark, sf_dir):
    """Last dot part of the last component of a page's address, and how often each occurs."""
    return _t(spark, sf_dir, "pages").groupBy(suffix(F.col("url")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def normalized_paths(spark, sf_dir):
    """Paths with '.', '..' and doubled separators, normalized."""
    path = F.concat(F.lit("a/./b//"), "n_name", F.lit("/../c/../../"), F.col("n_regionkey").cast("string"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", normalized(path).alias("path"))


def uint_decode(spark, sf_dir):
    """Little-endian unsigned integers in the first bytes of texts."""
    d = _t(spark, sf_dir, "documents").where(F.octet_length("text") >= 4)
    return d.select("doc_id", uint_le(F.col("text").cast("binary"), F.lit(0), 4).alias("u32"), uint_le(F.col("text").cast("binary"), F.lit(2), 2).alias("u16"))


# ----------------------------------------------------------------------------------------------- checks


def digest_format(spark, sf_dir):
    """Whether texts' digests have the form of a digest, and the digest."""
    d = F.sha2("text", 256)
    return _t(spark, sf_dir, "documents").select("doc_id", d.alias("digest"), d.rlike(pins.DIGEST).alias("ok"))


def alphabet_check(spark, sf_dir):
    """Whether a text's characters all differ and one is a space."""
    return _t(spark, sf_dir, "documents").select("doc_id", pins.alphabet_check(F.col("text")).alias("ok"))


def one_match(spark, sf_dir):
    """The one region of a name; none or several would be an error."""
    return sets.only(_t(spark, sf_dir, "region").where("r_name = 'ASIA'"), "r_name")


# ------------------------------------------------------------------------------------------ sets and joins

ALLOWED = ["click", "view"]


def disallowed_sorted(spark, sf_dir):
    """Per user the sorted event types that are not allowed; users without any are left out."""
    out = sets.not_covered(_t(spark, sf_dir, "events"), "user_id", "event_type", ALLOWED, ("log",))
    return out.select("user_id", F.array_join("missing", ", ").alias("missing"))


def problem_report(spark, sf_dir):
    """One line per user with problems."""
    out = sets.not_covered(_t(spark, sf_dir, "events"), "user_id", "event_type", ALLOWED).withColumnRenamed("user_id", "path")
    return out.select("path", F.concat(F.col("path").cast("string"), F.lit(": "), F.array_join("missing", ", ")).alias("line"))


def unlabelled_docs(spark, sf_dir):
    """Documents without labels."""
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


def record_prune(spark, sf_dir):
    """Lines taken for a record's rows, kept where the part they name is in the tree."""
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("../parts/./"), F.col("l_partkey").cast("string")).alias("path"))
    tree = _t(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("lib/parts/"), F.col("p_partkey").cast("string")).alias("path"))
    return record.still_there(rows, tree, "lib/site").select("line_no", "path")  # line_no carries the order to a sink


def search_set_union(spark, sf_dir):
    """Names that loaders find: by folder, and those of the root and of folders named *.libs for all."""
    return sets.search_sets(_supplier_tree(spark, sf_dir))


RANGES = [(0, 0, 1000, 100), (1, 500, 1200, 5000), (2, 1200, 1600, 9000), (3, 1500, 2200, 20000)]


def range_first_match(spark, sf_dir):
    """File offsets of prices taken for addresses, by the first section that holds them; equal rows and misses stay."""
    sections = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(raw).alias("raw")) for _, low, high, raw in RANGES))
    address = F.floor("p_retailprice")
    rows = _t(spark, sf_dir, "part").select(F.col("p_size").alias("size"), address.alias("address"), sets.first_range(address, sections).alias("r"))
    return rows.select("size", "address", (F.col("r.raw") + F.col("address") - F.col("r.low")).cast("long").alias("at"), F.when(F.col("r").isNotNull(), sets.file_offset(F.col("address"), sections)).alias("offset"))


def trim_rules(spark, sf_dir):
    """Pages that no rule removes: patterns on their paths."""
    path = F.regexp_replace("url", "^https?://", "")
    table = [rules.Rule("**/*.pdf", tree=False), rules.Rule("m.*"), rules.Rule("**/the*"), rules.Rule("*/_*")]
    return rules.apply_rules(_t(spark, sf_dir, "pages").select("page_id", path.alias("path")), table)


# --------------------------------------------------------------------------------------- sequences and order


def state_carry(spark, sf_dir):
    """The last purchase seen so far by each user."""
    state = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return sequences.carry(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], state, "last_purchase").select("event_id", "last_purchase")


def retry_outcome(spark, sf_dir):
    """Events taken for attempts at sources: what each user's attempts come to."""
    e = _t(spark, sf_dir, "events")
    outcome = F.when(F.col("event_id") % 7 == 0, "ok").when(F.col("event_id") % 5 == 0, "mismatch").otherwise("error")
    attempts = e.select("user_id", (F.col("event_id") % 3).alias("source"), F.col("event_id").alias("attempt"), outcome.alias("outcome"), F.col("event_type").alias("message"))
    out = sequences.first_outcome(attempts, "user_id", 3)
    return out.select("user_id", "status", "source", "attempt", F.size("failures").cast("long").alias("n_failures"))


def running_cap(spark, sf_dir):
    """Running sizes per user and whether they are within a cap."""
    out = sequences.running_cap(_t(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.length("props").cast("long"), 400)
    return out.select("event_id", "running", "within")


def marker_slice(spark, sf_dir):
    """A source text's first block comment, and its passage of line comments between two markers."""
    n = F.col("s_name")
    block = F.concat(F.lit("int x; /*\t\n by "), n, F.lit(" \x0b*/ int y; /* other */"))
    passage = F.concat(F.lit("#pragma once\n// Copyright "), n, F.lit("\r\n//\n//no space\n  // in\n// OF SUCH DAMAGE. end\n// after SUCH DAMAGE.\n"))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", sequences.block_comment(block).alias("comment"), sequences.comment_block(passage).alias("passage"))


def line_explode(spark, sf_dir):
    """Lines of texts by number."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


def path_component_order(spark, sf_dir):
    """Pages numbered in the order of an archive: within each scheme by path components, then id."""
    from pyspark.sql.window import Window as W

    p = _t(spark, sf_dir, "pages")
    scheme = F.substring_index("url", "/", 3)
    return p.select("page_id", F.row_number().over(W.partitionBy(scheme).orderBy(components(F.col("url")), "page_id")).alias("rank"))


def checksum_sidecar(spark, sf_dir):
    """Checksum lines of texts."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(sinks.checksum_line(F.col("text"), name), "\n$", "").alias("line"))


def manifest_json(spark, sf_dir):
    """The manifest of each target, with versions from the table of regions."""
    at = lambda k: F.max(F.when(F.col("r_regionkey") == k, F.col("r_name")))
    rows = _t(spark, sf_dir, "region").agg(F.struct(at(0).alias("name"), F.lit('a"b c').alias("alphabet")).alias("model"), F.struct(at(1).alias("version")).alias("python"), F.struct(at(2).alias("version")).alias("native"))
    out = [(t, sinks.manifest(rows, t, {"python": "python.version", "native": "native.version"})) for t in pins.TARGETS]
    return spark.createDataFrame(out, "target string, manifest string")


def notice_rows(spark, sf_dir):
    """Rows of a notice table."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", sinks.notice_line(F.col("n_name"), F.when(F.col("n_regionkey") > 0, F.col("r_name")), F.col("n_regionkey")).alias("line"))


def group_names(spark, sf_dir):
    """Per parent the set of lower-cased names, as sorted text, of customers by nation and segment."""
    c = _t(spark, sf_dir, "customer")
    return c.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set(F.lower("c_mktsegment"))), ",").alias("names"))


def bag_union(spark, sf_dir):
    """Two name lists end to end, repeats kept, counted by name."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return s.unionAll(c).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------------- binary formats


def _executable(imported: Column, delayed: Column) -> Column:
    """A small 64-bit portable executable as bytes: one section at address 0x1000 and offset 0x400, with an import
    table of two names, the first given and KERNEL32.dll, and a delay-load table of one."""
    u16, u32 = (lambda x, n=n: F.lit(x.to_bytes(n, "little").hex()) for n in (2, 4))
    zeros = lambda n: F.lit("00" * n)
    slot = lambda x: F.rpad(F.hex(F.encode(x, "UTF-8")), 128, "0")  # noqa: E731 64 bytes
    start = F.concat(F.lit(b"MZ".hex()), zeros(58), u32(0x80), zeros(0x40))
    header = F.concat(F.lit(b"PE\0\0".hex()), u16(0x8664), u16(1), zeros(12), u16(240), u16(0))
    optional = F.concat(u16(0x20B), zeros(110), zeros(8), u32(0x1000), u32(0), zeros(11 * 8), u32(0x1100), u32(0), zeros(240 - 112 - 14 * 8))
    section = F.concat(F.lit(b".data".hex()), zeros(3), u32(0x400), u32(0x1000), u32(0x400), u32(0x400), zeros(16))
    tables = F.concat(zeros(12), u32(0x1200), u32(1), u32(1), zeros(8), u32(0x1240), u32(1), zeros(20), zeros(0x100 - 60))
    tables = F.concat(tables, u32(1), u32(0x1280), zeros(24), zeros(32), zeros(0x100 - 64))
    head = F.concat(start, header, optional, section)
    return F.unhex(F.concat(F.rpad(head, 0x800, "0"), tables, slot(imported), slot(F.lit("KERNEL32.dll")), slot(delayed), zeros(0x400 - 0x2C0)))


def pe_decode(spark, sf_dir):
    """Imports of executables made of nation names: one per nation, its region's name delay-loaded."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.select(F.col("n_nationkey").cast("string").alias("path"), _executable(F.concat("n_name", F.lit(".dll")), F.concat("r_name", F.lit(".dll"))).alias("content"))
    return native.pe_imports(files).select("path", "ord", "dll")


def depcheck(spark, sf_dir):
    """The gate's relational core: suppliers' needs against names their nation or nation 0 provides."""
    s = _t(spark, sf_dir, "supplier")
    files = s.select(F.concat_ws("/", F.when(F.col("s_nationkey") != 0, F.col("s_nationkey").cast("string")), "s_name").alias("path"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") != 0, F.col("s_nationkey").cast("string")).otherwise("").alias("parent"))
    needs = files.select("path", F.lower(F.concat(F.lit("Supplier#"), F.lpad((F.regexp_extract("name", r"(\d+)$", 1).cast("long") * 7 % 90).cast("string"), 9, "0"))).alias("dll"))
    return native.missing_windows(files, needs).select("path", F.array_join("missing", ",").alias("missing"))


# ------------------------------------------------------------------------------------------- trees and rules

def _files(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """Files and the folders above them as a tree."""
    folders = {p[:k] for p in names for k, c in enumerate(p) if c == "/"}
    rows = [(p, False, 0o644, x.encode()) for p, x in names.items()] + [(p, True, 0o755, None) for p in sorted(folders)]
    return spark.createDataFrame(rows, "path string, is_dir boolean, mode int, content binary")


def tree_scan(spark, sf_dir):
    """Nation files written to a folder and listed, hidden and underscored names and folders included."""
    folder = _folder(spark)
    trees.write_tree(_nation_tree(spark, sf_dir), folder)
    return trees.read_tree(spark, folder).select("path", "name", "parent", "is_dir", F.when(~F.col("is_dir"), F.col("mode")).alias("mode"), F.when(~F.col("is_dir"), F.col("length")).alias("length"))


def tree_heads(spark, sf_dir):
    """Direct children of a folder: the first bytes of each file and the whole."""
    folder = _folder(spark)
    trees.write_tree(_nation_tree(spark, sf_dir), folder)
    listed = trees.read_tree(spark, folder).where("parent = 'a-b' and not is_dir")
    text = lambda df, c: df.select("path", F.col("content").cast("string").alias(c))
    return text(trees.contents(listed, folder, head=4), "head").join(text(trees.contents(listed, folder), "whole"), "path")


def tree_copy(spark, sf_dir):
    """A folder's entries moved under another name and copied to disk, with a link."""
    folder = _folder(spark)
    rows = trees.copied(_nation_tree(spark, sf_dir), "new/place", "_under")
    link = rows.limit(1).select(F.lit("new/link").alias("path"), "is_dir", "mode", "content", F.lit("place").alias("link"))
    trees.write_tree(rows.unionByName(link), folder)
    return trees.read_tree(spark, folder, follow=True).where("not is_dir and inside").select("path", "is_symlink")


# -------------------------------------------------------------------------------------------- more operators


def load_commands(spark, sf_dir):
    """Libraries and search paths of load-command listings, one listing per nation."""
    text = "cmd LC_ID_DYLIB|  name /self (offset 24)|   cmd LC_LOAD_DYLIB|cmdsize 48|  name {}.dylib (offset 24) (offset 9)|cmd LC_RPATH|cmdsize 9| path @loader_path/../{} (offset 12)| name not|\tcmd LC_LAZY_LOAD_DYLIB |name /opt/{}|cmd LC_UUID|name no"
    filled = F.split(F.replace(F.lit(text), F.lit("{}"), F.col("n_name")), r"\|")
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.posexplode(filled).alias("line_no", "line"))
    return sequences.load_commands(rows)


def gate_tree(spark, sf_dir):
    """The gate over a tree on disk: an executable for each supplier, with imports that its folder, the root, shared folders or Windows
    provide, or nobody."""
    s = _supplier_tree(spark, sf_dir)
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    other = F.concat(F.lit("Supplier#"), F.lpad((number * 7 % 90 + 1).cast("string"), 9, "0"), F.lit(".dll"))
    content = _executable(other, F.when(number % 11 == 0, "GONE.dll").otherwise("api-ms-win-x.dll"))
    rows = s.select(F.concat("path", F.lit(".dll")).alias("path"), F.lit(False).alias("is_dir"), F.lit(0o644).alias("mode"), content.alias("content"), F.lit(None).cast("string").alias("link"))
    folder = _folder(spark)
    trees.write_tree(rows, folder)
    return native.report(dependencies.windows_problems(spark, folder))


def windows_libraries(spark, sf_dir):
    """Imports that neither the file's folder, the root, folders of shared libraries nor Windows provide."""
    files = _supplier_tree(spark, sf_dir)
    needs = F.array(F.lower("name"), F.lit("supplier#000000001"), F.lit("supplier#000000002"), F.lit("kernel32.dll"), F.lit("api-ms-win-core.dll"), F.lit("ext-ms-x.dll"), F.lit("msvcp140.dll"), F.lit("msvcp140.dll"))
    out = native.missing_windows(files, files.select("path", F.explode(needs).alias("dll")))
    return out.select("path", F.array_join("missing", ",").alias("missing"))


def native_candidates(spark, sf_dir):
    """Which files are native, by suffix on Windows and by their first bytes on macOS."""
    n = _t(spark, sf_dir, "nation")
    name = F.concat("n_name", F.element_at(F.array(*map(F.lit, (".DLL", ".pyd", ".txt", ".exe", ""))), (F.col("n_nationkey") % 5 + 1).cast("int")))
    head = F.element_at(F.array(*map(F.lit, ("CFFAEDFE", "CAFEBABE", "4D5A9000", "CEFAEDFE", "CAFEBABF"))), (F.col("n_regionkey") + 1).cast("int"))
    return n.select("n_nationkey", native.is_windows_native(suffix(name)).alias("windows"), native.is_mac_native(F.unhex(F.concat(head, F.hex("n_name")))).alias("mac"))


def path_parts(spark, sf_dir):
    """Name, parent and place beneath a root of pages' addresses; text stripped of white space; places of interpreters."""
    url = F.regexp_replace("url", "^https?://", "")
    target = F.when(F.col("page_id") % 2 == 0, pins.WINDOWS).otherwise(pins.MAC_ARM)
    return _t(spark, sf_dir, "pages").select(
        "page_id", paths.name(url).alias("name"), paths.parent(url).alias("parent"), paths.relative(F.concat(F.when(F.col("page_id") % 2 == 0, "root/x/").otherwise("root/xy/"), url), "root/x").alias("rest"),
        paths.stripped(F.concat(F.lit("\t\u00a0\x0b "), url, F.lit(" \u2028\n"))).alias("stripped"), pins.venv_python(target).alias("venv"))


def _pins(spark: SparkSession, sf_dir: str, change=lambda d: None) -> DataFrame:
    """A pins document with names of the table of regions, written as JSON and read."""
    names = [r.r_name for r in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    digest = "0123456789abcdef" * 4
    document = {
        "format_version": 1,
        "python": {"version": "3.12.9", "release": "20260101", "targets": {t: {"url": f"https://x/{t}/20260101/cpython-3.12.9%2B{t}.tar.gz", "bytes": 10 + k, "sha256": digest} for k, t in enumerate(pins.TARGETS)}},
        "packages": {n: {"version": "1.0", "sha256": {"any": digest}} for n in names},
        "library": {"version": "1", "url": "https://x/lib", "sha256": digest, "max_order": 12},
        "build_tools": [f"tool==1.0 --hash=sha256:{digest}"],
        "model": {"name": "m", "url": "https://b/m", "download_urls": ["https://a/m.gz", "https://b/m"], "gzip_bytes": 5, "gzip_sha256": digest, "bytes": 9, "sha256": digest, "alphabet": "ab ", "source": "s", "permission": "p"},
    }
    change(document)
    at = os.path.join(_folder(spark), "pins.json")
    with open(at, "w") as f:
        json.dump(document, f, indent=1)
    return read_pins(spark, at, native="library")


def pin_rows(spark, sf_dir):
    """The interpreter's pins by target, and that of one target."""
    document = _pins(spark, sf_dir)
    chosen = pins.python_pin(document, pins.MAC_ARM).select(F.lit("chosen").alias("target"), "bytes")
    return pins.python_pins(document).select("target", "bytes").union(chosen)


def pin_violations(spark, sf_dir):
    """Broken invariants of a pins document that breaks some of each kind, and none of a sound one."""

    def change(d):
        d["python"]["release"] = "other"
        d["packages"].pop("ASIA")
        d["packages"]["EUROPE"]["sha256"]["any"] = "short"
        d["build_tools"].append("Tool==1")
        d["library"]["max_order"] = 6
        d["model"].update(alphabet="aab ", download_urls=["https://other/m.gz", "https://b/m"])

    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    broken, sound = (pins.violations(p, "https://a/", names) for p in (_pins(spark, sf_dir, change), _pins(spark, sf_dir)))
    return broken.unionAll(sound).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def fetch_outcomes(spark, sf_dir):
    """Downloads over lists of sources, by nation: missing, cut short, oversized, wrong bytes, then the right ones."""

    def run(batches):
        import hashlib

        import pandas as pd

        for frame in batches:
            out = []
            for key, name in zip(frame["n_nationkey"], frame["n_name"], strict=True):
                data, opened = name.encode(), []

                def opener(url, data=data, opened=opened):
                    opened.append(url)
                    if url == "missing":
                        raise OSError("gone")
                    return io.BytesIO({"short": data[:-1], "large": data + b"x", "wrong": data[::-1] + b"", "good": data}[url])

                kinds = ["missing", "short", "large", "wrong"][: key % 5] + (["good"] if key % 3 else [])
                with tempfile.TemporaryDirectory() as folder:  # within the task
                    fetcher = fetch.Fetcher(tries=2, pause_s=0, opener=opener, pause=lambda s: None)
                    try:
                        fetcher.fetch(kinds, os.path.join(folder, "f"), hashlib.sha256(data).hexdigest(), len(data))
                        fetcher.fetch(kinds, os.path.join(folder, "f"), hashlib.sha256(data).hexdigest(), len(data))  # is there already
                        status = "ok"
                    except fetch.Failed:
                        status = "failed"
                out.append((key, status, len(opened)))
            yield pd.DataFrame(out, columns=["n_nationkey", "status", "opened"])

    return _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInPandas(run, "n_nationkey int, status string, opened long")


def best_orders(spark, sf_dir):
    """The five dearest orders."""
    return sequences.top(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 5, F.desc("o_totalprice"), F.col("o_orderkey"))


def _tar(folder: str, entries: list) -> str:
    """A tar of (name, bytes, or the target of a symbolic or hard link) in a folder."""
    at = os.path.join(folder, "archive.tar.gz")
    with tarfile.open(at, "w:gz") as archive:
        for name, kind, data in entries:
            info = tarfile.TarInfo(name)
            info.mode, info.type = 0o755, {"file": tarfile.REGTYPE, "link": tarfile.SYMTYPE, "hard": tarfile.LNKTYPE, "dir": tarfile.DIRTYPE}[kind]
            if kind == "file":
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
            else:
                info.linkname = data
                archive.addfile(info)
    return at


def package_job(spark, sf_dir):
    """The whole job from pins to archive on a made-up Windows runtime: entries, modes, and the checksum file."""
    import hashlib

    folder = _folder(spark)
    entries = [(f"python/{p}", "file", b"x") for p in ("python.exe", "Lib/os.py", "Lib/test/t.py", "include/a.h", "DLLs/tcl86.dll")]
    base, model = _tar(folder, entries), b"model bytes"
    held = {"https://x/base": open(base, "rb").read(), "https://x/m.gz": gzip.compress(model)}
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def change(d):
        d["python"]["targets"][pins.WINDOWS] = {"url": "https://x/base", "bytes": len(held["https://x/base"]), "sha256": digest(held["https://x/base"])}
        d["model"].update(download_urls=["https://x/none", "https://x/m.gz"], gzip_bytes=len(held["https://x/m.gz"]), gzip_sha256=digest(held["https://x/m.gz"]), bytes=len(model), sha256=digest(model))

    def opener(url):
        if url not in held:
            raise OSError("gone")
        return io.BytesIO(held[url])

    def install(site, lines):
        os.makedirs(f"{site}/p.dist-info")
        for name, text in (("p.py", ""), ("old.whl", ""), ("p.dist-info/RECORD", "p.py,,\ngone.py,,\n"), ("p.dist-info/REQUESTED", ""), ("lines", open(lines).readline())):
            with open(f"{site}/{name}", "w") as f:
                f.write(text)

    document = os.path.join(folder, "pins.json")
    os.replace(_pins(spark, sf_dir, change).inputFiles()[0].removeprefix("file://"), document)
    job = package.Job(document, f"{folder}/out", f"{folder}/work", "Windows", "AMD64", "library", install=install, fetcher=fetch.Fetcher(pause_s=0, opener=opener), notices=lambda p, t: sinks.notices("Notices", "Some.", p.select(F.lit(1).alias("rank"), F.lit("model").alias("component"), F.lit(None).cast("string").alias("version"), "model.permission", "model.source").toDF("rank", "component", "version", "licence", "source"), "End."))
    out = package.package(spark, job)
    with open(f"{out}.sha256") as f, open(out, "rb") as g:
        sound = f.read() == f"{digest(g.read())}  {os.path.basename(out)}\n"
    with zipfile.ZipFile(out) as z:
        rows = [(k, i.filename, z.read(i).decode(), sound) for k, i in enumerate(z.infolist())]
    return spark.createDataFrame(rows, "ord long, path string, content string, sound boolean")


_QUERIES = [
    lookup_fallback, host_case, map_lookup, mode_bits, suffix_parts, normalized_paths, uint_decode, digest_format, alphabet_check, one_match, disallowed_sorted, problem_report,
    unlabelled_docs, record_prune, search_set_union, range_first_match, trim_rules, state_carry, retry_outcome, running_cap, marker_slice, line_explode, path_component_order, checksum_sidecar,
    manifest_json, notice_rows, group_names, bag_union, pe_decode, depcheck, tree_scan, tree_heads, tree_copy,
    load_commands, windows_libraries, gate_tree, native_candidates, path_parts, pin_rows, pin_violations, fetch_outcomes, best_orders, package_job,
]
QUERIES = {f.__name__: f for f in _QUERIES} | table_queries.QUERIES

_TARGET = """case when c_custkey % 3 = 0 and c_mktsegment <> 'MACHINERY' then 'x86_64-pc-windows-msvc' when c_custkey % 3 = 1 and c_mktsegment = 'MACHINERY' then 'aarch64-apple-darwin'
 when c_custkey % 3 = 1 and c_mktsegment <> 'BUILDING' then 'x86_64-apple-darwin' end"""

_FOLDERS = """select *, case when parent <> '' then parent || '/' else '' end || name as path from
        (select s_name as name, case s_nationkey when 0 then '' when 1 then 'pkg/one.libs' else 'pkg/' || s_nationkey end as parent from supplier)"""
_NATIONS = "select *, case n_regionkey when 0 then 'a' when 1 then 'a-b' when 2 then '.hidden' else '_under/a' end || '/' || n_name as path from nation"

ORACLES = {
    "lookup_fallback": """with b as (select d.source, d.lang, l.quality from documents d join labels l using (doc_id)),
        k as (select source, lang as key, min(quality)::varchar as v from b where lang in ('en', 'de') group by 1, 2 union all select source, 'any', max(quality)::varchar from b group by 1)
        select d.doc_id, coalesce(nullif(a.v, ''), nullif(o.v, '')) as quality from documents d left join k a on a.source = d.source and a.key = d.lang left join k o on o.source = d.source and o.key = 'any'""",
    "host_case": f"""select c_custkey, {_TARGET} as target, case when {_TARGET} like '%msvc' then 'Lib/site-packages' when {_TARGET} is not null then 'lib/python3.12/site-packages' end as site from customer""",
    "map_lookup": "select event_id, coalesce(nullif(json_extract_string(props, '$.any'), ''), nullif(json_extract_string(props, '$.k'), '')) as v from events",
    "mode_bits": "select l_orderkey, l_linenumber, ((32768 | case when l_quantity::int & 73 <> 0 then 493 else 420 end)::bigint << 16) as attributes from lineitem",
    "suffix_parts": r"select regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1) as suffix, count(*) as n from pages group by 1",
    "normalized_paths": "select n_nationkey, 'a/' || n_regionkey as path from nation",
    "uint_decode": """with h as (select doc_id, hex(encode(text)) x from documents where strlen(text) >= 4)
        select doc_id, ('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2])::bigint as u32, ('0x' || x[7:8] || x[5:6])::bigint as u16 from h""",
    "digest_format": "select doc_id, sha256(text) as digest, regexp_matches(sha256(text), '^[0-9a-f]{64}$') as ok from documents",
    "alphabet_check": "select doc_id, len(list_distinct(string_split(text, ''))) = len(string_split(text, '')) and contains(text, ' ') as ok from documents",
    "one_match": "select * from region where r_name = 'ASIA'",
    "disallowed_sorted": "select user_id, string_agg(distinct event_type, ', ' order by event_type) as missing from events where event_type not in ('click', 'view') and not starts_with(event_type, 'log') group by 1",
    "problem_report": "select user_id as path, user_id || ': ' || string_agg(distinct event_type, ', ' order by event_type) as line from events where event_type not in ('click', 'view') group by 1",
    "unlabelled_docs": "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "record_prune": "select l_orderkey * 10 + l_linenumber as line_no, '../parts/./' || l_partkey as path from lineitem where exists (select 1 from part where p_partkey = l_partkey and p_size < 25)",
    "search_set_union": f"""with f as ({_FOLDERS}) select distinct parent as scope, lower(name) as dll from f union select '*', lower(name) from f where parent = '' or parent like '%.libs'""",
    "range_first_match": """with r(i, lo, hi, raw) as (values (0, 0, 1000, 100), (1, 500, 1200, 5000), (2, 1200, 1600, 9000), (3, 1500, 2200, 20000)),
        p as (select p_partkey, p_size as size, floor(p_retailprice)::bigint as address from part), h as (select p_partkey, min(i) as i from p join r on address >= lo and address < hi group by 1)
        select size, address, (raw + address - lo)::bigint as "at", (raw + address - lo)::bigint as "offset" from p left join h using (p_partkey) left join r using (i)""",
    "trim_rules": r"""with p as (select page_id, regexp_replace(url, '^https?://', '') as path from pages)
        select page_id, path from p where not regexp_matches(path, '^(?:[^/]+/)*[^/]*\.pdf$') and not regexp_matches(path, '^m\.[^/]*(/.*)?$') and not regexp_matches(path, '^(?:[^/]+/)*the[^/]*(/.*)?$') and not regexp_matches(path, '^[^/]*/_[^/]*(/.*)?$')""",
    "state_carry": "select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase from events",
    "retry_outcome": """with a as (select user_id, event_id % 3 source, event_id attempt, case when event_id % 7 = 0 then 'ok' when event_id % 5 = 0 then 'mismatch' else 'error' end outcome from events),
        b as (select *, row_number() over w n, coalesce(max((outcome <> 'error')::int) over (w rows between unbounded preceding and 1 preceding), 0) ended from a window w as (partition by user_id, source order by attempt)),
        c as (select *, min(case when outcome = 'ok' then source * 1000000000 + attempt end) over (partition by user_id) won from b where n <= 3 and ended = 0)
        select user_id, case when max(won) is null then 'failed' else 'ok' end as status, max(won) // 1000000000 as source, max(won) % 1000000000 as attempt, count(*) filter (outcome <> 'ok') as n_failures
        from c where won is null or source * 1000000000 + attempt <= won group by 1""",
    "running_cap": """with r as (select event_id, sum(length(props)) over (partition by user_id order by event_id rows unbounded preceding)::bigint as running from events)
        select event_id, running, running <= 400 as within from r""",
    "marker_slice": "select s_suppkey, 'by ' || s_name as comment, 'Copyright ' || s_name || chr(10) || chr(10) || 'no space' || chr(10) || '// in' || chr(10) || 'OF SUCH DAMAGE. end' as passage from supplier",
    "line_explode": r"""with l as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') a from documents),
        m as (select doc_id, case when a[-1] = '' then a[:-2] else a end a from l)
        select doc_id, i - 1 as pos, a[i] as line from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from m)""",
    "path_component_order": "select page_id, row_number() over (partition by array_to_string(string_split(url, '/')[1:3], '/') order by string_split(url, '/'), page_id)::int as rank from pages",
    "checksum_sidecar": "select doc_id, sha256(text) || '  doc-' || doc_id as line from documents",
    "manifest_json": """select t as target, replace(replace(replace(replace(replace('{
  "format_version": 1,
  "target": "TARGET",
  "python": "PLACE",
  "model": "model/MODEL",
  "model_alphabet": "a\\"b c",
  "versions": {
    "python": "V1",
    "native": "V2"
  }
}
', 'TARGET', t), 'PLACE', case when t like '%msvc' then 'python.exe' else 'bin/python3.12' end), 'MODEL', (select r_name from region where r_regionkey = 0)),
        'V1', (select r_name from region where r_regionkey = 1)), 'V2', (select r_name from region where r_regionkey = 2)) as manifest
        from (values ('x86_64-pc-windows-msvc'), ('aarch64-apple-darwin'), ('x86_64-apple-darwin')) v(t)""",
    "notice_rows": "select n_nationkey, '| ' || n_name || ' | ' || case when n_regionkey > 0 then r_name else '' end || ' | ' || n_regionkey || ' |' as line from nation join region on n_regionkey = r_regionkey",
    "group_names": "select c_nationkey, string_agg(distinct lower(c_mktsegment), ',' order by lower(c_mktsegment)) as names from customer group by 1",
    "bag_union": "select k, count(*) as n from (select s_nationkey k from supplier union all select c_nationkey from customer) group by 1",
    "pe_decode": """select n_nationkey::varchar as path, o::int as ord, case o when 0 then lower(n_name) || '.dll' when 1 then 'kernel32.dll' else lower(r_name) || '.dll' end as dll
        from nation join region on n_regionkey = r_regionkey, range(3) t(o)""",
    "depcheck": r"""with f as (select case when s_nationkey <> 0 then s_nationkey || '/' else '' end || s_name as path, case when s_nationkey <> 0 then s_nationkey::varchar else '' end parent, lower(s_name) name,
          lower('Supplier#' || lpad((regexp_extract(s_name, '(\d+)$', 1)::bigint * 7 % 90)::varchar, 9, '0')) dll from supplier)
        select path, string_agg(distinct dll, ',' order by dll) as missing from f where not exists (select 1 from f o where o.name = f.dll and (o.parent = f.parent or o.parent = '')) group by 1""",
    "tree_scan": f"""with f as ({_NATIONS}) select path, n_name as name, regexp_replace(path, '/[^/]*$', '') as parent, false as is_dir, case when n_nationkey % 2 = 0 then 448 else 416 end::int as mode, strlen(n_name)::bigint as length from f
        union all select * from (values ('a', 'a', '', true, null::int, null::bigint), ('a-b', 'a-b', '', true, null, null), ('.hidden', '.hidden', '', true, null, null), ('_under', '_under', '', true, null, null), ('_under/a', 'a', '_under', true, null, null)) v""",
    "tree_heads": f"""with f as ({_NATIONS}) select path, n_name[1:4] as head, n_name as whole from f where n_regionkey = 1""",
    "tree_copy": "select p || n_name as path, false as is_symlink from nation, (values ('new/place/a/'), ('new/link/a/')) v(p) where n_regionkey > 2",
    "load_commands": """select n_nationkey::varchar as path, k::int as line_no, case k when 7 then 'rpath' else 'dependency' end as kind, case k when 4 then n_name || '.dylib (offset 24)' when 7 then '@loader_path/../' || n_name else '/opt/' || n_name end as value
        from nation, (values (4), (7), (10)) v(k)""",
    "gate_tree": f"""with f as ({_FOLDERS}), n as (select *, substr(name, 10)::bigint as k from f),
        m as (select path || '.dll' as path, parent, unnest(['supplier#' || lpad((k * 7 % 90 + 1)::varchar, 9, '0') || '.dll', case when k % 11 = 0 then 'gone.dll' end]) as dll from n)
        select path, path || ': ' || string_agg(distinct dll, ', ' order by dll) as line from m
        where dll is not null and not exists (select 1 from f where lower(f.name) || '.dll' = m.dll and (f.parent = m.parent or f.parent = '' or f.parent like '%.libs')) group by path""",
    "windows_libraries": f"""with f as ({_FOLDERS}), n as (select path, parent, unnest([lower(name), 'supplier#000000001', 'supplier#000000002', 'msvcp140.dll']) as dll from f)
        select path, string_agg(distinct dll, ',' order by dll) as missing from n where not exists (select 1 from f where lower(f.name) = n.dll and (f.parent = n.parent or f.parent = '' or f.parent like '%.libs')) group by 1""",
    "native_candidates": "select n_nationkey, n_nationkey % 5 in (0, 1, 3) as windows, n_regionkey <> 2 as mac from nation",
    "path_parts": """with u as (select page_id, regexp_replace(url, '^https?://', '') as u from pages)
        select page_id, regexp_extract(u, '[^/]*$') as name, regexp_replace(u, '/?[^/]*$', '') as parent, case when page_id % 2 = 0 then u else 'root/xy/' || u end as rest, u as stripped, case when page_id % 2 = 0 then 'Scripts/python.exe' else 'bin/python' end as venv from u""",
    "pin_rows": """select * from (values ('x86_64-pc-windows-msvc', 10::bigint), ('aarch64-apple-darwin', 11), ('x86_64-apple-darwin', 12), ('chosen', 11)) v(target, bytes)""",
    "pin_violations": """select * from (values ('I2', 3::bigint), ('I3', 1), ('I4', 1), ('I5', 1), ('I6', 1), ('I7', 1), ('I8', 1)) v(rule, n)""",
    "fetch_outcomes": "select n_nationkey, case when n_nationkey % 3 > 0 then 'ok' else 'failed' end as status, ([0, 2, 4, 5, 6][n_nationkey % 5 + 1] + (n_nationkey % 3 > 0)::int)::bigint as opened from nation",
    "best_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5",
    "package_job": """select ord::bigint as ord, path, content, true as sound from (values (0, 'Lib/os.py', 'x'), (1, 'Lib/site-packages/lines', 'AFRICA==1.0 --hash=sha256:' || repeat('0123456789abcdef', 4) || chr(10)), (2, 'Lib/site-packages/p.dist-info/RECORD', 'p.py,,' || chr(10)),
        (3, 'Lib/site-packages/p.py', ''), (4, 'manifest.json', '{
  "format_version": 1,
  "target": "x86_64-pc-windows-msvc",
  "python": "python.exe",
  "model": "model/m",
  "model_alphabet": "ab ",
  "versions": {
    "python": "3.12.9"
  }
}
'), (5, 'model/m', 'model bytes'), (6, 'notices/NOTICE.md', '# Notices

Some.

| Component | Version | Licence | Source |
|---|---|---|---|
| model |  | p | s |

End.
'), (7, 'python.exe', 'x')) v(ord, path, content)""",
}
ORACLES |= table_queries.ORACLES
