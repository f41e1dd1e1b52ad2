"""Queries of the operators for groups, rule sets, links and archives of any size, and the SQL each is held against."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.paths import components
from .operators import intervals, links, native, pins, rule_tables, rules, scans, sequences
from .plans import package, sinks
from .shared import new_folder
from .shared import table as _t
from .sources import fetch, records, trees
from .sources.archives import local_path, read_zip


def _folder(spark) -> str:
    at = local_path(new_folder(spark))
    os.makedirs(at, exist_ok=True)
    return at


def _pick(values: list[str], number: Column) -> Column:
    """The item of a constant list at number modulo its length."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list[str], number: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({number}) % {len(values)} + 1]"


# ------------------------------------------------------------------------------------------------- one huge group


def running_cap_all(spark, sf_dir):
    """Running quantities over all order lines as one group, and whether they are within a cap."""
    line = _t(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    out = scans.running_total(line.select(*order), [], order, F.col("l_quantity").cast("bigint"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "running", (F.col("running") <= 100_000).alias("within"))


def load_commands_one(spark, sf_dir):
    """One listing of load commands as long as the table of order lines: commands at each seventh line."""
    line = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    command = _pick(["LC_LOAD_DYLIB", "LC_RPATH", "LC_UUID", "LC_LAZY_LOAD_DYLIB"], F.col("part"))
    value = F.concat(F.when(F.col("part") % 3 == 0, "  name ").otherwise(" path "), F.lit("/p"), F.col("part").cast("string"), F.lit(" (offset 24)"))
    text = F.when((F.col("l_linenumber") == 7) | (F.col("l_orderkey") % 50 == 0), F.concat(F.lit("cmd "), command)).otherwise(value)
    rows = line.select(F.lit("all").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), text.alias("line"))
    return sequences.load_commands(rows, scans.carry)


def state_carry_all(spark, sf_dir):
    """The last purchase seen so far by anyone."""
    state = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return scans.carry(_t(spark, sf_dir, "events"), [], ["ts", "event_id"], state, "last_purchase").select("event_id", "last_purchase")


def path_rank(spark, sf_dir):
    """Pages numbered through in the order of an archive: by path components, then id."""
    p = _t(spark, sf_dir, "pages").select("page_id", components(F.col("url")).alias("at"))
    return scans.rank(p, [], ["at", "page_id"]).select("page_id", "rank")


def record_rows(spark, sf_dir):
    """One record of all documents, with line ends and quotes within fields: its rows, and their text again."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n"))
    path = F.concat(F.lit('"dir,'), F.col("doc_id").cast("string"), F.lit('\n""'), F.coalesce("lang", F.lit("")), F.lit('""'))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(path, F.lit('\n",sha256=x,'), F.col("n").cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("plain/"), F.col("doc_id").cast("string"), F.lit(",,")))
    lines = d.select(F.lit("RECORD").alias("record"), "doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = records.read_records(lines.select("record", (F.col("doc_id") * 10 + F.col("pos")).alias("line_no"), "line"))
    return rows.select("line_no", "path", F.size("fields").cast("long").alias("n"), records.row_text(F.col("fields")).alias("text"))


# ------------------------------------------------------------------------------------------- rules, ranges, links


def rule_table(spark, sf_dir):
    """Pages that a table of rules leaves, one rule for each supplier: whole paths, names anywhere, patterns in a folder, and allowances."""
    pages = _t(spark, sf_dir, "pages")
    path = F.regexp_replace(F.substring_index(F.regexp_replace("url", "^https?://", ""), "?", 1), "/$", "")
    tree = pages.select("page_id", path.alias("path"))
    k = F.col("s_suppkey")
    number = k.cast("string")
    host = F.concat(F.lit("h"), (k % 40).cast("string"))
    glob = F.when(k % 4 == 0, F.concat(host, F.lit("/x/"), number)).when(k % 4 == 1, F.concat(F.lit("**/"), number)).when(k % 4 == 2, F.concat(host, F.lit("/*/"), (k % 10).cast("string"), F.lit("*"))).otherwise(F.concat(F.lit("h"), (k % 3).cast("string"), F.lit("/en/*"), (k % 10).cast("string")))
    table = _t(spark, sf_dir, "supplier").select(k.alias("rule_id"), glob.alias("glob"), (k % 2 == 0).alias("tree"), (k % 4 == 3).alias("keep"))
    hosts = F.concat(F.lit("h"), (F.col("page_id") % 40).cast("string"), F.lit("/"), F.regexp_replace("path", "^[^/]*/", ""))
    return rule_tables.apply_table(tree.withColumn("path", hosts), table).select("page_id", "path")


WINDOWS_FOLDERS = ["include", "libs", "Scripts/sub", "tcl", "tcl8", "DLLs", "DLLs/sub", "Lib", "Lib/test", "Lib/tests", "Lib/unittest/test", "Lib/unittest", "other/test", "Lib/sqlite3/test/deep"]
MAC_FOLDERS = ["bin", "bin/sub", "include", "share/man", "lib", "lib/tcl8.6", "lib/tcl7", "lib/tk9", "lib/itcl4", "lib/python3.12", "lib/python3.12/test", "lib/python3.12/lib-dynload", "lib/python3.12/config-3.12-darwin", "lib/python3.12/site-packages/old"]
HEADS = ["_test", "tcl", "tk", "libtcl", "_ctypes_test", "x"]
TAILS = [".pyd", ".dll", ".pdb", ".py", ".dylib"]


def _runtime(spark, sf_dir: str, folders: list[str]) -> DataFrame:
    """Parts as files of a runtime, in its folders, and an interpreter beside them."""
    k = F.col("p_partkey")
    name = F.concat(_pick(HEADS, F.floor(k / 100)), k.cast("string"), _pick(TAILS, F.floor(k / 10)))
    name = F.when(k % 1000 == 14, "python3.12").otherwise(name)
    path = F.concat(_pick(folders, k), F.lit("/"), name)
    return _t(spark, sf_dir, "part").select(path.alias("path"), F.lit(False).alias("is_dir"), F.lit(0o644).alias("mode"), F.lit(None).cast("binary").alias("content"))


def trim_windows(spark, sf_dir):
    """What is left of a Windows runtime of all parts."""
    return rules.trim(_runtime(spark, sf_dir, WINDOWS_FOLDERS), pins.WINDOWS, "Lib/site-packages").select("path", "is_dir")


def trim_mac(spark, sf_dir):
    """What is left of a macOS runtime of all parts."""
    return rules.trim(_runtime(spark, sf_dir, MAC_FOLDERS), pins.MAC_ARM, "lib/python3.12/site-packages").select("path", "is_dir")


SITE = "lib/site"
LEFTOVERS = ["{p}/m{k}.py", "{p}/m{k}.lib", "m{k}.exp", "{p}/__pycache__/m{k}.pyc", "numpy/core/tests/m{k}.py", "{p}/tests/m{k}.py", "bin/m{k}", "{p}/m{k},x.py"]


def clean_tree(spark, sf_dir):
    """What is left of a folder of packages made of parts, and their records; cleaned twice."""
    k = F.col("p_partkey")
    package_ = F.concat(F.lit("p"), (k % 25).cast("string"))
    name = F.replace(F.replace(_pick(LEFTOVERS, F.floor(k / 25)), F.lit("{p}"), package_), F.lit("{k}"), k.cast("string"))
    part = _t(spark, sf_dir, "part").select(k.alias("k"), package_.alias("package"), name.alias("name"))
    row = F.concat(records.row_text(F.array(F.col("name"), F.concat(F.lit("sha256="), F.col("k").cast("string")), F.lit(""))), F.lit("\n"))
    held = part.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))).alias("rows"))  # a package's record
    record = held.select(F.concat("package", F.lit(".dist-info/RECORD")).alias("name"), F.encode(F.array_join(F.transform("rows", lambda r: r["row"]), ""), "UTF-8").alias("content"))
    asked = held.select(F.concat("package", F.lit(".dist-info/REQUESTED")).alias("name"), F.lit(b"").alias("content"))
    files = part.select("name", F.lit(b"").alias("content")).union(record).union(asked)
    tree = files.select(F.concat(F.lit(SITE + "/"), "name").alias("path"), F.lit(False).alias("is_dir"), "content")
    return rules.clean(rules.clean(tree, SITE), SITE).select("path", F.col("content").cast("string").alias("content"))


def event_ranges(spark, sf_dir):
    """For each event's value the first order, by key, in whose range it lies: ranges overlap, nest, repeat and miss some values."""
    e = _t(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 1000).alias("value"))
    o = _t(spark, sf_dir, "orders")
    low = F.floor(F.col("o_totalprice") * 7) % 400_000 - 1000
    width = F.when(F.col("o_orderkey") % 100 == 0, 20_000).otherwise(F.col("o_custkey") % 7)
    ranges = o.select("o_orderkey", low.alias("low"), (low + width).alias("high"))
    out = intervals.first_match(e, "value", ranges, "low", "high", ["o_orderkey"])
    return out.select("event_id", "value", F.col("range.o_orderkey").alias("o_orderkey"), (F.col("value") - F.col("range.low")).alias("offset"))


def _link_tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(paths, links): parts' folders are links to one another, in chains that end in real folders, leave the tree or go round in circles."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = lambda n: n.cast("bigint").cast("string")
    target = F.when(k % 5 == 0, F.concat(F.lit("../real/"), name(k))).when(k % 5 == 1, F.concat(F.lit("./v"), name(k - 1))).when(k % 5 == 2, F.concat(F.lit("/tree/links//v"), name(k - 1)))
    target = F.when(k % 50 == 3, F.concat(F.lit("v"), name(k + 1))).when(k % 50 == 4, F.concat(F.lit("v"), name(k - 1))).when(k % 50 == 13, "../../..").when(k % 50 == 14, F.concat(F.lit("v"), name(k - 2), F.lit("/.."))).otherwise(target)
    own = p.select(F.concat(F.lit("/tree/links/v"), name(k)).alias("path"), target.alias("target"), "p_partkey").where("target is not null")
    path = F.concat(F.lit("/tree/./links/v"), name(k), F.lit("/"), F.when(k % 3 == 0, "a/../b").when(k % 3 == 1, "..").otherwise("f"))
    return p.select("p_partkey", path.alias("path")), own


def link_targets(spark, sf_dir):
    """Where paths through links lead: chains, absolute and relative targets, '..' behind links, circles."""
    paths, own = _link_tables(spark, sf_dir)
    return paths.join(links.resolved(paths, own), "path").select("p_partkey", "path", "real")


def mac_libraries(spark, sf_dir):
    """Files whose libraries lie neither in the tree nor in the system, found through linked folders; report lines."""
    s = _t(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    text = lambda *cells: F.concat(*(c.cast("string") if isinstance(c, Column) else F.lit(c) for c in cells))
    files = s.select(text("lib/n", n, "/s", k, ".dylib").alias("path"), (k % 17 != 0).alias("inside"))
    other = (k * 7 + 3) % 90
    nation = _t(spark, sf_dir, "nation")
    own = nation.select(text("lib/cur", F.col("n_nationkey")).alias("path"), text("again/", F.col("n_nationkey")).alias("target")).union(
        nation.select(text("lib/again/", F.col("n_nationkey")).alias("path"), text("../n", F.col("n_nationkey")).alias("target")))
    needs = F.array(
        F.lit("/usr/lib/libc.dylib"), F.lit("/System/Library/F"), F.lit("/opt/x.dylib"), text("@loader_path/s", k, ".dylib"), text("@loader_path/../cur", n, "/s", other, ".dylib"), text("@executable_path/../lib/cur", n, "/s", k, ".dylib"), text("@rpath/s", other, ".dylib"))
    commands = s.select(text("lib/n", n, "/s", k, ".dylib").alias("path"), F.explode(F.array_append(F.transform(needs, lambda v: F.struct(F.lit("dependency").alias("kind"), v.alias("value"))), F.struct(F.lit("rpath").alias("kind"), F.lit("@loader_path/../cur3").alias("value")))).alias("c")).select("path", "c.kind", "c.value")
    return native.report(native.missing_mac(files, commands, links=own))


# ------------------------------------------------------------------------------------------------------ archives

ODD_FOLDERS = ["a", "a-b", ".hidden", "_under/a"]


def _document_tree(spark, sf_dir: str) -> DataFrame:
    """Documents as files with modes, in folders whose names sort unlike their strings."""
    k = F.col("doc_id")
    path = F.concat(_pick(ODD_FOLDERS, k), F.lit("/é"), k.cast("string"), F.lit(".txt"))
    mode = F.when(k % 2 == 0, F.lit(0o700)).otherwise(F.lit(0o640))
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return _t(spark, sf_dir, "documents").select(path.alias("path"), F.lit(False).alias("is_dir"), mode.alias("mode"), content.alias("content"), F.lit(None).cast("string").alias("link"))


def zip_listing(spark, sf_dir):
    """An archive of all documents, written twice to the same bytes though dealt to tasks unlike, and listed: order, modes, sizes, digests."""
    folder = _folder(spark)
    tree = _document_tree(spark, sf_dir)
    tasks = sinks.shares(tree)
    for name, n in (("many.zip", tasks), ("more.zip", 2 * tasks + 1)):
        sinks.write_zip(tree, f"{folder}/{name}", n)
    same = sinks.same_bytes(spark, f"{folder}/many.zip", f"{folder}/more.zip")
    rows = read_zip(spark, f"{folder}/many.zip", content=True)
    out = rows.select("ord", "path", "attributes", "length", F.sha2("content", 256).alias("digest"), (F.col("stamp") == "2026-01-01 00:00:00").alias("stamped"))
    return out.join(same, F.lit(True))  # one row


def _tars(tree: DataFrame, folder: str) -> list[str]:
    """Tar archives of (path, mode, content, link), one written by each task; a repeated task replaces its own."""

    def run(batches: Iterator) -> Iterator:
        import io
        import tarfile

        import pyarrow as pa
        from pyspark import TaskContext

        at = os.path.join(folder, f"{TaskContext.get().partitionId()}.tar")
        with tarfile.open(f"{at}.{os.getpid()}", "w") as archive:
            for batch in batches:
                for path, mode, data, link in zip(*(batch.column(k) for k in range(4)), strict=True):
                    info = tarfile.TarInfo(path.as_py())
                    info.mode = mode.as_py()
                    if link.as_py() is not None:
                        info.type, info.linkname = tarfile.SYMTYPE, link.as_py()
                        archive.addfile(info)
                    else:
                        info.size = len(data.as_py())
                        archive.addfile(info, io.BytesIO(data.as_py()))
        os.replace(f"{at}.{os.getpid()}", at)
        yield pa.RecordBatch.from_arrays([pa.array([at])], ["at"])

    return sorted(r.at for r in tree.select("path", "mode", "content", "link").mapInArrow(run, "at string").collect())  # one for each task


def tar_members(spark, sf_dir):
    """Members of archives made of all documents, links among them, read back by ranges."""
    k = F.col("doc_id")
    linked = _t(spark, sf_dir, "documents").where("doc_id % 9 = 0").select(F.concat(F.lit("links/l"), k.cast("string")).alias("path"), F.lit(False).alias("is_dir"), F.lit(0o644).alias("mode"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit("../a/"), k.cast("string")).alias("link"))
    paths = _tars(_document_tree(spark, sf_dir).unionByName(linked), _folder(spark))
    rows = trees.read_tar(spark, ",".join(paths))
    return rows.select("path", "mode", "length", F.sha2("content", 256).alias("digest"), "link")


def licence_texts(spark, sf_dir):
    """Licence texts of a source archive made of documents: a whole member, a block comment, a passage of line comments."""
    d = _t(spark, sf_dir, "documents").where("text is not null")
    number = F.col("doc_id").cast("string")
    body = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    comment = F.concat(F.lit("int x; /* \n "), F.col("doc_id").cast("string"), F.lit(" by "), F.sha2("text", 256), F.lit("\n*/ "), F.replace(body, F.lit("*/"), F.lit("")))
    passage = F.concat(F.lit("x\n// Copyright "), number, F.lit("\n//\n//  "), F.sha2("text", 256), F.lit("\n// SUCH DAMAGE.\n"), body)
    content = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, comment).otherwise(passage)
    path = F.concat(F.lit("k-1/"), number)
    tree = d.select(path.alias("path"), F.lit(0o644).alias("mode"), F.encode(content, "UTF-8").alias("content"), F.lit(None).cast("string").alias("link"))
    source = trees.read_tar(spark, ",".join(_tars(tree, _folder(spark))), filtered=True)
    out = package.licence_files(source, "k-1", {"LICENSE": "3"}, {"comment": "1"}, {"passage": "2"})
    return out.select("name", F.col("content").cast("string").alias("content"))


def tree_filtered(spark, sf_dir):
    """Documents written as a tree and read with contents where the path is of some folder: others' bytes are not read."""
    folder = _folder(spark)
    trees.write_tree(_document_tree(spark, sf_dir), folder)
    rows = trees.read_tree(spark, folder, content=True, filtered=True).where("parent = 'a-b' and not is_dir and mode = 416")
    return rows.select("path", F.sha2("content", 256).alias("digest"))


def requirement_lines(spark, sf_dir):
    """Pinned lines of suppliers taken for packages, with the target's digest or that for any target."""
    row = _t(spark, sf_dir, "supplier")
    own = F.struct(F.lit(pins.WINDOWS).alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.sha2("s_name", 256)).otherwise("").alias("digest"))
    other = F.struct(F.lit("any").alias("key"), F.sha2(F.col("s_nationkey").cast("string"), 256).alias("digest"))
    packages = row.select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("version"), F.explode(F.array(own, other)).alias("d"))
    return pins.requirement_rows(packages.select("name", "version", "d.*"), pins.WINDOWS)


def gunzip_capped(spark, sf_dir):
    """Documents packed by tasks and unpacked again under a cap: the length and digest, or that it was too much; some files are damaged."""

    def packed(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        for batch in batches:
            z = [gzip.compress(x.as_py(), 1, mtime=0) for x in batch.column(1)]
            z = [x[:9] if p.endswith("7") else x for p, x in zip(batch.column(0).to_pylist(), z, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["path", "content"])

    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    out = fetch.unpacked(d.mapInArrow(packed, "path string, content binary"), 5000)
    return out.select("path", "length", F.sha2("content", 256).alias("digest"), F.coalesce(F.contains("error", F.lit("more than pinned")), F.lit(False)).alias("too_much"))


def text_sinks(spark, sf_dir):
    """A checksum file of all documents, written by several tasks: its lines as they stand in it, and its own digest."""
    path = f"{_folder(spark)}/all.sha256"
    d = _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    sinks.write_checksums(d, path)
    own = sinks.digests(spark, [path]).select("digest")
    return spark.read.text(path).select(F.col("value").alias("line")).join(own, F.lit(True))  # one row


_QUERIES = [
    requirement_lines, gunzip_capped, text_sinks,
    running_cap_all, load_commands_one, state_carry_all, path_rank, record_rows, rule_table, trim_windows, trim_mac, clean_tree, event_ranges, link_targets, mac_libraries, zip_listing, tar_members, licence_texts,
    tree_filtered,
]
QUERIES = {f.__name__: f for f in _QUERIES}

_DOC_PATH = f"{_pick_sql(ODD_FOLDERS, 'doc_id')} || '/é' || doc_id || '.txt'"


def _runtime_sql(folders: list[str]) -> str:
    name = f"case when p_partkey % 1000 = 14 then 'python3.12' else {_pick_sql(HEADS, 'p_partkey // 100')} || p_partkey || {_pick_sql(TAILS, 'p_partkey // 10')} end"
    return f"select {_pick_sql(folders, 'p_partkey')} as folder, {name} as name from part"


ORACLES = {
    "requirement_lines": "select s_name as name, s_name || '==' || s_nationkey || ' --hash=sha256:' || sha256(case when s_suppkey % 2 = 0 then s_name else s_nationkey::varchar end) as line from supplier",
    "gunzip_capped": """with t as (select doc_id::varchar as path, coalesce(text, '') as text, doc_id % 10 = 7 as broken from documents)
        select path, case when not broken and strlen(text) <= 5000 then strlen(text)::bigint end as length, case when not broken and strlen(text) <= 5000 then sha256(text) end as digest, not broken and strlen(text) > 5000 as too_much from t""",
    "text_sinks": """with t as (select sha256(coalesce(text, '')) || '  doc-' || doc_id as line, 'doc-' || doc_id as name from documents)
        select line, (select sha256(string_agg(line || chr(10), '' order by name, line)) from t) as digest from t""",
    "running_cap_all": """with r as (select *, sum(l_quantity::bigint) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding)::bigint as running from lineitem)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, running, running <= 100000 as within from r""",
    "load_commands_one": """with t as (select l_orderkey * 10 + l_linenumber as line_no, max(l_partkey) as part, l_orderkey % 50 = 0 or l_linenumber = 7 as is_cmd from lineitem group by l_orderkey, l_linenumber),
        c as (select *, max(case when is_cmd then line_no end) over (order by line_no rows unbounded preceding) as cmd_no from t),
        k as (select c.*, x.part % 4 as cmd from c join t x on x.line_no = c.cmd_no)
        select 'all' as path, line_no, case when cmd = 1 then 'rpath' else 'dependency' end as kind, '/p' || part as value from k
        where not is_cmd and (cmd in (0, 3) and part % 3 = 0 or cmd = 1 and part % 3 <> 0)""",
    "state_carry_all": "select event_id, max(case when event_type = 'purchase' then event_id end) over (order by ts, event_id rows unbounded preceding) as last_purchase from events",
    "path_rank": "select page_id, row_number() over (order by string_split(url, '/'), page_id) as rank from pages",
    "record_rows": """select doc_id * 10 as line_no, case when doc_id % 3 = 0 then 'dir,' || doc_id || chr(10) || '"' || coalesce(lang, '') || '"' || chr(10) else 'plain/' || doc_id end as path, 3 as n,
        case when doc_id % 3 = 0 then '"dir,' || doc_id || chr(10) || '""' || coalesce(lang, '') || '""' || chr(10) || '",sha256=x,' || coalesce(n_chars, 0) else 'plain/' || doc_id || ',,' end as text from documents""",
    "rule_table": """with t as (select page_id, 'h' || page_id % 40 || '/' || regexp_replace(regexp_replace(string_split(regexp_replace(url, '^https?://', ''), '?')[1], '/$', ''), '^[^/]*/', '') as path from pages),
        r as (select s_suppkey as k, s_suppkey % 2 = 0 as tree, 'h' || s_suppkey % 40 as host from supplier),
        gone as (select t.page_id from t, r where
            k % 4 = 0 and (path = host || '/x/' || k or starts_with(path, host || '/x/' || k || '/'))
            or k % 4 = 1 and (path = k::varchar or ends_with(path, '/' || k))
            or k % 4 = 2 and regexp_matches(path, '^' || host || '/[^/]*/' || k % 10 || '[^/]*(/.*)?$')),
        kept as (select t.page_id from t, r where k % 4 = 3 and regexp_matches(path, '^h' || k % 3 || '/en/[^/]*' || k % 10 || '$')),
        scope as (select distinct t.page_id from t, r where k % 4 = 3 and starts_with(path, 'h' || k % 3 || '/en/'))
        select page_id, path from t where page_id not in (select page_id from gone) and (page_id not in (select page_id from scope) or page_id in (select page_id from kept))""",
    "trim_windows": f"""with t as ({_runtime_sql(WINDOWS_FOLDERS)})
        select folder || '/' || name as path, false as is_dir from t where folder not in ('include', 'libs', 'Scripts/sub', 'tcl', 'Lib/test', 'Lib/unittest/test', 'Lib/sqlite3/test/deep') and not ends_with(name, '.pdb')
            and not (folder = 'DLLs' and (name like '\\_test%.pyd' escape '\\' or name like 'tcl%.dll' or name like 'tk%.dll'))
        union all select 'Lib/site-packages', true""",
    "trim_mac": f"""with t as ({_runtime_sql(MAC_FOLDERS)})
        select folder || '/' || name as path, false as is_dir from t where folder not in ('include', 'share/man', 'lib/tcl8.6', 'lib/tk9', 'lib/itcl4', 'lib/python3.12/test', 'lib/python3.12/config-3.12-darwin', 'lib/python3.12/site-packages/old', 'bin/sub')
            and not (folder = 'bin' and name <> 'python3.12') and not (folder = 'lib' and (starts_with(name, 'libtcl') or regexp_matches(name, '^t(cl|k)[89]')))
            and not (folder = 'lib/python3.12/lib-dynload' and (starts_with(name, '_test') or starts_with(name, '_ctypes_test')))
        union all select 'lib/python3.12/site-packages', true""",
    "clean_tree": f"""with t as (select p_partkey as k, 'p' || p_partkey % 25 as package, p_partkey // 25 % {len(LEFTOVERS)} as kind, replace(replace({_pick_sql(LEFTOVERS, 'p_partkey // 25')}, '{{p}}', 'p' || p_partkey % 25), '{{k}}', p_partkey::varchar) as name from part)
        select '{SITE}/' || name as path, '' as content from t where kind in (0, 5, 7)
        union all select '{SITE}/' || package || '.dist-info/RECORD', coalesce(string_agg(case when kind = 7 then '"' || name || '"' else name end || ',sha256=' || k || ',' || chr(10), '' order by k) filter (kind in (0, 5, 7)), '') from t group by package""",
    "event_ranges": """with e as (select event_id, floor(value * 1000)::bigint as value from events),
        r as (select o_orderkey, (floor(o_totalprice * 7)::bigint % 400000 - 1000) as low, case when o_orderkey % 100 = 0 then 20000 else o_custkey % 7 end as width from orders),
        m as (select v.value, min(o_orderkey) as o_orderkey from (select distinct value from e) v join r on v.value >= low and v.value < low + width group by 1)
        select event_id, e.value, m.o_orderkey, e.value - r.low as "offset" from e left join m on m.value = e.value left join r on r.o_orderkey = m.o_orderkey""",
    "link_targets": """with recursive l as (select 'v' || p_partkey as name, case when p_partkey % 50 = 3 then 'v' || p_partkey + 1 when p_partkey % 50 = 4 then 'v' || p_partkey - 1 when p_partkey % 50 = 13 then '../../..'
            when p_partkey % 50 = 14 then 'v' || p_partkey - 2 || '/..' when p_partkey % 5 = 0 then '../real/' || p_partkey when p_partkey % 5 = 1 then './v' || p_partkey - 1 when p_partkey % 5 = 2 then '/tree/links//v' || p_partkey - 1 end as target, p_partkey as k from part),
        start as (select p_partkey, '/tree/./links/v' || p_partkey || '/' || case p_partkey % 3 when 0 then 'a/../b' when 1 then '..' else 'f' end as path from part),
        walk as (select p_partkey, path, []::varchar[] as done, list_filter(string_split(path, '/'), lambda x: x not in ('', '.')) as todo, 0 as hops from start
            union all
            select p_partkey, path,
                case when todo[1] = '..' then done[:-2] when l.target is null then list_append(done, todo[1]) when starts_with(l.target, '/') then [] else done end,
                case when todo[1] <> '..' and l.target is not null then list_concat(list_filter(string_split(l.target, '/'), lambda x: x not in ('', '.')), todo[2:]) else todo[2:] end,
                hops + case when todo[1] <> '..' and l.target is not null then 1 else 0 end
            from walk left join l on done = ['tree', 'links'] and l.name = todo[1] and l.target is not null where len(todo) > 0 and hops <= 40)
        select p_partkey, path, max(case when len(todo) = 0 and hops <= 40 then '/' || array_to_string(done, '/') end) as real from walk group by 1, 2""",
    "mac_libraries": """with f as (select s_suppkey as k, s_nationkey as n, s_suppkey % 17 <> 0 as inside, (s_suppkey * 7 + 3) % 90 as o from supplier),
        m as (select k, n, unnest([case when true then '/opt/x.dylib' end, case when not inside then '@loader_path/s' || k || '.dylib' end,
            case when not exists (select 1 from f g where g.k = f.o and g.n = f.n and g.inside) then '@loader_path/../cur' || n || '/s' || o || '.dylib' end,
            case when not inside then '@executable_path/../lib/cur' || n || '/s' || k || '.dylib' end,
            case when not exists (select 1 from f g where g.k = f.o and g.n = 3 and g.inside) then '@rpath/s' || o || '.dylib' end]) as d from f)
        select 'lib/n' || n || '/s' || k || '.dylib' as path, 'lib/n' || n || '/s' || k || '.dylib: ' || string_agg(d, ', ' order by d) as line from m where d is not null group by k, n""",
    "zip_listing": f"""select row_number() over (order by string_split({_DOC_PATH}, '/')) - 1 as ord, {_DOC_PATH} as path, ((case when doc_id % 2 = 0 then 493 else 420 end) | 32768)::bigint << 16 as attributes, strlen(coalesce(text, ''))::bigint as length,
        sha256(coalesce(text, '')) as digest, true as stamped, true as same from documents""",
    "tar_members": f"""select {_DOC_PATH} as path, case when doc_id % 2 = 0 then 448 else 416 end as mode, strlen(coalesce(text, ''))::bigint as length, sha256(coalesce(text, '')) as digest, null as link from documents
        union all select 'links/l' || doc_id, 420, 0, null, '../a/' || doc_id from documents where doc_id % 9 = 0""",
    "licence_texts": """select case doc_id when 3 then 'LICENSE' when 1 then 'comment' else 'passage' end as name,
        case doc_id when 3 then text when 1 then doc_id || ' by ' || sha256(text) || chr(10) else 'Copyright ' || doc_id || chr(10) || chr(10) || ' ' || sha256(text) || chr(10) || 'SUCH DAMAGE.' || chr(10) end as content from documents where doc_id in (1, 2, 3)""",
    "tree_filtered": f"select {_DOC_PATH} as path, sha256(coalesce(text, '')) as digest from documents where doc_id % 4 = 1",
}
