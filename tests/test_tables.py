"""Operators for groups, rules, ranges, links, archives and records of any size, against brute force and Python's own."""

import csv
import io
import os
import random
import re
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lodeworks import table_queries
from lodeworks.operators import intervals, links, pins, record, rule_tables, rules, scans, sequences
from lodeworks.plans import sinks
from lodeworks.sources import archives, fetch, records, trees

# --------------------------------------------------------------------------------------------------- scans


@pytest.mark.parametrize("seed", range(3))
def test_scans(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]) if seed else "a", k, r.choice([None, 1, 2, -5, 2**40]), r.choice([None, None, None, "s", "t"])) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, at int, n bigint, s string").repartition(5)
    out = {r.at: r for r in scans.running_total(df, ["g"], ["at"], F.col("n")).collect()}
    ranks = {r.at: r.rank for r in scans.rank(df, ["g"], ["at"]).collect()}
    held = {r.at: r.carried for r in scans.carry(df, ["g"], ["at"], F.col("s")).collect()}
    alone = {r.at: r.running for r in scans.running_total(df, [], ["at"], F.col("n")).collect()}
    total, last, number, every = {}, {}, {}, 0
    for g, k, n, s in rows:
        total[g] = total.get(g, 0) + (n or 0)
        number[g] = number.get(g, 0) + 1
        last[g] = s or last.get(g)
        every += n or 0
        assert (out[k].running, ranks[k], held[k], alone[k]) == (total[g], number[g], last.get(g), every)
    assert set(out[0].asDict()) == {"g", "at", "n", "s", "running"}


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "g string, at int, s string")
    assert scans.rank(df, ["g"], ["at"]).collect() == scans.carry(df, [], ["at"], F.col("s")).collect() == []


def test_one_listing_of_load_commands(spark):
    r = random.Random(4)
    say = lambda: r.choice(["cmd LC_LOAD_DYLIB", " name x (offset 1)", "path y (offset 2)", "cmd LC_RPATH", "cmdsize 9", "noise"])
    df = spark.createDataFrame([("p", k, say()) for k in range(2000)], "path string, line_no int, line string").repartition(7)
    assert sorted(sequences.load_commands(df, scans.carry).collect()) == sorted(sequences.load_commands(df).collect())


# --------------------------------------------------------------------------------------------------- rules


def test_rule_tables(spark):
    """The same paths go as by each rule's own pattern."""
    r = random.Random(2)
    names = ["a", "b", "a.c", "t[x", "_y", "z+", "bin"]
    paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 5))) for _ in range(400)})
    globs = ["a", "a/b", "**/a.c", "a/**/b", "*", "a/*", "**/_*", "b/?", "b/[ab]", "b/[!ab]*", "z+/**/a", "a.c/*/b", "**/bin", "x/y", "t[x"]
    for _ in range(12):
        table = [rules.Rule(g, tree=r.random() < 0.6) for g in r.sample(globs[:-1], r.randint(1, 5))] + [rules.Rule("a*", tree=False, keep="bin")] * (r.random() < 0.5)
        dirs = {p: r.random() < 0.3 for p in paths}
        tree = spark.createDataFrame([(p, d, "x") for p, d in dirs.items()] + [(None, None, "null")], "path string, is_dir boolean, rule_id string").repartition(3)
        got = {r.path for r in rule_tables.apply_table(tree, rule_tables.as_table(spark, table)).collect()}
        assert got == {r.path for r in rules.apply_rules(tree.where("path is not null"), table).collect()} | {None}, table


def test_rule_tables_have_one_plan_size(spark):
    tree = spark.createDataFrame([("a/b", False)], "path string, is_dir boolean")
    plan = lambda n: rule_tables.apply_table(tree, rule_tables.as_table(spark, [rules.Rule(f"d{k}/*") for k in range(n)]))._jdf.queryExecution().optimizedPlan().toString()
    operators = lambda text: re.findall(r"^[ :+-]*([A-Z]\w+)", text, re.M)
    assert operators(plan(3)) == operators(plan(1000))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_paths_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Whether there are few rules or many, and however small the tree's files are."""
    spark.range(3000).select(F.concat(F.lit("a/"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit(False).alias("is_dir")).write.parquet(str(tmp_path / "t"))
    tree, table = spark.read.parquet(str(tmp_path / "t")), rule_tables.as_table(spark, [rules.Rule("a/3"), rules.Rule("**/f8", tree=False), rules.Rule("a/*/f1*")])
    want = sorted(r.path for r in tree.collect() if not (r.path.startswith(("a/3/",)) or r.path.split("/")[2].startswith("f1") or r.path.endswith("/f8")))
    for small in (rule_tables.SMALL, -1):
        monkeypatch.setattr(rule_tables, "SMALL", small)
        out = rule_tables.apply_table(tree, table)
        assert "BuildLeft" not in physical(out) and ("BuildRight" in physical(out)) == (small > 0)
        assert sorted(r.path for r in out.collect()) == want


def broadcasts(df):
    """Rows of every broadcast of a run, by the plan that ran in the end."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if (name := node.nodeName()) == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if name == "BroadcastExchange":
                found.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return sorted(found)


@pytest.mark.parametrize("kind", ["list", "file"])
def test_removed_paths_are_never_broadcast(spark, tmp_path, monkeypatch, kind):
    """Nor where rules and tree lie in small files, whose sizes Spark multiplies to guess what is removed."""
    spark.range(3000).select(F.concat(F.lit("a/"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path")).write.parquet(str(tmp_path / "t"))
    table = rule_tables.as_table(spark, [rules.Rule("a/3"), rules.Rule("a/*/f1*")])
    if kind == "file":
        table.coalesce(1).write.parquet(str(tmp_path / "r"))
        table = spark.read.parquet(str(tmp_path / "r"))
    tree = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(r.path for r in tree.collect() if not (r.path.startswith("a/3/") or r.path.split("/")[2].startswith("f1")))
    for small in (rule_tables.SMALL, -1):
        monkeypatch.setattr(rule_tables, "SMALL", small)
        out = rule_tables.apply_table(tree, table)
        assert sorted(r.path for r in out.collect()) == want
        assert broadcasts(out) == ([2] if small > 0 else [])


@pytest.mark.parametrize(("query", "target"), [(table_queries.trim_mac, pins.MAC_ARM), (table_queries.trim_windows, pins.WINDOWS)])
def test_a_trimmed_runtime_broadcasts_no_row_but_rules(spark, query, target):
    """At any threshold, as run."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        out = query(spark, "/root/testdata/sf0.01")
        assert broadcasts(out) == [len(rules.trim_rules(target))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("query", [table_queries.trim_mac, table_queries.trim_windows])
def test_a_trimmed_runtime_broadcasts_its_rules(spark, query):
    plan = physical(query(spark, "/root/testdata/sf0.01"))
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_records_in_pieces_without_broadcasts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record, "ROWS", 3)
    r = random.Random(9)
    files = [f"d{r.randrange(9)}/" + r.choice(["x", "x,y", 'q"q', "é", "two\nlines"]) + str(k) for k in range(200)]
    held = {f"s/p{k}.dist-info/RECORD": [[f if r.random() < 0.7 else f + "-gone", "h", ""] for f in r.sample(files, 40)] + [[""], ["../up", "a\rb"]] for k in range(4)}
    text = {p: records.record_text(x for f in rows for x in (f, [])).encode() for p, rows in held.items()}  # with blank rows
    rows = [(p, False, c) for p, c in text.items()] + [("s/" + f, False, b"own") for f in files] + [("s", True, None), ("up", False, b"u"), (None, False, b"n"), ("s/empty.dist-info/RECORD", False, None), ("x/s/p.dist-info/RECORD", False, b"else,,\n")]
    spark.createDataFrame(rows, "path string, is_dir boolean, content binary").repartition(3).write.parquet(str(tmp_path / "t"))
    out = record.prune_records(spark.read.parquet(str(tmp_path / "t")), "s")
    there = {p for p, *_ in rows}
    want = {p: records.record_text(f for f in held[p] if os.path.normpath("s/" + f[0]) in there).encode() if p in held else b"" if p == "s/empty.dist-info/RECORD" else c for p, _, c in rows}
    assert {x.path: x.content and bytes(x.content) for x in out.collect()} == want and out.count() == len(rows)
    assert "Broadcast" not in physical(out)


# --------------------------------------------------------------------------------------------------- ranges


@pytest.mark.parametrize("seed", range(4))
def test_intervals(spark, seed):
    r = random.Random(seed)
    wide = 10 ** r.choice([1, 3, 12])
    ends = [(k, r.randint(-wide, wide), r.choice([0, 1, 2, wide // 3, 2 * wide, -4])) for k in range(80)]
    ranges = [(k, a, a + w, "r") for k, a, w in ends] + [(-1, None, 5, "r"), (-2, 1, None, "r")]
    ranges += [ranges[3]]
    r.shuffle(ranges)
    values = [r.randint(-2 * wide, 2 * wide) for _ in range(300)] + [a for _, a, _ in ends] + [a + w for _, a, w in ends] + [None, None]
    rows = spark.createDataFrame([(v, "x") for v in values], "v bigint, level string")
    table = spark.createDataFrame(ranges, "n int, low bigint, high bigint, name string")
    got = sorted(((r.v is None, r.v or 0, r.range and r.range.n) for r in intervals.first_match(rows, "v", table, "low", "high", ["n"]).collect()), key=str)
    want = sorted(((v is None, v or 0, min((n for n, a, b, _ in ranges if a is not None and b is not None and a <= v < b), default=None) if v is not None else None) for v in values), key=str)
    assert got == want
    plan = intervals.first_match(rows, "v", table, "low", "high", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_nothing(spark):
    rows, table = spark.createDataFrame([(1,)], "v bigint"), spark.createDataFrame([], "n int, low bigint, high bigint")
    assert intervals.first_match(rows, "v", table, "low", "high", ["n"]).first()["range"] is None
    assert intervals.first_match(rows.limit(0), "v", spark.createDataFrame([(1, 0, 9)], table.schema), "low", "high", ["n"]).collect() == []


# --------------------------------------------------------------------------------------------------- links


def test_links_lead_where_the_file_system_says(spark, tmp_path):
    r = random.Random(8)
    root = str(tmp_path / "r")
    folders = ["", *("/".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(12))]
    for f in folders:
        os.makedirs(os.path.join(root, f), exist_ok=True)
    made = []
    for k in range(40):
        at = os.path.join(root, r.choice(folders), f"l{k}")
        target = r.choice([r.choice("abc"), "../" * r.randint(1, 2) + r.choice("abc"), f"l{r.randrange(40)}", f"../l{r.randrange(40)}", os.path.join(root, r.choice(folders)), f"./{r.choice('abc')}//{r.choice('abc')}", "."])
        os.symlink(target, at)
        made.append((at, target))
    paths = []
    for _ in range(200):
        paths.append("/".join([root, *(r.choice(["a", "b", "c", "..", ".", "", *(f"l{k}" for k in range(40))]) for _ in range(r.randint(1, 5)))]))
    for at, _ in made:
        paths += [at, at + "/x", at + "/../y"]

    def real(path):
        try:
            return os.path.realpath(path, strict=False) if not circular(path) else None
        except OSError:
            return None

    def circular(path):
        try:
            os.stat(path)
        except OSError as e:
            return e.errno == 40  # too many levels of links
        return False

    def deepest(path):
        """Whether any leading part goes round in a circle."""
        parts = path.split("/")
        return any(circular("/".join(parts[:k])) for k in range(2, len(parts) + 1))

    out = {r.path: r.real for r in links.resolved(spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string"), spark.createDataFrame(made, "path string, target string")).collect()}
    assert set(out) == set(paths)
    for p in set(paths):
        if deepest(p):
            assert out[p] is None or out[p] == os.path.realpath(p), p
        else:
            assert out[p] == real(p), p


def test_links_in_a_tree_without_root(spark):
    own = spark.createDataFrame([("a/l", "../b"), ("m", "a/l/c"), ("out", "../x"), ("x/y", "y"), ("c1", "c2"), ("c2", "c1")], "path string, target string")
    want = {"a/l/f": "b/f", "m/g": "b/c/g", "out/f": None, "x/y/z": None, "c1": None, "a/l/../q": "q", "plain/p": "plain/p", "./a//b": "a/b", "a/../..": None}
    got = {r.path: r.real for r in links.resolved(spark.createDataFrame([(p,) for p in want], "path string"), own).collect()}
    assert got == want


# ------------------------------------------------------------------------------------------------- archives


def tree_of(spark, n=300):
    r = random.Random(1)
    rows = [("/".join(r.choice(["a", "a-b", ".h", "_u", "é中"]) for _ in range(r.randint(0, 3))) + f"/f{k}".lstrip("/" if k % 2 else ""), False, r.choice([0o600, 0o755, 0o4711]), r.randbytes(r.choice([0, 1, 5000]))) for k in range(n)]
    rows = [(p.lstrip("/"), d, m, c) for p, d, m, c in rows]
    return rows, spark.createDataFrame([*rows, ("a", True, 0o755, None)], "path string, is_dir boolean, mode int, content binary")


def test_archive_has_the_same_bytes_for_any_tasks(spark, tmp_path):
    rows, tree = tree_of(spark)
    held = []
    for k, (tasks, parts) in enumerate(((1, 1), (8, 5), (3, 9), (8, 2), (None, 4))):
        sinks.write_zip(tree.repartition(parts), str(tmp_path / f"{k}.zip"), tasks)
        held.append((tmp_path / f"{k}.zip").read_bytes())
    assert len(set(held)) == 1 and sorted(os.listdir(tmp_path)) == [f"{k}.zip" for k in range(5)]
    with zipfile.ZipFile(io.BytesIO(held[0])) as z:
        assert z.testzip() is None
        infos = z.infolist()
        assert [i.filename for i in infos] == [p for p, _ in sorted((p, p.split("/")) for p, *_ in rows)] or [i.filename.split("/") for i in infos] == sorted(p.split("/") for p, *_ in rows)
        content, mode = {p: c for p, _, _, c in rows}, {p: m for p, _, m, _ in rows}
        for i in infos:
            assert z.read(i) == content[i.filename] and i.date_time == sinks.STAMP and i.external_attr == (0o100000 | (0o755 if mode[i.filename] & 0o111 else 0o644)) << 16
    read = archives.read_zip(spark, str(tmp_path / "0.zip"), content=True)
    assert {r.path: bytes(r.content) for r in read.collect()} == content
    one = archives.read_zip(spark, str(tmp_path / "0.zip"), content=True, filtered=True).where(F.col("path") == rows[5][0])
    assert [bytes(r.content) for r in one.collect()] == [rows[5][3]]


def test_an_archive_s_tasks_grow_with_its_contents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHARE", 10_000)
    tree = tree_of(spark)[1]
    size = sum(len(x.content or b"") for x in tree.collect())
    assert sinks.shares(tree) > size // 10_000 > 8 and sinks.shares(tree.limit(0)) == 8
    asked = []
    write, dealt = sinks.write_entries, spark.sparkContext.defaultParallelism
    monkeypatch.setattr(sinks, "write_entries", lambda rows, path: (asked.append(rows.rdd.getNumPartitions()), write(rows, path)))
    monkeypatch.setattr(table_queries.sinks, "SHARE", 200_000)
    out = table_queries.zip_listing(spark, "/root/testdata/sf0.01")
    size = sum(x.length for x in out.select("length").collect())
    assert asked[0] > max(dealt, size // 200_000) and asked[1] > asked[0] and [x.same for x in out.select("same").distinct().collect()] == [True]


def test_files_are_compared_by_pieces(spark, tmp_path):
    held = {"a": b"x" * 1000, "b": b"x" * 1000, "c": b"x" * 999 + b"y", "d": b"x" * 1001, "e": b"", "f": b"x" * 900}
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    for one, other in (("a", "b"), ("a", "c"), ("a", "d"), ("d", "a"), ("a", "e"), ("e", "e"), ("f", "a")):
        assert sinks.same_bytes(spark, str(tmp_path / one), str(tmp_path / other), 100).collect() == [(held[one] == held[other],)]


def test_an_archive_s_partitions_are_slices(spark, tmp_path):
    """However many entries, a partition is three numbers; together they give each entry once, filtered or not."""
    rows, tree = tree_of(spark)
    sinks.write_zip(tree, str(tmp_path / "a.zip"))
    whole = archives.ZipReader({"path": str(tmp_path / "a.zip"), "bytes": "20000"})
    parts = whole.partitions()
    assert len(parts) > 5 and all(len(p.value) == 3 and all(isinstance(x, int) for x in p.value) for p in parts)
    found = [x for p in parts for x in whole.read(p)]
    assert [x[0] for x in found] == list(range(len(rows))) and sorted(x[1] for x in found) == sorted(p for p, *_ in rows)
    some = archives.ZipReader({"path": str(tmp_path / "a.zip"), "bytes": "20000", "filtered": "true"})
    some.pushFilters([ds.GreaterThan(("ord",), 57), ds.StringStartsWith(("path",), "a")])
    assert [x for p in some.partitions() for x in some.read(p)] == [x for x in found if x[0] > 57 and x[1].startswith("a")]


def test_archive_of_nothing_and_failed_writes(spark, tmp_path):
    tree = spark.createDataFrame([], "path string, is_dir boolean, mode int, content binary")
    sinks.write_zip(tree, str(tmp_path / "e.zip"))
    assert zipfile.ZipFile(tmp_path / "e.zip").namelist() == [] and archives.read_zip(spark, str(tmp_path / "e.zip")).collect() == []
    bad = spark.range(50).select(F.col("id").cast("string").alias("path"), F.lit(False).alias("is_dir"), F.lit(1).alias("mode"), F.when(F.col("id") < 40, F.lit(b"x")).otherwise(F.raise_error(F.lit("lost")).cast("binary")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_zip(bad, str(tmp_path / "bad.zip"), 4)
    assert os.listdir(tmp_path) == ["e.zip"]


def test_archive_end_of_large_ones():
    end = archives.end_record(70_000, 5_000_000, 6 << 30)
    f = io.BytesIO(b"")
    f.write(end)
    with pytest.raises(struct.error):
        archives.find_end(f)  # the 64-bit record stands where the locator says, far behind this file
    at = len(end) - 22 - 20
    assert end[at : at + 4] == archives.LOCATOR64 and struct.unpack_from("<Q", end, at + 8)[0] == (6 << 30) + 5_000_000
    far = archives.Entry(b"x", 0, 1, 1, 0, 5).central(5 << 30)
    f = io.BytesIO(far)
    assert next(archives.central_entries(f, 0, len(far)))[4] == (5 << 30) + 5
    many = archives.end_record(70_000, 100, 0)
    f = io.BytesIO(b"x" * 100 + many)
    assert archives.find_end(f) == (70_000, 100, 0)


class Counting(io.FileIO):
    seen = 0

    def read(self, n=-1):
        out = super().read(n)
        Counting.seen += len(out)
        return out


def test_one_member_reads_its_own_bytes(tmp_path, monkeypatch):
    at = str(tmp_path / "a.tar")
    with tarfile.open(at, "w") as archive:
        for k in range(50):
            info = tarfile.TarInfo(f"d/{k}")
            info.size = 100_000
            archive.addfile(info, io.BytesIO(bytes([k]) * 100_000))
    reader = trees.TarReader({"path": at, "filtered": "true", "bytes": "1000000"})
    assert len(trees.TarReader({"path": at, "bytes": "1000000"}).partitions()) == 5
    filters = [ds.EqualTo(("path",), "d/7")]
    assert list(reader.pushFilters(filters)) == filters
    parts = reader.partitions()
    monkeypatch.setattr("builtins.open", lambda path, mode: Counting(path, mode))
    Counting.seen = 0
    rows = [row for p in parts for row in reader.read(p)]
    assert [(r[0], r[4]) for r in rows] == [("d/7", bytes([7]) * 100_000)] and Counting.seen == 100_000


def test_tree_reads_what_filters_leave(tmp_path, monkeypatch):
    for k in range(20):
        (tmp_path / f"f{k}.{'txt' if k % 2 else 'bin'}").write_bytes(b"x" * 1000)
    reader = trees.TreeReader({"path": str(tmp_path), "content": "true", "filtered": "true"})
    reader.pushFilters([ds.EqualTo(("suffix",), ".txt"), ds.Not(ds.StringStartsWith(("name",), "f1")), ds.GreaterThan(("length",), 5), ds.IsNotNull(("path",))])
    opened = open
    monkeypatch.setattr("builtins.open", lambda path, mode: Counting(path, mode) if str(path).startswith(str(tmp_path)) else opened(path, mode))
    Counting.seen = 0
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert sorted(r[1] for r in rows) == ["f3.txt", "f5.txt", "f7.txt", "f9.txt"] and Counting.seen == 4000


def test_rows_stay_beneath_their_root(spark, tmp_path):
    for path in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(Exception, match="leave the folder"):
            trees.write_tree(spark.createDataFrame([(path, False, 0o644, b"", None)], "path string, is_dir boolean, mode int, content binary, link string"), str(tmp_path / "r"))


# -------------------------------------------------------------------------------------------------- records


def test_records_as_the_csv_module_reads_them(spark):
    r = random.Random(6)
    cell = lambda: r.choice(["", "a", "b c", 'say "x"', "two\nlines", "c,d", '""', "é", "\n", "x\n\ny"])
    texts, lines = {}, []
    for name in ("one", "two", "three"):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        for _ in range(150):
            w.writerow([cell() for _ in range(r.randint(1, 4))])
            if r.random() < 0.2:
                out.write("\n")
        texts[name] = out.getvalue()
        lines += [(name, k, x) for k, x in enumerate(texts[name].split("\n"))]
    df = spark.createDataFrame(lines, "record string, line_no bigint, line string").repartition(6)
    rows = records.read_records(df)
    got = {}
    for row in rows.withColumn("text", records.row_text(F.col("fields"))).orderBy("record", "line_no").collect():
        got.setdefault(row.record, []).append(row)
    for name, text in texts.items():
        want = [x for _, x in records.parse_record(text) if x != [""]]  # a lone empty field is written as two quotes
        have = [list(row.fields) for row in got[name] if list(row.fields) != [""]]
        assert have == want
        assert "".join(row.text + "\n" for row in got[name] if list(row.fields) != [""]) == records.record_text(want)


# ---------------------------------------------------------------------------------------------- acquisition


def test_attempts_follow_the_relational_rule(spark):
    """fetch.following goes through attempts as first_outcome does over a table of them."""
    r = random.Random(3)
    rows, want = [], {}
    for key in range(60):
        plan = [[r.choice([sequences.OK, sequences.MISMATCH, sequences.ERROR, sequences.ERROR]) for _ in range(3)] for _ in range(r.randint(1, 4))]
        rows += [(key, s, k, o, f"{s}.{k}") for s, tries in enumerate(plan) for k, o in enumerate(tries)]
        at, told = fetch.Attempt(), []
        while at.source < len(plan) and plan[at.source][at.nth] != sequences.OK:
            told.append(f"{at.source}.{at.nth}")
            at = fetch.following(at, plan[at.source][at.nth], 3)
        want[key] = ("ok", at.source, at.nth, told) if at.source < len(plan) else ("failed", None, None, told)
    df = spark.createDataFrame(rows, "key int, source int, attempt int, outcome string, message string")
    got = {r.key: (r.status, r.source, r.attempt, r.failures) for r in sequences.first_outcome(df, "key", 3).collect()}
    assert got == want


def test_a_failed_call_tells_its_own_failures_only(tmp_path):
    def opener(url):
        return io.BytesIO(url.encode())

    f = fetch.Fetcher(tries=1, opener=opener)
    for url in ("one", "two"):
        with pytest.raises(fetch.Failed, match=f"^{url}: not the pinned digest$"):
            f.fetch(url, str(tmp_path / "f"), "0" * 64)
    assert os.listdir(tmp_path) == []
