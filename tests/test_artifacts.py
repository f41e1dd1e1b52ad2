"""Artifact operators on golden cases written for this library."""

import gzip
import hashlib
import io
import json
import os
import stat
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lodeworks import catalog
from lodeworks.functions import paths
from lodeworks.operators import native, pins, record, rules, sequences, sets
from lodeworks.plans import dependencies, package, sinks
from lodeworks.sources.fetch import Failed, Fetcher, Mismatch
from lodeworks.sources.pins import read_pins
from lodeworks.sources.records import read_record, record_text
from lodeworks.sources.trees import read_tar, read_tree

HEX = "0123456789abcdef" * 4


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def portable_executable(imports: list[str], delayed: list[str], wide: bool = True) -> bytes:
    """A small portable executable with one section that imports the given names."""
    header, optional, directories = 0x80, 240 if wide else 224, 112 if wide else 96
    table = header + 24 + optional
    raw, address = 0x400, 0x1000
    body = bytearray()

    def put(data: bytes) -> int:
        at = len(body)
        body.extend(data)
        return address + at

    names = {n: put(n.encode() + b"\0") for n in dict.fromkeys([*imports, *delayed])}
    first = put(b"".join(struct.pack("<IIIII", 1, 0, 0, names[n], 1) for n in imports) + bytes(20)) if imports else 0
    second = put(b"".join(struct.pack("<IIIIIIII", 1, names[n], 0, 0, 0, 0, 0, 0) for n in delayed) + bytes(32)) if delayed else 0
    out = bytearray(raw)
    out[:2] = b"MZ"
    struct.pack_into("<I", out, 0x3C, header)
    out[header : header + 4] = b"PE\0\0"
    struct.pack_into("<HH12xHH", out, header + 4, 0x8664, 1, optional, 0)
    struct.pack_into("<H", out, header + 24, 0x20B if wide else 0x10B)
    for number, at in ((1, first), (13, second)):
        struct.pack_into("<II", out, header + 24 + directories + 8 * number, at, 0)
    struct.pack_into("<8sIIII", out, table, b".data", len(body), address, len(body), raw)
    return bytes(out + body)


# ------------------------------------------------------------------------------------------------ functions


def test_paths(spark):
    names = ["a/b.txt", "b.tar.gz", ".hidden", "d/.x.y", "noext", "d/trailing."]
    assert column(spark, names, paths.suffix) == [".txt", ".gz", "", ".y", "", ""]
    assert column(spark, names, paths.name)[0] == "b.txt" and column(spark, names, paths.parent) == ["a", "", "", "d", "", "d"]
    odd = ["a/../b", "/a/../../b", "a//b/./c", "..", "../x/..", "", "/", "./", "a/b/../../..", "/.."]
    assert column(spark, odd, paths.normalized) == [os.path.normpath(x) for x in odd]
    order = ["a-b", "a/b", "a", "a/b/c", "B"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in order], "x string").orderBy(paths.components(F.col("x"))).collect()]
    assert got == sorted(order, key=lambda x: x.split("/")) and got != sorted(order)


def test_text(spark):
    texts = ["\t a \n", "\x0b\x1cb\x85\xa0", "plain", "", " c　"]
    assert column(spark, texts, paths.stripped) == [x.strip() for x in texts]
    texts = ["a\nb", "a\r\nb\n", "x\x0by\x1cz\x85w v", "one", "a\n\nb"]
    assert column(spark, texts, paths.lines) == [x.splitlines() for x in texts]
    data = bytes(range(250, 256)) + b"\x01\x02"
    assert column(spark, [data], lambda c: paths.uint_le(c, F.lit(1), 4), "binary") == [int.from_bytes(data[1:5], "little")]
    assert column(spark, ["", "v", None], paths.present) == [None, "v", None]


@pytest.mark.parametrize("glob, yes, no", [("*.py", ["a.py"], ["d/a.py"]), ("**/*.py", ["a.py", "d/e/a.py"], ["a.pyc"]), ("t[89]*", ["t8x", "t9"], ["t7"]), ("a.b", ["a.b"], ["axb"]), ("n/**/tests", ["n/tests", "n/a/b/tests"], ["tests"])])
def test_globs(spark, glob, yes, no):
    match = lambda values: column(spark, values, lambda c: c.rlike(paths.glob_pattern(glob)))
    assert all(match(yes)) and not any(match(no))


# ------------------------------------------------------------------------------------------------------ pins


def pins_document():
    files = {t: {"url": f"https://x/{t}/20260101/cpython-3.12.9%2B{t}.tar.gz", "bytes": 10, "sha256": HEX} for t in pins.TARGETS}
    return {
        "format_version": 1,
        "python": {"version": "3.12.9", "release": "20260101", "targets": files},
        "packages": {"zeta": {"version": "2.0", "sha256": {"any": HEX}}, "alpha": {"version": "1.5", "sha256": {pins.WINDOWS: "f" * 64, "any": ""}}},
        "library": {"version": "1", "url": "https://x/lib", "sha256": HEX, "max_order": 12},
        "build_tools": [f"tool==1.0 --hash=sha256:{HEX}"],
        "model": {"name": "m", "url": "https://b/m", "download_urls": ["https://a/m.gz", "https://b/m"], "gzip_bytes": 5, "gzip_sha256": HEX, "bytes": 9, "sha256": HEX, "alphabet": "ab ", "source": "s", "permission": "p"},
    }


@pytest.fixture()
def document(spark, tmp_path):
    def read(change=lambda d: None):
        d = pins_document()
        change(d)
        path = tmp_path / f"pins{len(os.listdir(tmp_path))}.json"
        path.write_text(json.dumps(d, indent=1))
        return read_pins(spark, str(path), native="library")

    return read


def test_requirements(document):
    assert [r.line for r in pins.requirements(document(), pins.WINDOWS).collect()] == [f"alpha==1.5 --hash=sha256:{'f' * 64}", f"zeta==2.0 --hash=sha256:{HEX}"]
    with pytest.raises(Exception, match="No pinned alpha"):
        pins.requirements(document(), pins.MAC_ARM).collect()  # '' counts as missing


def test_violations(document):
    broken = lambda change=lambda d: None: {r.rule for r in pins.violations(document(change), "https://a/", ["alpha", "zeta"]).collect()}
    assert broken(lambda d: d["packages"]["alpha"]["sha256"].update(any=HEX)) == set()
    assert "I3" in broken()
    assert "I1" in broken(lambda d: d["python"]["targets"].pop(pins.MAC_ARM))
    assert "I2" in broken(lambda d: d["python"].update(release="other"))
    assert "I4" in broken(lambda d: d["packages"].pop("zeta"))
    assert "I5" in broken(lambda d: d.update(build_tools=["Tool==1"]))
    assert "I6" in broken(lambda d: d["library"].update(max_order=6))
    assert "I7" in broken(lambda d: d["model"].update(download_urls=["https://other/m.gz", "https://b/m"]))
    assert "I8" in broken(lambda d: d["model"].update(alphabet="aab "))
    assert "I10" in broken(lambda d: d["python"].update(version="3.11.1"))


def test_targets(spark, document):
    hosts = spark.createDataFrame([("Windows", "AMD64"), ("Darwin", "arm64"), ("Darwin", "x86_64"), ("Windows", "ARM64"), ("Linux", "x86_64"), ("windows", "amd64")], "s string, m string")
    assert [r[0] for r in hosts.select(pins.host_target(F.col("s"), F.col("m"), strict=False)).collect()] == [pins.WINDOWS, pins.MAC_ARM, pins.MAC_INTEL, None, None, None]
    with pytest.raises(Exception, match="No runtime for Linux"):
        hosts.where("s = 'Linux'").select(pins.host_target(F.col("s"), F.col("m"))).collect()
    assert pins.python_pin(document(), pins.MAC_ARM).first().bytes == 10
    with pytest.raises(Exception, match="not pinned"):
        pins.python_pin(document(), "riscv").collect()


# ----------------------------------------------------------------------------------------------------- trees


def grow(root, names):
    for n in names:
        path = root / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")


def test_tree_lists_everything(spark, tmp_path):
    grow(tmp_path, ["_hid.pyd", "a/_x.so", ".dylibs/x.dylib", "__pycache__/z.pyc", "plain"])
    os.symlink("plain", tmp_path / "link")
    os.symlink("/etc/hostname", tmp_path / "outside")
    os.chmod(tmp_path / "plain", 0o755)
    rows = {r.path: r for r in read_tree(spark, str(tmp_path), content=True).collect()}
    assert set(rows) == {"_hid.pyd", "a", "a/_x.so", ".dylibs", ".dylibs/x.dylib", "__pycache__", "__pycache__/z.pyc", "plain", "link", "outside"}
    assert rows["a"].is_dir and rows["link"].is_symlink and rows["link"].inside and not rows["outside"].inside
    assert rows["plain"].mode == 0o755 and rows["plain"].content == b"x" and rows["a/_x.so"].parent == "a" and rows[".dylibs"].suffix == ""


def kept(spark, names, table):
    df = spark.createDataFrame([(n,) for n in names], "path string")
    return sorted(r.path for r in rules.apply_rules(df, table).collect())


def test_trim(spark):
    stay = ["python.exe", "python312.dll", "Lib/os.py", "Lib/testing.py", "DLLs/_ssl.pyd"]
    go = ["Lib/test/a.py", "Lib/unittest/test/b.py", "include/c.h", "tcl/init.tcl", "pythonw.exe", "DLLs/_tkinter.pyd", "DLLs/tcl86t.dll", "DLLs/_testcapi.pyd", "DLLs/_ctypes_test.pyd", "DLLs/x.pdb", "y.pdb", "Lib/site-packages/p.py"]
    assert kept(spark, stay + go, rules.trim_rules(pins.WINDOWS)) == sorted(stay)
    stay = ["bin/python3.12", "lib/python3.12/os.py", "lib/python3.12/lib-dynload/_ssl.so"]
    go = ["bin/python3", "bin/pip", "share/man/x", "lib/tcl9.0/init.tcl", "lib/libtk8.dylib", "lib/libpython3.12.dylib", "lib/python3.12/lib-dynload/_tkinter.so", "lib/python3.12/test/x.py", "lib/itcl4/a", "lib/pkgconfig/z"]
    assert kept(spark, stay + go, rules.trim_rules(pins.MAC_ARM)) == sorted(stay)


def test_clean(spark):
    stay = ["s/numpy/core.py", "s/pkg/bin/x", "s/a.dist-info/RECORD", "s/sub/x.whl", "s/n.py"]
    go = ["s/x.exp", "s/y.whl", "s/.lock", "s/deep/z.lib", "s/numpy/a/tests/t.py", "s/numpy/tests/t.py", "s/bin/f", "s/a.dist-info/direct_url.json", "x/__pycache__/a.pyc", "__pycache__/b.pyc"]
    assert kept(spark, stay + go, rules.clean_rules("s")) == sorted(stay)


def test_record(spark):
    text = 'pkg/a.py,sha256=1,3\n\n"pkg/b,c.py",sha256=2,4\n../../bin/tool,,\npkg/gone.py,,\n../../bin/left,,\na.dist-info/RECORD,,\n'
    tree = spark.createDataFrame([("site/x/pkg/a.py",), ("site/x/pkg/b,c.py",), ("bin/left",), ("site/x/a.dist-info/RECORD",)], "path string")
    rows = record.prune(read_record(spark, text), tree, "site/x").collect()
    assert record_text(r.fields for r in rows) == 'pkg/a.py,sha256=1,3\n"pkg/b,c.py",sha256=2,4\n../../bin/left,,\na.dist-info/RECORD,,\n'


def test_record_normalizes_once(spark, sf_dir):
    """Sorts and joins compare paths that are worked out already; repeated rows and files in the tree change nothing."""
    rows = spark.range(40).select(F.col("id").alias("line_no"), F.concat(F.lit("../parts/./"), (F.col("id") % 7).cast("string")).alias("path"))
    rows = rows.union(spark.createDataFrame([(90, None), (91, "../parts/x/../2"), (91, "../parts/x/../2"), (92, "../../../y")], "line_no bigint, path string"))
    tree = spark.createDataFrame([("lib/parts/2",), ("lib/parts/2",), ("lib/parts/5",), (None,)], "path string")
    out = record.still_there(rows, tree, "lib/site")
    want = [(k, f"../parts/./{k % 7}") for k in range(40) if k % 7 in (2, 5)] + [(91, "../parts/x/../2")] * 2
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = catalog.QUERIES["record_prune"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    steps = [x for x in plan if "Sort [" in x or "Join [" in x or "Exchange " in x]
    assert len(steps) > 6 and not [x for x in steps if "aggregate(" in x or "split(" in x]



def test_tar(spark, tmp_path):
    def archive(name, member):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            info = tarfile.TarInfo(member)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
        return str(tmp_path / name)

    assert [(r.path, r.content) for r in read_tar(spark, archive("a.tgz", "d/f")).collect()] == [("d/f", b"abc")]
    for bad in ("../f", "/f", "d/../../f"):
        with pytest.raises(Exception, match="would leave"):
            read_tar(spark, archive("b.tgz", bad)).collect()


# ------------------------------------------------------------------------------------------------- sequences

LISTING = """
Load command 1
      cmd LC_LOAD_DYLIB
  cmdsize 48
     name /usr/lib/libz.1.dylib (offset 24)
      cmd LC_ID_DYLIB
     name @rpath/self.dylib (offset 24)
      cmd LC_RPATH
  cmdsize 40
     path @loader_path/../lib (offset 12)
      cmd LC_LAZY_LOAD_DYLIB
     name /opt/a (offset 1)/b.dylib (offset 24)
      cmd LC_SEGMENT_64
     name ignored
"""


def test_load_commands(spark):
    text = spark.createDataFrame([("f", k, x) for k, x in enumerate(LISTING.split("\n"))], "path string, line_no int, line string")
    rows = [(r.kind, r.value) for r in sequences.load_commands(text).orderBy("line_no").collect()]
    assert rows == [("dependency", "/usr/lib/libz.1.dylib"), ("rpath", "@loader_path/../lib"), ("dependency", "/opt/a (offset 1)/b.dylib")]


def test_markers(spark):
    text = "int x;\n/* first\n note */ /* second */"
    assert column(spark, [text], sequences.block_comment) == ["first\n note"]
    with pytest.raises(Exception, match="no block comment"):
        column(spark, ["none"], sequences.block_comment)
    text = "a\n// Copyright me\n//\n//  two\n// SUCH DAMAGE. end\n// more"
    assert column(spark, [text], sequences.comment_block) == ["Copyright me\n\n two\nSUCH DAMAGE. end"]


def test_first_outcome(spark):
    rows = [("a", 0, 0, "error", "e0"), ("a", 0, 1, "error", "e1"), ("a", 1, 0, "mismatch", "m"), ("a", 1, 1, "ok", ""), ("a", 2, 0, "error", "e2"), ("a", 2, 1, "ok", ""), ("b", 0, 0, "error", "x"), ("b", 0, 1, "error", "y"), ("b", 0, 2, "ok", ""), ("c", 0, 0, "ok", ""), ("c", 1, 0, "error", "z")]
    out = {r.k: (r.status, r.source, r.attempt, r.failures) for r in sequences.first_outcome(spark.createDataFrame(rows, "k string, source int, attempt int, outcome string, message string"), "k", 2).collect()}
    assert out == {"a": ("ok", 2, 1, ["e0", "e1", "m", "e2"]), "b": ("failed", None, None, ["x", "y"]), "c": ("ok", 0, 0, [])}


def test_running_cap(spark):
    out = sequences.running_cap(spark.createDataFrame([("a", k, 4) for k in range(4)], "k string, i int, n int"), ["k"], ["i"], F.col("n"), 9)
    assert [(r.running, r.within) for r in out.orderBy("i").collect()] == [(4, True), (8, True), (12, False), (16, False)]


# ---------------------------------------------------------------------------------------------------- native


@pytest.mark.parametrize("wide", [True, False])
def test_portable_executable(spark, wide):
    good = portable_executable(["KERNEL32.dll", "My.DLL", "my.dll"], ["late.dll"], wide)
    bad = bytearray(good)
    at = 0x80 + 24 + (112 if wide else 96) + 8
    bad[at : at + 4] = (0x99999).to_bytes(4, "little")
    files = spark.createDataFrame([("good", bytes(good)), ("text", b"not a program"), ("empty", b""), ("stub", b"MZ" + bytes(100)), ("bad", bytes(bad)), ("cut", bytes(good[:200]))], "path string, content binary")
    rows = native.pe_imports(files).collect()
    assert [r.dll for r in sorted((r for r in rows if r.path == "good"), key=lambda r: r.ord)] == ["kernel32.dll", "my.dll", "my.dll", "late.dll"]
    assert {r.path for r in rows if r.error} == {"bad", "cut"} and "no section" in next(r.error for r in rows if r.path == "bad")
    assert not [r for r in rows if r.path in ("text", "empty", "stub")]


def test_windows_gate(spark, tmp_path):
    exe = portable_executable
    place = {"python.exe": exe(["python.dll", "KERNEL32.dll"], []), "python.dll": exe(["api-ms-win-crt-x.dll"], []), "DLLs/_ssl.pyd": exe(["libssl.dll", "python.dll"], []), "DLLs/libssl.dll": exe([], []), "Lib/site/a.pyd": exe(["libssl.dll", "vendored.dll"], ["ext-ms-y.dll"]), "Lib/site/n.libs/Vendored.dll": exe([], []), "Lib/readme.txt": b"x"}
    for name, data in place.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    problems = dependencies.windows_problems(spark, str(tmp_path))
    assert [(r.path, r.missing) for r in problems.collect()] == [("Lib/site/a.pyd", ["libssl.dll"])]
    with pytest.raises(RuntimeError, match="Lib/site/a.pyd: libssl.dll"):
        native.gate(problems)
    native.gate(problems.where("path = ''"))


def test_mac_gate(spark, tmp_path):
    grow(tmp_path, ["bin/python3.12", "lib/libz.dylib", "lib/app/x.so"])
    (tmp_path / "lib/app/x.so").write_bytes(bytes.fromhex("cffaedfe") + b"rest")
    wants = ["/usr/lib/libc.dylib", "/System/Library/F", "@loader_path/../libz.dylib", "@executable_path/../lib/libz.dylib", "@rpath/libz.dylib", "@rpath/none.dylib", "@loader_path/../../../out.dylib", "/opt/abs.dylib", "bare.dylib"]
    lines = [x for w in wants for x in ("cmd LC_LOAD_DYLIB", f"name {w} (offset 24)")] + ["cmd LC_RPATH", "path @loader_path/.. (offset 12)", "cmd LC_RPATH", "path /abs (offset 12)"]
    commands = spark.createDataFrame([("lib/app/x.so", k, x) for k, x in enumerate(lines)] + [("bin/python3.12", 0, "cmd LC_LOAD_DYLIB"), ("bin/python3.12", 1, "name nowhere (offset 1)")], "path string, line_no int, line string")
    out = dependencies.mac_problems(spark, str(tmp_path), commands).collect()
    assert [(r.path, r.missing) for r in out] == [("lib/app/x.so", ["/opt/abs.dylib", "@loader_path/../../../out.dylib", "@rpath/none.dylib", "bare.dylib"])]


# ----------------------------------------------------------------------------------------------------- sinks


def test_zip(spark, tmp_path):
    tree = tmp_path / "t"
    grow(tree, ["a/b", "a-b", "z", "a/b2/c"])
    os.chmod(tree / "z", 0o700)
    made = []
    for name in ("one.zip", "two.zip"):
        sinks.write_zip(read_tree(spark, str(tree), content=True), str(tmp_path / name))
        made.append((tmp_path / name).read_bytes())
    assert made[0] == made[1]
    with zipfile.ZipFile(tmp_path / "one.zip") as z:
        assert z.namelist() == ["a/b", "a/b2/c", "a-b", "z"]
        assert {i.filename: stat.filemode(i.external_attr >> 16) for i in z.infolist()} == {"a/b": "-rw-r--r--", "a/b2/c": "-rw-r--r--", "a-b": "-rw-r--r--", "z": "-rwxr-xr-x"}
        assert {i.date_time for i in z.infolist()} == {sinks.STAMP}
    digest = sinks.write_checksum(str(tmp_path / "one.zip"))
    assert (tmp_path / "one.zip.sha256").read_text() == f"{digest}  one.zip\n" and digest == hashlib.sha256(made[0]).hexdigest()


def test_manifest_and_notices(spark, document):
    text = sinks.manifest(document(), pins.MAC_ARM, {"python": "python.version", "alpha": "packages.alpha.version"})
    assert text.endswith("}\n") and list(json.loads(text)) == ["format_version", "target", "python", "model", "model_alphabet", "versions"]
    assert json.loads(text)["versions"] == {"python": "3.12.9", "alpha": "1.5"} and json.loads(text)["python"] == "bin/python3.12"
    table = spark.createDataFrame([(1, "b", "2", "MIT", "u"), (0, "a", "1", "BSD", "v")], "rank int, component string, version string, licence string, source string")
    assert sinks.notice_table(table).split("\n")[2:4] == ["| a | 1 | BSD | v |", "| b | 2 | MIT | u |"]


# ----------------------------------------------------------------------------------------------- acquisition


class Web:
    """Sources by address: bytes, an exception, or a list of these for one call after another."""

    def __init__(self, **pages):
        self.pages, self.calls = pages, []

    def __call__(self, url):
        self.calls.append(url)
        page = self.pages[url]
        page = page.pop(0) if isinstance(page, list) else page
        if isinstance(page, Exception):
            raise page
        return io.BytesIO(page)


GOOD = b"payload" * 1000
DIGEST = hashlib.sha256(GOOD).hexdigest()


def fetcher(web):
    pauses = []
    return Fetcher(tries=3, pause_s=2, opener=web, pause=pauses.append), pauses


def test_fetch_falls_back_and_keeps(tmp_path):
    web = Web(gone=OSError("404"), forged=b"forged", good=GOOD)
    f, pauses = fetcher(web)
    path = f.fetch(["gone", "forged", "good"], str(tmp_path / "f"), DIGEST)
    assert open(path, "rb").read() == GOOD and web.calls == ["gone"] * 3 + ["forged", "good"] and pauses == [2, 4]
    f.fetch(["gone"], path, DIGEST)
    assert len(web.calls) == 5 and os.listdir(tmp_path) == ["f"]


def test_fetch_retries_cut_streams(tmp_path):
    web = Web(a=[GOOD[:10], OSError("reset"), GOOD])
    f, pauses = fetcher(web)
    f.fetch("a", str(tmp_path / "f"), DIGEST, len(GOOD))
    assert pauses == [2, 4] and "10 bytes of" in f.log[0]


def test_fetch_without_size_takes_short_for_wrong(tmp_path):
    web = Web(a=GOOD[:10])
    f, _ = fetcher(web)
    with pytest.raises(Failed, match="not the pinned digest"):
        f.fetch("a", str(tmp_path / "f"), DIGEST)
    assert web.calls == ["a"] and os.listdir(tmp_path) == []


def test_fetch_stops_beyond_size(tmp_path):
    f, _ = fetcher(Web(a=GOOD + b"x"))
    with pytest.raises(Failed, match="larger than pinned"):
        f.fetch("a", str(tmp_path / "f"), DIGEST, len(GOOD))


def packed_pin(**change):
    z = gzip.compress(GOOD, mtime=0)
    return {"name": "m", "download_urls": ["a"], "gzip_sha256": hashlib.sha256(z).hexdigest(), "gzip_bytes": len(z), "bytes": len(GOOD), "sha256": DIGEST} | change, z


def test_fetch_packed(tmp_path):
    pin, z = packed_pin()
    work = tmp_path / "w"
    work.mkdir()
    web = Web(a=z)
    f, _ = fetcher(web)
    for _ in range(2):
        f.fetch_packed(pin, str(work), str(tmp_path / "out"))
        assert (tmp_path / "out").read_bytes() == GOOD and os.listdir(work) == ["m"]
    assert web.calls == ["a"]


@pytest.mark.parametrize("change, message", [({"bytes": 100}, "more than pinned"), ({"sha256": "0" * 64}, "not the pinned digest")])
def test_fetch_packed_checks(tmp_path, change, message):
    pin, z = packed_pin(**change)
    with pytest.raises(Mismatch, match=message):
        fetcher(Web(a=z))[0].fetch_packed(pin, str(tmp_path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_carry_stream(spark, tmp_path):
    from lodeworks.streaming.carry import carry_stream

    folder, where = tmp_path / "in", str(tmp_path / "check")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, None)], "k string, i int, v string").coalesce(1).write.parquet(str(folder))
    rows = spark.readStream.schema("k string, i int, v string").parquet(str(folder))
    query = carry_stream(rows, "k", "i", "v").writeStream.format("memory").queryName("carried").option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.k, r.i, r.carried) for r in spark.table("carried").collect()} == {("a", 1, "x"), ("a", 2, "x"), ("b", 1, None)}


# ------------------------------------------------------------------------------------------- beyond the queries


def test_ranges(spark):
    """Equal rows and misses stay; an address in no section is an error that names it."""
    sections = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(c).alias("raw")) for a, b, c in ((0, 10, 100), (5, 20, 200))))
    rows = spark.createDataFrame([(3,), (3,), (7,), (12,), (30,)], "v long")
    assert [r[0] for r in rows.select(sets.first_range(F.col("v"), sections)["raw"]).collect()] == [100, 100, 100, 200, None]
    assert [r[0] for r in rows.where("v < 20").select(sets.file_offset(F.col("v"), sections)).collect()] == [103, 103, 107, 207]
    with pytest.raises(Exception, match="0x1e lies in no section"):
        rows.select(sets.file_offset(F.col("v"), sections)).collect()


def test_only(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "n string, v int")
    assert sets.only(rows.where("v = 2"), "n").collect() == [("a", 2)]
    for some, listed in ((rows, "found 2: a, b"), (rows.where("v = 3"), "found 0")):
        with pytest.raises(Exception, match=listed):
            sets.only(some, "n", "wheel").collect()


def test_markers_missing(spark):
    with pytest.raises(Exception, match="no block comment"):
        column(spark, ["none"], sequences.block_comment)
    for text in ("// Copyright x\n", "SUCH DAMAGE.", ""):
        with pytest.raises(Exception, match="no passage"):
            column(spark, [text], sequences.comment_block)


def test_hosts():
    import platform

    assert pins.host("Windows", "AMD64") == ("Windows", "AMD64") and pins.host("", "") == pins.host() == (platform.system(), platform.machine())


def test_linked_folders(spark, tmp_path):
    """Links to folders are followed under their own names, never round in circles; what lies outside is not inside."""
    (tmp_path / "t/real/deep").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "out/z").write_text("")
    (tmp_path / "t/real/deep/x").write_text("x")
    for at, to in (("t/link", "real"), ("t/real/deep/up", "../.."), ("t/away", "../out"), ("t/nothing", "gone")):
        os.symlink(to, tmp_path / at)
    plain = {r.path: r for r in read_tree(spark, str(tmp_path / "t")).collect()}
    assert set(plain) == {"real", "real/deep", "real/deep/x", "real/deep/up", "link", "away", "nothing"} and plain["link"].is_symlink
    seen = {r.path: r for r in read_tree(spark, str(tmp_path / "t"), follow=True).collect()}
    assert {"link/deep/x", "real/deep/x", "away/z"} <= set(seen) and len(seen) < 30
    assert seen["link/deep/x"].inside and not seen["away/z"].inside and not seen["nothing"].inside
    needs = spark.createDataFrame([("bin/p", "dependency", "@executable_path/../link/deep/x"), ("bin/p", "dependency", "@executable_path/../away/z")], "path string, kind string, value string")
    assert native.missing_mac(read_tree(spark, str(tmp_path / "t"), follow=True), needs).first().missing == ["@executable_path/../away/z"]


def test_gate_reads_native_files_only(spark, tmp_path, monkeypatch):
    """A file that is not native may be unreadable: its bytes are never asked for."""
    (tmp_path / "a.exe").write_bytes(portable_executable(["other.dll"], []))
    os.mkfifo(tmp_path / "pipe.txt")  # reading it would wait for ever
    assert [(r.path, r.missing) for r in dependencies.windows_problems(spark, str(tmp_path)).collect()] == [("a.exe", ["other.dll"])]


def test_unsafe_and_linked_members(spark, tmp_path):
    rows = {r.path: r for r in read_tar(spark, catalog._tar(str(tmp_path), [("d/a", "file", b"1"), ("d/l", "link", "a"), ("h", "hard", "d/a")])).collect()}
    assert rows["d/l"].link == "a" and rows["d/l"].content is None and bytes(rows["h"].content) == b"1"
    for entry in (("../x", "file", b""), ("d/l", "link", "../../x"), ("d/m", "link", "/etc"), ("h", "hard", "../x")):
        with pytest.raises(Exception, match="leave the folder"):
            read_tar(spark, catalog._tar(str(tmp_path), [("d/a", "file", b"1"), entry])).collect()


def test_package_arguments():
    a = package.arguments(["--pins", "p.json", "--work", "w"])
    assert (a.pins, a.output, a.work, a.system) == ("p.json", "artifacts", "w", "")


def test_package_fails_at_the_gate(spark, sf_dir, tmp_path, monkeypatch):
    """A native file with a library from nowhere stops the job before an archive is written."""
    real = package.problems
    monkeypatch.setattr(package, "problems", lambda *a: real(*a).union(spark.createDataFrame([("x.dll", ["gone.dll"])], "path string, missing array<string>")))
    with pytest.raises(RuntimeError, match="x.dll: gone.dll"):
        catalog.package_job(spark, sf_dir)


def test_broken_executables(spark):
    good = portable_executable(["a.dll"], [])
    bad = good[:0x80 + 24 + 112 + 8] + struct.pack("<I", 0x9000) + good[0x80 + 24 + 112 + 12 :]
    table = spark.createDataFrame([("good", good), ("address", bad), ("cut", good[:0x90]), ("none", b"MZ"), ("null", None)], "path string, content binary")
    out = {r.path: (r.dll, r.error) for r in native.pe_imports(table).collect()}
    assert out["good"] == ("a.dll", None) and "no section" in out["address"][1] and out["cut"][1] and not {"none", "null"} & set(out)
