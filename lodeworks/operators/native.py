"""Dependencies of native files: decoding, resolution, and the gate."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalized
from .links import resolved
from .sets import search_sets

# Libraries of every supported Windows, prefixes of its API sets, and Mach-O magics.
WINDOWS_LIBRARIES = [
    "advapi32.dll", "bcrypt.dll", "cabinet.dll", "comctl32.dll", "comdlg32.dll", "crypt32.dll", "dbghelp.dll", "gdi32.dll", "imm32.dll",
    "iphlpapi.dll", "kernel32.dll", "msi.dll", "msvcrt.dll", "mswsock.dll", "normaliz.dll", "ntdll.dll", "ole32.dll", "oleaut32.dll", "propsys.dll",
    "psapi.dll", "rpcrt4.dll", "secur32.dll", "setupapi.dll", "shell32.dll", "shlwapi.dll", "sspicli.dll", "user32.dll", "userenv.dll",
    "version.dll", "winhttp.dll", "winmm.dll", "wintrust.dll", "ws2_32.dll",
]
API_SETS = ("api-ms-win-", "ext-ms-")
MAGICS = ["CFFAEDFE", "CEFAEDFE", "CAFEBABE", "CAFEBABF"]
SYSTEM_PATHS = ("/usr/lib/", "/System/Library/")

# Fixed values of the file format: the data directories of imports and of delay-loaded ones, and their entries, each
# with the name's address in the middle.
TABLES = {1: "<12sI4s", 13: "<4sI24s"}
SECTION = [("name", "S8"), ("virtual", "<u4"), ("address", "<u4"), ("size", "<u4"), ("raw", "<u4"), ("rest", "S16")]


def sections(data: bytes, header: int):
    """The section table of a portable executable as an array, in table order."""
    import numpy as np

    n, optional = struct.unpack_from("<6xH12xH", data, header)
    return np.frombuffer(data, SECTION, n, header + 24 + optional)


def file_offsets(table, addresses):
    """File offsets of addresses: each by the first section of the table that holds it; one in none is an error."""
    import numpy as np

    low = table["address"].astype(np.int64)
    high = low + np.maximum(table["virtual"], table["size"])
    at = np.asarray(addresses, np.int64)[:, None]
    holds = (low <= at) & (at < high)
    if not holds.any(1).all():
        raise ValueError(f"address {addresses[int(np.argmin(holds.any(1)))]:#x} lies in no section")
    first = holds.argmax(1)
    return at[:, 0] - low[first] + table["raw"][first]


def imported(data: bytes) -> list[str]:
    """Names of the libraries that a portable executable imports, delay-loaded ones last, in table order with repeats.

    Bytes of any other kind import nothing.
    """
    header = int.from_bytes(data[0x3C:0x40], "little")
    if len(data) < 0x40 or data[:2] != b"MZ" or data[header : header + 4] != b"PE\0\0":
        return []
    table = sections(data, header)
    wide = data[header + 24 : header + 26] == b"\x0b\x02"  # 64-bit files have 16 bytes more before the directories
    directories = header + 24 + (112 if wide else 96)
    names: list[int] = []
    for number, entry in TABLES.items():
        (address,) = struct.unpack_from("<I", data, directories + 8 * number)
        if address:
            rows = memoryview(data)[int(file_offsets(table, [address])[0]) :]
            rows = rows[: len(rows) - len(rows) % struct.calcsize(entry)]  # a table that is cut off ends with its last whole entry
            names += [name for _, name, _ in takewhile(lambda e: e[1] or any(e[0]) or any(e[2]), struct.iter_unpack(entry, rows))]
    return [data[at : data.index(b"\0", at)].decode("ascii").lower() for at in file_offsets(table, names).tolist()] if names else []


def pe_imports(files: DataFrame) -> DataFrame:
    """(path, ord, dll, error) from (path, content): one row per import; a malformed file gives its error.

    What is not a portable executable has no imports and no error.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one content at a time
                try:
                    rows += [(path, k, dll, None) for k, dll in enumerate(imported(data.as_py() or b""))]
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "ord", "dll", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, ord int, dll string, error string")


def is_windows_native(suffix: Column) -> Column:
    return F.lower(suffix).isin(".exe", ".dll", ".pyd")


def is_mac_native(content: Column) -> Column:
    """By the first four bytes, whatever the name."""
    return F.hex(F.substring(content, 1, 4)).isin(MAGICS)


def missing_windows(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, missing): per file the sorted imports that neither the tree nor Windows provides.

    files: (path, name, parent) of the whole tree; imports: (path, dll).
    """
    sets = search_sets(files)
    shared = sets.where("scope = '*'").select("dll")
    own = sets.where("scope <> '*'")
    left = imports.where(~F.col("dll").isin(WINDOWS_LIBRARIES))
    for prefix in API_SETS:
        left = left.where(~F.col("dll").startswith(prefix))
    left = left.withColumn("scope", F.regexp_replace("path", r"/?[^/]*$", ""))
    left = left.join(own, ["scope", "dll"], "left_anti").join(shared, "dll", "left_anti")
    return left.groupBy("path").agg(F.sort_array(F.collect_set("dll")).alias("missing"))


def missing_mac(files: DataFrame, commands: DataFrame, root: str = "/root", links: DataFrame | None = None) -> DataFrame:
    """(path, missing): per file the sorted dependencies that resolve to no file of the tree.

    files: (path, inside) with inside telling that the entry is a file whose real place is in the tree;
    commands: (path, kind, value). System paths pass unseen; paths from the loader or the executable's folder
    are expanded; one by '@rpath/' passes if any of the file's own search paths leads to a file of the tree.
    root stands for the tree's place: absolute search paths count only beneath it. Where links (path, target) are given, they are
    followed as a file system does, one that leads out of the tree to nothing; else files must list what lies behind links.
    """
    there = files.where("inside").select(F.concat(F.lit(root + "/"), "path").alias("_there")).distinct()
    folder = F.regexp_replace(F.concat(F.lit(root + "/"), F.col("path")), r"/[^/]*$", "")
    expand = lambda value: F.replace(F.replace(value, F.lit("@loader_path"), folder), F.lit("@executable_path"), F.lit(root + "/bin"))
    wanted = commands.where("kind = 'dependency'").select("path", F.col("value").alias("dependency")).distinct()
    for prefix in SYSTEM_PATHS:
        wanted = wanted.where(~F.col("dependency").startswith(prefix))
    direct = wanted.where(F.col("dependency").startswith("@loader_path/") | F.col("dependency").startswith("@executable_path/")).withColumn("_at", expand(F.col("dependency")))
    searched = wanted.where(F.col("dependency").startswith("@rpath/")).join(commands.where("kind = 'rpath'").select("path", F.col("value").alias("rpath")).distinct(), "path")
    searched = searched.withColumn("_at", F.concat(expand(F.col("rpath")), F.lit("/"), F.substr("dependency", F.lit(8)))).drop("rpath")
    tried = direct.union(searched)
    if links is None:
        placed = tried.withColumn("_real", normalized(F.col("_at")))
    else:
        own = links.select(F.concat(F.lit(root + "/"), "path").alias("path"), "target")
        real = resolved(tried.select(F.col("_at").alias("path")), own).select(F.col("path").alias("_at"), F.col("real").alias("_real"))
        placed = tried.join(real, "_at")
    found = placed.join(there, F.col("_real") == F.col("_there"), "left_semi").select("path", "dependency").distinct()
    left = wanted.join(found, ["path", "dependency"], "left_anti")
    return left.groupBy("path").agg(F.sort_array(F.collect_set("dependency")).alias("missing"))


def report(problems: DataFrame) -> DataFrame:
    """(path, line) sorted by path: 'path: a, b'."""
    return problems.select("path", F.concat("path", F.lit(": "), F.array_join("missing", ", ")).alias("line")).orderBy("path")


def gate(problems: DataFrame) -> None:
    """Raises with all problems, in order, if there are any."""
    lines = [r.line for r in report(problems).collect()]  # one per native file with a problem
    if lines:
        raise RuntimeError("Native files need libraries that are not there:\n" + "\n".join(f"  {x}" for x in lines))
