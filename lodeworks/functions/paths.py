"""Column functions on POSIX paths and text, with the rules of Python's pathlib and str."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The path without its last component; '' for a path of one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Last dot part of the name; '' where the name has none but a leading dot."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def components(path: Column) -> Column:
    """Sort key that orders by components: 'a/b' before 'a-b'."""
    return F.split(path, "/")


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


#: Paths that normalizing leaves alone: no empty, '.' or '..' components.
PLAIN = r"^/?(?!\.{1,2}(?:/|$))[^/]+(?:/(?!\.{1,2}(?:/|$))[^/]+)*$"


def normalized(path: Column) -> Column:
    """os.path.normpath: empty and '.' components go, '..' takes one back, at the root it stays there."""
    rooted = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        drop = (part == "") | (part == ".")
        up = part == ".."
        back = up & F.coalesce(last != "..", F.lit(False))
        stay = up & rooted & (F.size(done) == 0)
        return F.when(drop | stay, done).when(back, F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(part)))

    # an array of one names the result, so that it is worked out once however often it is used
    joined = F.array(F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))
    whole = F.transform(joined, lambda j: F.when(rooted, F.concat(F.lit("/"), j)).when(j == "", F.lit(".")).otherwise(j))
    return F.when(path.rlike(PLAIN), path).otherwise(F.get(whole, F.lit(0)))


#: What str.strip takes for white space, for Java's regular expressions.
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0  -     　"


def stripped(text: Column) -> Column:
    """str.strip: white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(text: Column) -> Column:
    """str.splitlines: at every line boundary, without an empty last item."""
    parts = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))).otherwise(parts)


def present(value: Column) -> Column:
    """Null for '' as well as for null: both count as missing in lookups."""
    return F.nullif(value, F.lit(""))


def uint_le(data: Column, offset: Column, size: int) -> Column:
    """Unsigned little-endian integer of size bytes at a 0-based offset, as bigint."""
    digits = [F.hex(F.substr(data, offset + (k + 1), F.lit(1))) for k in range(size)]
    return F.conv(F.concat(*reversed(digits)), 16, 10).cast("bigint")


def glob_pattern(glob: str) -> str:
    """Regular expression for a path matching a glob per component; '**/' spans any number of folders."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[k:]:
            end = glob.index("]", k)
            out, k = out + glob[k : end + 1].replace("[!", "[^"), end
        else:
            out += "\\" + c if not c.isalnum() and c not in "/_" else c
        k += 1
    return f"^{out}$"
