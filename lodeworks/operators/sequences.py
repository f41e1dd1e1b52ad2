"""State carried along ordered rows: fill-forward, first outcome, running cap, marker slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.paths import lines, stripped

# Load commands that name a library.
LOADS = ["LC_LOAD_DYLIB", "LC_LOAD_WEAK_DYLIB", "LC_REEXPORT_DYLIB", "LC_LOAD_UPWARD_DYLIB", "LC_LAZY_LOAD_DYLIB"]


#: What an attempt at a source comes to: its bytes, wrong bytes, or none for now.
OK, MISMATCH, ERROR = "ok", "mismatch", "error"


def carry(rows: DataFrame, part: list[str], order: list[str], state: Column, out: str) -> DataFrame:
    """rows with the last non-null state up to and with each row."""
    upto = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(state, ignorenulls=True).over(upto))


def load_commands(text: DataFrame, scan: Callable = carry) -> DataFrame:
    """(path, line_no, kind, value) of libraries ('dependency') and search paths ('rpath') in load-command text.

    text: (path, line_no, line). A line 'cmd X' sets the command until the next; 'name' and 'path' lines count
    under the commands that have them, cut at the last ' (offset'. Order and repeats are kept by line_no.
    scan carries the command along: scans.carry for listings too long for one task.
    """
    rows = text.withColumn("line", stripped(F.col("line")))
    command = F.when(F.col("line").startswith("cmd "), F.get(F.split("line", r"\s+"), F.lit(1)))
    rows = scan(rows, ["path"], ["line_no"], command, "command")
    kind = F.when(F.col("command").isin(LOADS) & F.col("line").startswith("name "), "dependency").when((F.col("command") == "LC_RPATH") & F.col("line").startswith("path "), "rpath")
    value = F.regexp_replace(F.substr("line", F.lit(6)), r"^(.*) \(offset.*$", "$1")
    # a line that begins with 'cmd ' is never a value
    return rows.where(kind.isNotNull() & ~F.col("line").startswith("cmd ")).select("path", "line_no", kind.alias("kind"), value.alias("value"))


def first_outcome(attempts: DataFrame, key: str, tries: int) -> DataFrame:
    """One row per key: what ordered sources with bounded retries come to.

    attempts: (key, source, attempt, outcome, message), outcome OK, MISMATCH or ERROR. Of each source the
    first `tries` attempts count, none after a mismatch or success; the first success over all sources wins.
    Returns (key, status, source, attempt, failures): failures before the end, in order.
    """
    within = W.partitionBy(key, "source").orderBy("attempt")
    ended = F.max((F.col("outcome") != ERROR).cast("int")).over(within.rowsBetween(W.unboundedPreceding, -1))
    seen = attempts.withColumn("nth", F.row_number().over(within)).withColumn("ended", F.coalesce(ended, F.lit(0))).where((F.col("nth") <= tries) & (F.col("ended") == 0))
    place = F.struct("source", "attempt")
    won = F.min(F.when(F.col("outcome") == OK, place)).over(W.partitionBy(key))
    made = seen.withColumn("won", won).where(F.col("won").isNull() | (place <= F.col("won")))
    failed = F.array_sort(F.collect_list(F.when(F.col("outcome") != OK, F.struct("source", "attempt", "message"))))
    return made.groupBy(key).agg(F.max("won").alias("won"), failed.alias("f")).select(
        key, F.when(F.col("won").isNull(), "failed").otherwise("ok").alias("status"), "won.source", "won.attempt", F.transform("f", lambda x: x["message"]).alias("failures")
    )


def running_cap(rows: DataFrame, part: list[str], order: list[str], amount: Column, cap: int) -> DataFrame:
    """rows with running (the total so far) and within (whether it is at most cap). For groups too large for one task
    see scans.running_total."""
    total = F.sum(amount).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("running", total).withColumn("within", F.col("running") <= cap)


def block_comment(text: Column) -> Column:
    """The first block comment of a source text, stripped; a text without one is an error."""
    found = F.regexp_extract(text, r"(?s)/\*(.*?)\*/", 0)
    inner = stripped(F.substr(found, F.lit(3), F.length(found) - 4))
    return F.when(found == "", F.raise_error(F.lit("no block comment"))).otherwise(inner)


def comment_block(text: Column, first: str = "// Copyright", last: str = "SUCH DAMAGE.") -> Column:
    """Lines from the first that starts with `first` to the next that holds `last`, without comment marks: '// ', else
    the first two characters. A text without these lines is an error."""
    every = lines(text)
    numbered = F.transform(every, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    start = F.get(F.filter(numbered, lambda r: r["x"].startswith(first)), F.lit(0))["i"]
    end = F.get(F.filter(numbered, lambda r: (r["i"] >= start) & F.contains(r["x"], F.lit(last))), F.lit(0))["i"]
    bare = lambda x: F.when(x.startswith("// "), F.substr(x, F.lit(4))).otherwise(F.substr(x, F.lit(3)))
    out = F.array_join(F.transform(F.slice(every, start + 1, end - start + 1), bare), "\n")
    return F.when(end.isNull(), F.raise_error(F.lit("no passage of comments")).cast("string")).otherwise(out)


def top(rows: DataFrame, k: int, *by: Column) -> DataFrame:
    """The first k rows in an order, in that order: partial results by partition, then one merge."""
    return rows.orderBy(*by).limit(k)
