"""Symbolic links resolved in tables: paths are rewritten by joins with the links until none meets a link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

#: Links that one path may lead through, as in file systems; a path that needs more goes round in a circle.
MOST = 40


def _tidy(path: Column) -> Column:
    """A path without empty components and '.'."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def _step(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, path, hops, moved): each path one step on: through its first link, or back over its first '..', whichever comes first.

    links: (head, target, more) with the links that a target has been followed through already, target null where there is none.
    What stands before a path's first '..' is looked up by each of its leading folders; the shortest that is a link counts.
    """
    parts = F.split("path", "/")
    rooted = F.col("path").startswith("/")
    up = F.array_position(parts, "..").cast("int")  # from 1; 0 for none
    upto = F.when(up > 0, up - 1).otherwise(F.size(parts))
    heads = F.transform(F.filter(F.sequence(F.lit(0), upto), lambda k: k >= F.when(rooted, 2).otherwise(1)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("head")))
    keyed = rows.select("id", F.explode(heads).alias("h")).select("id", "h.*")
    met = keyed.join(links, "head").groupBy("id").agg(F.min(F.struct("k", "target", "more")).alias("link"))
    both = rows.join(met, "id", "left")
    cut_to = lambda n: F.slice(parts, 1, F.greatest(n, F.lit(0)))
    names = F.filter(F.split("link.target", "/"), lambda p: p != "")
    through = F.concat(F.when(F.col("link.target").startswith("/"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), names, F.slice(parts, F.col("link.k") + 1, F.size(parts)))
    # '..' takes one back, at the root it stays there; a path without a root has nothing before its start
    before = F.when(rooted, up - 2).otherwise(up - 1)
    back = F.when(before > 0, F.concat(cut_to(up - 2), F.slice(parts, up + 1, F.size(parts)))).when(rooted, F.concat(F.array(F.lit("")), F.slice(parts, up + 1, F.size(parts))))
    linked = F.col("link").isNotNull()
    stepped = F.when(linked, through).otherwise(back)
    joined = F.array_join(stepped, "/")
    whole = F.when(F.size(stepped) == 1, F.when(F.get(stepped, F.lit(0)) == "", "/").otherwise(joined)).otherwise(joined)
    path = F.when(linked | (up > 0), F.when(stepped.isNotNull(), whole)).otherwise(F.col("path"))
    hops = F.col("hops") + F.when(linked, F.col("link.more") + 1).otherwise(0)
    return both.select("id", path.alias("path"), hops.alias("hops"), (linked | (up > 0)).alias("moved"))


_OPEN = f"moved and path is not null and hops <= {MOST}"


def _followed(start: DataFrame, links: DataFrame | None) -> DataFrame:
    """(id, path, hops): start (id, path) followed to the end; path is null where there is none. Without links, start's rows are the links
    themselves: each round they are followed through the links as far as these have come, so chains halve."""
    done = None
    now = cut(start.select("id", _tidy(F.col("path")).alias("path"), F.lit(0).alias("hops"), F.lit(True).alias("moved")))
    while not now.where(_OPEN).isEmpty():
        known = now if links is None else links
        table = known.select(F.col("id").alias("head"), F.when(F.col("hops") <= MOST, F.col("path")).alias("target"), F.col("hops").alias("more"))
        ahead = _step(now.where(_OPEN), table)
        if links is None:
            now = cut(ahead.union(now.where(f"not ({_OPEN}) or path is null")))
        else:
            now = cut(ahead)
            ended = now.where(f"not ({_OPEN}) or path is null")
            done = ended if done is None else done.union(ended)
    out = now if done is None else done
    return out.select("id", F.when(F.col("hops") <= MOST, F.col("path")).alias("path"), "hops")


def resolved(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, real): where each distinct path leads to once all links on its way are followed, as os.path.realpath finds it.

    links: (path, target), the smallest target where a path stands twice. Targets may be relative to the link's folder, lead through
    other links, or hold '.' and '..'. '..' goes back from where a link leads to, not from where it stands. real is null for a path
    that leads through more than MOST links, so round in a circle, and for one that leaves the start of a path without a root.
    Null paths are left out; what a path leads to need not exist. First links are followed through each other, then all paths through what
    these lead to: rounds of joins, as many as there are links and '..' one behind another in a path, for all paths at once.
    """
    folder = F.regexp_replace(_tidy(F.col("path")), "[^/]*$", "")
    goal = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, "target"))
    own = links.where("path is not null and target is not null").groupBy(_tidy(F.col("path")).alias("id")).agg(F.min(goal).alias("path"))
    ends = cut(_followed(own, None))
    start = paths.select(F.col("path").alias("id"), "path").where("path is not null").distinct()
    return _followed(start, ends).select(F.col("id").alias("path"), F.col("path").alias("real"))
