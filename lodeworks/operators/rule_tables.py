"""Removal rules as a table, joined to a tree of any size.

A rule is a row (rule_id, glob, tree, keep): it removes what its glob matches, with all beneath it if tree; a keep rule
is an allowance: of what lies in its folder only matches of such rules stay. Rules are filed under a key that a path can be looked up by,
and every path is exploded to the keys that could be its rules': plans have the same size for three rules and for a million, and patterns
are tried only where their folder is met.

* exact: a glob without wildcards is looked up among the path and the folders above it;
* name: '**/' or 'folder/**/' and a literal name, among the names of the path and of the folders above it;
* scope: any other glob, by the literal folders it begins with; within it the glob is matched as a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, NAME, SCOPE = "exact", "name", "scope"
_WILD = r"[*?\[]"
#: Bytes of compiled rules that may go to every task; larger tables are shuffled.
SMALL = 16 << 20


def _pattern(glob: Column) -> Column:
    """A glob's regular expression: '**/' spans folders, the rest stays within a component; all else is literal."""
    text = F.regexp_replace(glob, r"([.^$+(){}|\\])", r"\\$1")
    text = F.regexp_replace(text, r"\[!", "[^")
    text = F.regexp_replace(text, r"(^|/)\*\*/", "$1\u0001")
    text = F.regexp_replace(F.regexp_replace(text, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.regexp_replace(text, "\u0001", "(?:[^/]+/)*")


def compiled(rules: DataFrame) -> DataFrame:
    """(rule_id, kind, key, within, pattern, tree, keep) of rules (rule_id, glob, tree, keep).

    within is the folder that the rule's matches lie in, '' for the root; pattern matches a whole path, or one of the folders above it.
    A keep rule's folder is the literal beginning of its glob.
    """
    glob = F.col("glob")
    wild = glob.rlike(_WILD)
    parts = F.split(glob, "/")
    literal = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: s["p"].rlike(_WILD))
    first = F.coalesce(F.get(literal, F.lit(0))["i"], F.size(parts) - 1)  # the first component with a wildcard, or the last
    scope = F.array_join(F.slice(parts, 1, first), "/")
    name = F.element_at(parts, -1)
    named = glob.rlike(r"^([^*?\[]*/)?\*\*/[^/*?\[]+$")
    kind = F.when(F.col("keep"), SCOPE).when(~wild, EXACT).when(named, NAME).otherwise(SCOPE)
    out = rules.select("rule_id", F.coalesce("tree", F.lit(True)).alias("tree"), F.coalesce("keep", F.lit(False)).alias("keep"), "glob")
    out = out.where("glob is not null and glob <> ''").withColumn("kind", kind).withColumn("within", scope)
    key = F.when(F.col("kind") == EXACT, F.col("glob")).when(F.col("kind") == NAME, name).otherwise(F.col("within"))
    end = F.when(F.col("tree"), F.lit("(?:/.*)?$")).otherwise(F.lit("$"))
    return out.select("rule_id", "kind", key.alias("key"), "within", F.concat(F.lit("^"), _pattern(glob), end).alias("pattern"), "tree", "keep")


def _keys(path: Column) -> Column:
    """The keys of a path: (kind, key, at) for itself and the folders above it, at being the folder or path that the key stands for."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    key = lambda kind, key, at: F.struct(F.lit(kind).alias("kind"), key.alias("key"), at.alias("at"))
    exact = F.transform(above, lambda a: key(EXACT, a, a))
    names = F.transform(above, lambda a: key(NAME, F.element_at(F.split(a, "/"), -1), a))
    scopes = F.transform(F.concat(F.array(F.lit("")), F.slice(above, 1, F.size(above) - 1)), lambda a: key(SCOPE, a, a))
    return F.concat(exact, names, scopes)


def _met(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """keyed with the rules of its keys. Spark takes exploded rows for no larger than their paths and a list of rules for
    endless, and would broadcast the former; so the rules are measured, and the paths' keys never leave their tasks for the driver.
    """
    size = rules.agg(F.sum(F.octet_length("glob") * 6 + 100)).first()[0] or 0  # key, folder and pattern, the latter with escapes
    return keyed.join(compiled(rules).hint("broadcast" if size <= SMALL else "merge"), ["kind", "key"])


def matches(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, is_dir, rule_id, within, keep, hit): which rules a path meets by key, and whether they match it.

    paths: (path, is_dir) with each path once; is_dir may be null. Rules for files (tree false) leave folders alone. A keep rule
    is listed for all that lies in its folder, with hit where it allows the path.
    """
    keyed = paths.select("path", "is_dir", F.explode(_keys(F.col("path"))).alias("k")).select("path", "is_dir", "k.*")
    met = _met(keyed, rules)
    itself = F.col("at") == F.col("path")
    beneath = (F.col("within") == "") | F.col("at").startswith(F.concat("within", F.lit("/")))
    own = F.when(F.col("tree"), True).otherwise(itself & ~F.coalesce("is_dir", F.lit(False)))
    hit = F.when(F.col("kind") == EXACT, own).when(F.col("kind") == NAME, own & beneath)
    hit = hit.otherwise(F.rlike("path", F.col("pattern")) & (F.col("keep") | F.col("tree") | ~F.coalesce("is_dir", F.lit(False))))
    return met.select("path", "is_dir", "rule_id", "within", "keep", hit.alias("hit"))


def removed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path): the paths that the rules remove. A folder with keep rules loses what none of them allows."""
    met = matches(paths, rules).where("hit or keep")
    by_folder = met.groupBy("path", "keep", F.when(F.col("keep"), F.col("within")).alias("folder")).agg(F.bool_or("hit").alias("hit"))
    return by_folder.where("hit <> keep").select("path").distinct()


def apply_table(tree: DataFrame, rules: DataFrame) -> DataFrame:
    """tree (path, is_dir if it has it, ...) without the rows that the table of rules removes; null paths stay.

    The removed paths grow with the tree, and Spark's guess of their size is that of the rules times that of the tree's files:
    they are never broadcast, whatever the guess and the threshold.
    """
    is_dir = F.col("is_dir") if "is_dir" in tree.columns else F.lit(None).cast("boolean")
    paths = tree.where("path is not null").groupBy("path").agg(F.max(is_dir).alias("is_dir"))
    return tree.join(removed(paths, rules).hint("merge"), "path", "left_anti").select(*tree.columns)


def as_table(spark, rules: list) -> DataFrame:
    """The table of a list of rules.Rule."""
    rows = [(k, f"{r.keep}/{r.glob}" if r.keep else r.glob, r.tree and not r.keep, bool(r.keep)) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, glob string, tree boolean, keep boolean")
