"""Filters that Spark hands to a data source, as tests on a row's values before its bytes are read."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda a, b: a == b,
    ds.In: lambda a, b: a in b,
    ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
}


def _test(f: ds.Filter) -> tuple[str, Callable] | None:
    """(column, test of its value) of a filter on one column; null passes no test, negated or not."""
    if isinstance(f, ds.Not) and (inner := _test(f.child)):
        column, test = inner
        return column, lambda v: v is not None and not test(v)
    if type(f) in _TESTS and len(f.attribute) == 1:
        test, value = _TESTS[type(f)], f.value
        return f.attribute[0], lambda v: v is not None and test(v, value)
    return None


class Pushed:
    """The filters of a scan on columns that are known before contents are read. Spark checks all of them again.

    Only where option filtered is true: Spark keeps one reader for all uses of a loaded frame in a query, so a frame that is used with
    different filters there must not take any; load it once for each.
    """

    def __init__(self, columns: Iterable[str], options: dict):
        self.columns = set(columns) if options.get("filtered", "false").lower() == "true" else set()
        self.filters: list[ds.Filter] = []

    def take(self, filters: list[ds.Filter]) -> list[ds.Filter]:
        self.filters += [f for f in filters if (t := _test(f)) and t[0] in self.columns]
        return filters

    def compiled(self) -> Callable[[dict], bool]:
        tests = [_test(f) for f in self.filters]
        return lambda row: all(test(row[column]) for column, test in tests)


def register(spark: SparkSession, source: type[ds.DataSource]) -> None:
    """Registers a source and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
