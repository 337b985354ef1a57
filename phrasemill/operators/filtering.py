"""Filters over entities with counts, features, words and occurrences; sorting, cutting and merging them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency_at_least(freqs: Column, least: int, source: str | None = None) -> Column:
    """freqs is MAP<source, count>: every count (or the named source's, also as name.xml) is at least `least`."""
    own = freqs if source is None else F.map_filter(freqs, lambda k, _: k.isin(source, f"{source}.xml"))
    return F.coalesce(F.forall(F.map_values(own), lambda v: v >= least), F.lit(True))


def compare_frequency(freqs: Column, op: str, value: int, source: str | None = None) -> Column:
    """eq, ne, lt, le, gt, ge of counts; lt and le are the opposites of ge and gt."""
    if op in ("ge", "gt"):
        return frequency_at_least(freqs, value + (op == "gt"), source)
    if op in ("lt", "le"):
        return ~frequency_at_least(freqs, value + (op == "le"), source)
    own = F.map_values(freqs) if source is None else F.map_values(F.map_filter(freqs, lambda k, _: k.isin(source, f"{source}.xml")))
    same = F.exists(own, lambda v: v == value)
    return same if op == "eq" else ~same


def feature_equals(column: Column, value: str, kind: str = "string") -> Column:
    """A feature of a declared type (integer, real, string) against a value in text."""
    cast = {"integer": "long", "real": "double"}.get(kind, "string")
    return F.coalesce(column.cast(cast) == F.lit(value).cast(cast), F.lit(False))


def length_between(items: Column, lo: int = 0, hi: int | None = None) -> Column:
    n = F.size(items)
    return (n >= lo) & (F.lit(True) if hi is None else n <= hi)


def keep(df: DataFrame, condition: Column, reverse: bool = False) -> DataFrame:
    """Rows that meet the condition, or all others; an unknown condition isn't met."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(~met if reverse else met)


def sort(df: DataFrame, keys: list[str], ties: list[str], descending: bool = False) -> DataFrame:
    """Rows with a `rank` from 1; missing values count as largest."""
    cols = [F.col(k).desc_nulls_first() if descending else F.col(k).asc_nulls_last() for k in keys]
    return ranked(df, [*cols, *[F.col(t).asc() for t in ties]])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all rows.

    Rows are range-partitioned by the order and numbered within partitions; the sizes of the partitions before are added.
    """
    from phrasemill.operators.numbering import numbered

    return numbered(df, order, name)


def head(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The last n rows, in the original order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def index_slice(df: DataFrame, index: Column, value: Column, lower: int, upper: int) -> Column:
    """value for rows whose index is in [lower, upper]; null for others."""
    return F.when(index.between(lower, upper), value)


def uniq(df: DataFrame, key: list[str], order: str, sums: list[str] = (), maxima: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """Rows with equal keys (undefined equals undefined) merged: counts summed, features by maximum, lists joined; `first` is the first place."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return df.groupBy(*key).agg(F.min(order).alias("first"), *aggs)


def union(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, with the number of the input in `file`."""
    out = inputs[0].withColumn("file", F.lit(0))
    for k, x in enumerate(inputs[1:], 1):
        out = out.unionByName(x.withColumn("file", F.lit(k)), allowMissingColumns=True)
    return out


def present_in(df: DataFrame, other: DataFrame, keys: list[str], absent: bool = False) -> DataFrame:
    """Rows whose keys come (or don't) in other: intersection and difference."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti" if absent else "left_semi")
