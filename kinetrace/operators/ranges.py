"""Long ordered lists cut into ranges, so that windows go by range and no list is one task.

Short lists are one range.  What a range needs of the others is one row a range, or the few
rows that follow it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists of more rows are cut, into so many ranges of about equal numbers of rows.
LIST, RANGES = 1 << 16, 256
RANGE = "__range"


def matched(d: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """d with the further columns of other, one row for each of on (null matches null); AQE may split a hot list."""
    names = {c: f"__of_{c}" for c in on}
    o = other.withColumnsRenamed(names).hint("rebalance")
    return d.join(o, reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]), "left").drop(*names.values())


def cut(d: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """d with the number of each row's range in its list: ranges are in order of at, equal values lie in one."""
    d = d.withColumn("__at", at.cast("double"))
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = F.when(F.count(F.lit(1)) > LIST, F.percentile_approx("__at", shares, F.lit(100 * RANGES))).otherwise(F.array().cast("array<double>"))
    d = matched(d, d.groupBy(*keys).agg(bounds.alias("__bounds")), keys)
    return d.withColumn(RANGE, F.size(F.filter("__bounds", lambda b: b <= F.col("__at")))).drop("__at", "__bounds")


def carried(d: DataFrame, keys: list[str], later: bool = False, **what: tuple[Column, Column]) -> DataFrame:
    """d with, of the ranges before its own (or after it), something of all: name = (aggregate of a range, function of these over the ranges)."""
    each = d.groupBy(*keys, RANGE).agg(*[one.alias(name) for name, (one, _) in what.items()])
    w = Window.partitionBy(*keys).orderBy(RANGE)
    w = w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1)
    return matched(d, each.select(*keys, RANGE, *[every.over(w).alias(name) for name, (_, every) in what.items()]), [*keys, RANGE])


def extended(d: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows of each range and copies of the n rows that follow it in the list, told apart by __guest."""
    own = [c for c in d.columns if c not in (*keys, RANGE)]
    heads = d.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy(*order))).where(F.col("__n") <= n)
    heads = heads.select(*keys, RANGE, "__n", F.struct(*own).alias("__row"))
    w = Window.partitionBy(*keys).orderBy(RANGE, "__n")
    last = F.coalesce(F.lead(RANGE).over(w) != F.col(RANGE), F.lit(False))
    ends = heads.withColumns({"__next": F.collect_list("__row").over(w.rowsBetween(1, n)), "__last": last}).where("__last")
    guests = ends.select(*keys, RANGE, F.explode("__next").alias("__row")).select(*keys, RANGE, *[F.col("__row")[c].alias(c) for c in own])
    return d.withColumn("__guest", F.lit(False)).unionByName(guests.withColumn("__guest", F.lit(True)))
