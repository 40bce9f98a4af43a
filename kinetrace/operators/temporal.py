"""Temporal relations between lists of events, all within one trajectory.

Lists are tables of EVENT columns, ordered by seq.  The list of a relation is in order of the
left event, then of the right one: its seq is theirs in turn, so that no list is ever numbered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ranges import RANGE, carried, cut, extended, matched

COLUMNS = ("seq", "start_ps", "end_ps", "type", "selections")


def _fixed(gap: pd.Series) -> pd.Series:
    return pd.Series(np.char.mod("%.6f", gap.to_numpy(float)))


def fixed(gap: Column) -> Column:
    """Six decimals, rounded as C does; the JVM rounds the shortest decimal text instead."""
    return F.pandas_udf(_fixed, StringType())(gap)


def side(events: DataFrame, name: str) -> DataFrame:
    return events.select("traj_id", F.struct(*COLUMNS).alias(name))


def combined(pairs: DataFrame, relation: str) -> DataFrame:
    """Pairs (traj_id, a, b) as a list of events that span both."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    start, end = F.least(a("start_ps"), b("start_ps")), F.greatest(a("end_ps"), b("end_ps"))
    gap = F.greatest(F.lit(0.0), b("start_ps") - a("end_ps"))
    return pairs.select(
        "traj_id", F.concat(a("seq"), b("seq")).alias("seq"), start.alias("start_ps"), end.alias("end_ps"), (end - start).alias("duration_ps"), F.lit(relation).alias("type"),
        F.concat(a("selections"), F.array_except(b("selections"), a("selections"))).alias("selections"),
        F.create_map(F.lit("left_type"), a("type"), F.lit("right_type"), b("type"), F.lit("transition_gap_ps"), fixed(gap)).alias("metadata"),
    )


def all_pairs(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Pairs of a trajectory for which on holds: as many as there are."""
    return side(left, "a").join(side(right, "b"), "traj_id").where(on)


def before_pairs(left, right):
    return all_pairs(left, right, F.col("a.end_ps") <= F.col("b.start_ps"))


def after_pairs(left, right):
    return all_pairs(left, right, F.col("a.start_ps") >= F.col("b.end_ps"))


def precedes_pairs(left, right):
    return all_pairs(left, right, F.col("a.end_ps") < F.col("b.start_ps"))


#: Bins that an event is first dealt to in blocks of.
BLOCK = 1 << 12


def bin_widths(left: DataFrame, right: DataFrame) -> DataFrame:
    """(traj_id, width): such that all events together fall into about three bins each and bins hold few events: mean length and mean distance of starts."""
    each = left.select("traj_id", "start_ps", "end_ps").unionByName(right.select("traj_id", "start_ps", "end_ps"))
    length, span = F.avg(F.col("end_ps") - F.col("start_ps")), F.max("start_ps") - F.min("start_ps")
    return each.groupBy("traj_id").agg(F.greatest(length, span / F.count(F.lit(1)) * 4, F.lit(1e-9)).alias("width"))


def overlap_pairs(left: DataFrame, right: DataFrame, width: float | None = None) -> DataFrame:
    """Pairs whose closed intervals meet: joined by time bins, each pair kept in the first bin that both touch."""
    widths = None if width else bin_widths(left, right)

    def binned(events: DataFrame, name: str) -> DataFrame:
        d = events.select("traj_id", *[F.col(c).alias(f"{name}_{c}") for c in COLUMNS])
        d = d.withColumn("width", F.lit(width)) if widths is None else matched(d, widths, ["traj_id"])
        d = d.withColumns({bound: F.floor(F.col(f"{name}_{end}") / F.col("width")) for bound, end in (("low", "start_ps"), ("high", "end_ps"))})
        # A long event in two steps, so that no row holds all its bins.
        d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
        inside = F.sequence(F.greatest(F.col("low"), F.col("block") * BLOCK), F.least(F.col("high"), F.col("block") * BLOCK + (BLOCK - 1)))
        return d.withColumn("bin", F.explode(inside)).drop("low", "high", "block")

    a, b = binned(left, "a"), binned(right, "b").drop("width")
    first = F.floor(F.greatest("a_start_ps", "b_start_ps") / F.col("width"))
    meet = a.join(b, ["traj_id", "bin"]).where((F.col("a_start_ps") <= F.col("b_end_ps")) & (F.col("b_start_ps") <= F.col("a_end_ps")) & (F.col("bin") == first))
    return meet.select("traj_id", *[F.struct(*[F.col(f"{name}_{c}").alias(c) for c in COLUMNS]).alias(name) for name in "ab"])


def during_pairs(left, right, width=None):
    return overlap_pairs(left, right, width).where((F.col("b.start_ps") <= F.col("a.start_ps")) & (F.col("a.end_ps") <= F.col("b.end_ps")))


def immediate_pairs(left: DataFrame, right: DataFrame, quantum: float = 1e-6) -> DataFrame:
    """Pairs where b starts when a ends, up to rounding: joined by near equal quanta of time."""
    place = lambda c: F.floor(F.col(c) / F.lit(quantum)).cast("long")
    a = side(left, "a").select("traj_id", "a", F.explode(F.sequence(place("a.end_ps") - 1, place("a.end_ps") + 1)).alias("q"))
    b = side(right, "b").select("traj_id", "b", place("b.start_ps").alias("q"))
    near = F.abs(F.col("b.start_ps") - F.col("a.end_ps")) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("a.end_ps"), F.abs("b.start_ps"))
    return a.join(b, ["traj_id", "q"]).where((F.col("a.end_ps") <= F.col("b.start_ps")) & near).drop("q")


def next_pairs(left: DataFrame, right: DataFrame, within: float | None = None) -> DataFrame:
    """Each a with the earliest b that starts no sooner than a ends; of equal starts the first in the list.

    Both lists in one order of falling time, the last b met so far goes to each a: a sort, no
    pairs.  With a window of time the sort is by bins of twice that width, so that a long
    trajectory is no single task; each b also stands in the bin before its own.  Without one it
    is by ranges of time, each of which knows the earliest b of those after it.
    """
    none = F.lit(None)
    a = side(left, "a").select("traj_id", F.col("a.end_ps").alias("at"), F.lit(1).alias("is_a"), F.lit(None).cast("array<long>").alias("place"), "a")
    b = side(right, "b").select("traj_id", F.col("b.start_ps").alias("at"), F.lit(0).alias("is_a"), F.col("b.seq").alias("place"), "b")
    empty = (a.withColumn("b", none.cast(b.schema["b"].dataType)), b.withColumn("a", none.cast(a.schema["a"].dataType)))
    if within is None:
        both = cut(empty[0].unionByName(empty[1]), ["traj_id"], F.col("at"))
        earliest = F.min_by("b", F.when(F.col("is_a") == 0, F.struct("at", "place")))  # of a range; null where it has no b
        both = carried(both, ["traj_id"], True, __later=(earliest, F.first("__later", ignorenulls=True)))
        own = ["traj_id", RANGE]
    else:
        bin_ = F.floor(F.col("at") / F.lit(2 * max(float(within), 1e-6)))
        both = empty[0].withColumn("bin", bin_).unionByName(empty[1].withColumn("bin", F.explode(F.array(bin_ - 1, bin_)))).withColumn("__later", none.cast(b.schema["b"].dataType))
        own = ["traj_id", "bin"]
    w = Window.partitionBy(*own).orderBy(F.desc("at"), F.asc("is_a"), F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("b", F.coalesce(F.last("b", ignorenulls=True).over(w), F.col("__later"))).where("is_a = 1 AND b IS NOT NULL").select("traj_id", "a", "b")
    return out if within is None else out.where(F.col("b.start_ps") - F.col("a.end_ps") <= F.lit(float(within)))


PAIRS = {"BEFORE": before_pairs, "AFTER": after_pairs, "PRECEDES": precedes_pairs, "OVERLAPS": overlap_pairs, "DURING": during_pairs, "IMMEDIATELY_FOLLOWED_BY": immediate_pairs, "UNTIL": next_pairs}


def relate(relation: str, left: DataFrame, right: DataFrame, within: float | None = None) -> DataFrame:
    pairs = next_pairs(left, right, within) if relation == "FOLLOWED_BY" else PAIRS[relation](left, right)
    return combined(pairs, relation)


def lasting(events: DataFrame, duration: float) -> DataFrame:
    """FOR: the events of at least a duration, unchanged."""
    return events.where(F.col("duration_ps") >= F.lit(float(duration)))


def repeated(events: DataFrame, count: int, within: float | None = None) -> DataFrame:
    """REPEATS: every window of count events that follow each other in the list."""
    if count > 0x7FFFFFFF:
        return events.where(F.lit(False))
    d = events
    if count > 1:  # parts of a list are in order of the first place, which comes first in seq
        d = extended(cut(events, ["traj_id"], F.col("seq")[0]), ["traj_id"], [F.col("seq")], count - 1)
        d = d.withColumn("__last", F.lead("end_ps", count - 1).over(Window.partitionBy("traj_id", RANGE).orderBy("seq"))).where("NOT __guest")
    else:
        d = d.withColumn("__last", F.col("end_ps"))
    d = d.where(F.col("__last").isNotNull()).withColumn("__span", F.col("__last") - F.col("start_ps"))
    if within is not None:
        d = d.where(F.col("__span") <= F.lit(float(within)))
    meta = F.create_map(F.lit("source_type"), F.col("type"), F.lit("repeat_count"), F.lit(str(count)), F.lit("repeat_span_ps"), fixed(F.col("__span")))
    return d.select("traj_id", "seq", "start_ps", F.col("__last").alias("end_ps"), F.col("__span").alias("duration_ps"), F.lit("REPEATS").alias("type"), "selections", meta.alias("metadata"))
