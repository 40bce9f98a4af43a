"""Event analytics as DataFrame transforms: groups, ordered windows, sessions, range joins.

``keys`` are the columns by which statistics are told apart.  Events of different trajectories
never meet, even if traj_id is no key.  Long lists are ordered in ranges of time.  Events need start_ps, end_ps and type, and duration_ps
where durations are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import RANGE, carried, cut, extended

KEYS = ("traj_id",)


def checked_window(value: float) -> float:
    value = float(value)
    if not math.isfinite(value) or value < 0:
        raise ValueError("time window must be finite and non-negative")
    return value


ALL = "__all"


def apart(events: DataFrame, keys) -> list[str]:
    """The columns that set lists of events apart: the keys, and the trajectory in any case."""
    return [*keys, *(c for c in KEYS if c in events.columns and c not in keys)]


def in_ranges(events: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    """Events cut into ranges of time, and the keys of their lists (one made up for a single list)."""
    keys = list(keys)
    if not keys:
        events, keys = events.withColumn(ALL, F.lit(0)), [ALL]
    return cut(events, keys, F.col("start_ps")), keys


def order_of(*tie: str) -> list[Column]:
    """Events by start, end, type and then by the columns in tie."""
    return [F.col(c) for c in ("start_ps", "end_ps", "type", *tie)]


def gap(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), start - end)


def recurrence_statistics(events: DataFrame, keys=KEYS) -> DataFrame:
    """Per type: count, total, mean and median duration, mean gap to the event after (0 for a single one)."""
    d, own = in_ranges(events, [*apart(events, keys), "type"])
    order = [F.col("start_ps"), F.col("end_ps")]
    after = F.lead("start_ps").over(Window.partitionBy(*own, RANGE).orderBy(*order))
    d = extended(d.select(*dict.fromkeys([*own, *keys, RANGE, "start_ps", "end_ps", "duration_ps"])), own, order, 1)
    d = d.withColumn("__gap", F.when(after.isNotNull(), gap(after, F.col("end_ps")))).where("NOT __guest")
    return d.groupBy(*keys, "type").agg(
        F.count(F.lit(1)).alias("count"), F.sum("duration_ps").alias("total_duration_ps"), F.avg("duration_ps").alias("mean_duration_ps"),
        F.median("duration_ps").alias("median_duration_ps"), F.coalesce(F.avg("__gap"), F.lit(0.0)).alias("mean_gap_ps"),
    )


def event_frequency(events: DataFrame, observation_time_ps: float, keys=KEYS) -> DataFrame:
    """Per type: events per picosecond."""
    t = float(observation_time_ps)
    if not math.isfinite(t) or t <= 0:
        raise ValueError("observation time must be finite and positive")
    return events.groupBy(*keys, "type").agg((F.count(F.lit(1)) / F.lit(t)).alias("frequency_per_ps"))


def conditional_probability(events: DataFrame, antecedent: str, consequent: str, within_ps: float, keys=KEYS) -> DataFrame:
    """The share of antecedent events after whose end a consequent one starts within the window; 0 without any.

    The first consequent start at or after each end decides, found by one sort of both in each
    bin of twice the window; a consequent also stands in the bin before its own.
    """
    limit = checked_window(within_ps)
    own = [*apart(events, keys), "__bin"]
    place = F.floor(F.col("at") / F.lit(2 * max(limit, 1e-6)))
    a = events.where(F.col("type") == antecedent).select(*own[:-1], F.col("end_ps").alias("at"), F.lit(1).alias("is_a"), F.lit(None).cast("double").alias("start")).withColumn("__bin", place)
    b = events.where(F.col("type") == consequent).select(*own[:-1], F.col("start_ps").alias("at"), F.lit(0).alias("is_a"), F.col("start_ps").cast("double").alias("start")).withColumn("__bin", F.explode(F.array(place - 1, place)))
    w = Window.partitionBy(*own).orderBy(F.desc("at"), F.asc("is_a")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = a.unionByName(b).withColumn("start", F.last("start", ignorenulls=True).over(w)).where("is_a = 1")
    hit = F.coalesce(F.col("start") <= F.col("at") + F.lit(limit), F.lit(False))
    found = d.groupBy(*keys).agg((F.sum(hit.cast("long")) / F.count(F.lit(1))).alias("probability"))
    return events.select(*keys).distinct().join(found, list(keys), "left").fillna(0.0, ["probability"]) if keys else found


def transitions(events: DataFrame, within_ps: float | None = None, keys=KEYS, tie=()) -> DataFrame:
    """(*keys, source, target, count) of adjacent events, without zeros."""
    d, own = in_ranges(events, apart(events, keys))
    d = extended(d.select(*own, RANGE, "start_ps", "end_ps", "type", *tie), own, order_of(*tie), 1)
    w = Window.partitionBy(*own, RANGE).orderBy(*order_of(*tie))
    d = d.select(*keys, "__guest", F.col("type").alias("source"), F.lead("type").over(w).alias("target"), gap(F.lead("start_ps").over(w), F.col("end_ps")).alias("gap"))
    d = d.where("NOT __guest AND target IS NOT NULL")
    if within_ps is not None:
        d = d.where(F.col("gap") <= F.lit(checked_window(within_ps)))
    return d.groupBy(*keys, "source", "target").agg(F.count(F.lit(1)).alias("count"))


def transition_matrix(events: DataFrame, within_ps: float | None = None, keys=KEYS, tie=()) -> DataFrame:
    """The same for all pairs of types, zeros included."""
    types = events.select(*keys, "type").distinct()
    each = types.groupBy(*keys).agg(F.collect_set("type").alias("types")) if keys else types.agg(F.collect_set("type").alias("types"))
    cells = each.select(*keys, F.explode("types").alias("source"), "types").select(*keys, "source", F.explode("types").alias("target"))
    on = [*keys, "source", "target"]
    return cells.join(transitions(events, within_ps, keys, tie), on, "left").select(*on, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def motifs(events: DataFrame, length: int, within_ps: float | None = None, keys=KEYS, tie=()) -> DataFrame:
    """(*keys, motif, count): runs of so many types in order, of a span within the window."""
    if not isinstance(length, int) or isinstance(length, bool) or length <= 0:
        raise ValueError("motif length must be a positive integer")
    d, own = in_ranges(events, apart(events, keys))
    d = extended(d.select(*own, RANGE, "start_ps", "end_ps", "type", *tie), own, order_of(*tie), length - 1) if length > 1 else d.withColumn("__guest", F.lit(False))
    w = Window.partitionBy(*own, RANGE).orderBy(*order_of(*tie))
    last = F.lead("end_ps", length - 1).over(w) if length > 1 else F.col("end_ps")
    d = d.select(*keys, "__guest", F.collect_list("type").over(w.rowsBetween(0, length - 1)).alias("motif"), (last - F.col("start_ps")).alias("span"))
    d = d.where((F.size("motif") == length) & ~F.col("__guest"))
    if within_ps is not None:
        d = d.where(F.col("span") <= F.lit(checked_window(within_ps)))
    return d.groupBy(*keys, "motif").agg(F.count(F.lit(1)).alias("count"))


def recurring_subsequences(events: DataFrame, length: int, minimum_count: int = 2, within_ps: float | None = None, keys=KEYS, tie=()) -> DataFrame:
    """Motifs found so many times."""
    if not isinstance(minimum_count, int) or isinstance(minimum_count, bool) or minimum_count <= 0:
        raise ValueError("minimum_count must be a positive integer")
    return motifs(events, length, within_ps, keys, tie).where(F.col("count") >= minimum_count)


def temporal_clusters(events: DataFrame, max_gap_ps: float, keys=KEYS, tie=()) -> DataFrame:
    """(*keys, cluster, start_ps, end_ps, event_indices, types): events in order, cut where one starts later than the latest end so far plus the gap."""
    limit, shown = checked_window(max_gap_ps), apart(events, keys)
    d, own = in_ranges(events, shown)
    d = d.select(*own, RANGE, "start_ps", "end_ps", "type", *tie)
    d = carried(d, own, __reach=(F.max("end_ps"), F.max("__reach")), __count=(F.count(F.lit(1)), F.sum("__count")))
    w = Window.partitionBy(*own, RANGE).orderBy(*order_of(*tie))
    reach = F.greatest(F.max("end_ps").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    d = d.withColumns({"__i": (F.row_number().over(w) - 1 + F.coalesce("__count", F.lit(0))).cast("long"), "__cut": F.coalesce((F.col("start_ps") - reach > F.lit(limit)).cast("long"), F.lit(0))})
    d = carried(d.drop("__reach", "__count"), own, __cuts=(F.sum("__cut"), F.sum("__cuts")))
    d = d.withColumn("cluster", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce("__cuts", F.lit(0)))
    g = d.groupBy(*own, "cluster").agg(F.min("start_ps").alias("start_ps"), F.max("end_ps").alias("end_ps"), F.array_sort(F.collect_list(F.struct("__i", "type"))).alias("__e"))
    return g.select(*shown, "cluster", "start_ps", "end_ps", F.col("__e.__i").alias("event_indices"), F.col("__e.type").alias("types"))


def graph_nodes(events: DataFrame, keys=KEYS, tie=()) -> DataFrame:
    shown = apart(events, keys)
    d, own = in_ranges(events, shown)
    d = carried(d, own, __count=(F.count(F.lit(1)), F.sum("__count")))
    place = F.row_number().over(Window.partitionBy(*own, RANGE).orderBy(*order_of(*tie))) - 1 + F.coalesce("__count", F.lit(0))
    return d.select(*shown, place.cast("long").alias("id"), "type", "start_ps", "end_ps")


def graph_edges(events: DataFrame, within_ps: float | None = None, keys=KEYS, tie=()) -> DataFrame:
    """(*keys, source, target, gap_ps): later events that start at or after an event's end, within the window.

    With a window the join is by bins of that width: an event meets those of its own bin and the next.
    """
    keys = apart(events, keys)
    n = graph_nodes(events, keys, tie)
    a = n.select(*keys, F.col("id").alias("source"), F.col("end_ps").alias("__end"))
    b = n.select(*keys, F.col("id").alias("target"), F.col("start_ps").alias("__start"))
    on = list(keys)
    limit = None if within_ps is None else checked_window(within_ps)
    if limit:
        place = F.floor(F.col("__end") / F.lit(limit)).cast("long")
        a = a.withColumn("__bin", F.explode(F.array(place, place + 1)))
        b = b.withColumn("__bin", F.floor(F.col("__start") / F.lit(limit)).cast("long"))
        on.append("__bin")
    d = a.join(b, on).where((F.col("target") > F.col("source")) & (F.col("__start") >= F.col("__end")))
    d = d.withColumn("gap_ps", F.col("__start") - F.col("__end"))
    if limit is not None:
        d = d.where(F.col("gap_ps") <= F.lit(limit))
    return d.select(*keys, "source", "target", "gap_ps")
