"""Event extraction: maximal runs of true samples, found by chunks so that one long trajectory spreads over many tasks."""

from __future__ import annotations

import contextlib
import weakref

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of one trajectory that a task orders at a time.
CHUNK = 1 << 16
#: seq orders a list of events: the place of the first sample, for composites the places of all their parts in turn.
EVENT = "traj_id string, seq array<long>, start_ps double, end_ps double, duration_ps double, type string, selections array<string>, metadata map<string,string>"
#: The group of the two samples at the borders of a chunk.
BORDER = -1


def islands(samples: DataFrame, predicates: dict[str, Column], part: list[str], order: str, time: str, chunk: int = CHUNK) -> DataFrame:
    """(*part, source, place, start, end): a row for each maximal run of samples for which a predicate is true.

    order: the place of a sample in its part, by which chunks are cut; time: what start and
    end give, which must grow strictly with it and be finite.  A null predicate is false.
    The samples are read, and their predicates evaluated, once.  Runs inside a chunk are
    finished there; of each chunk only its borders and the runs that touch them (three rows
    a predicate at most) meet those of the other chunks.
    """
    names = list(predicates)
    own = [*part, "__chunk"]
    base = samples.select(*part, F.col(order).alias("__at"), F.col(time).alias("__time"), *[F.coalesce(p, F.lit(False)).alias(f"__p{i}") for i, p in enumerate(predicates.values())])
    base = base.withColumn("__chunk", F.floor(F.col("__at") / F.lit(chunk)).cast("long"))
    w, whole = Window.partitionBy(*own).orderBy("__at"), Window.partitionBy(*own)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = base.select("*", F.row_number().over(w).alias("__n"), F.count(F.lit(1)).over(whole).alias("__rows"), F.lag("__time").over(w).alias("__before"), *[F.sum((~F.col(f"__p{i}")).cast("long")).over(running).alias(f"__g{i}") for i in range(len(names))])
    number = F.col("__time").cast("double")
    finite = ~(F.isnan(number) | (F.abs(number) == float("inf"))) & F.col("__time").isNotNull()
    wrong = F.when(~finite, F.raise_error(F.lit("Trajectory frame time must be finite"))).when(F.col("__before") >= F.col("__time"), not_growing("__time", "__before"))
    d = d.where(wrong.isNull())
    first, last = F.col("__n") == 1, F.col("__n") == F.col("__rows")
    element = lambda i, p, g: F.struct(F.lit(i).alias("s"), p.alias("p"), g.alias("g"))
    runs = [element(i, F.col(f"__p{i}"), F.col(f"__g{i}")) for i in range(len(names))]
    borders = [element(i, first | last, F.lit(BORDER).cast("long")) for i in range(len(names))]
    long = d.select(*own, "__n", "__rows", "__time", "__at", F.explode(F.array(*runs, *borders)).alias("__e")).where("__e.p")
    found = long.groupBy(*own, F.col("__e.s").alias("__s"), F.col("__e.g").alias("__g")).agg(F.min("__at").alias("place"), F.min("__time").alias("start"), F.max("__time").alias("end"), (F.min("__n") == 1).alias("__opens"), (F.max("__n") == F.max("__rows")).alias("__closes"))
    is_border = F.col("__g") == BORDER
    # Runs inside a chunk stay with it; the others meet in order: the borders of a chunk, the run that opens it, the one that closes it.
    found = found.withColumn("__salt", F.when(~is_border & ~F.col("__opens") & ~F.col("__closes"), F.col("__chunk")))
    r = Window.partitionBy(*part, "__s", "__salt").orderBy("__chunk", (~is_border).cast("int"), "start")
    until = F.last(F.when(is_border, F.col("end")), ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = F.col("__opens") & ~is_border & (F.lag("__g", 2).over(r) != BORDER) & F.lag("__closes", 2).over(r)
    found = found.withColumns({"__until": until, "__new": (~is_border & ~F.coalesce(goes_on, F.lit(False))).cast("long")})
    found = found.where(F.when(is_border & (F.col("__until") >= F.col("start")), not_growing("start", "__until")).isNull())
    found = found.withColumn("__run", F.sum("__new").over(r.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(~is_border)
    named = F.element_at(F.array(*map(F.lit, names)), F.col("__s") + 1)
    out = found.groupBy(*part, "__s", "__salt", "__run").agg(F.min("place").alias("place"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(*part, named.alias("source"), "place", "start", "end")


def released_with(out: DataFrame, held: DataFrame) -> DataFrame:
    """out, which reads the cached table held: that is given up when out goes."""

    def release() -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            held.unpersist()

    weakref.finalize(out, release).atexit = False
    return out


def not_growing(time: str, before: str) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.raise_error(F.concat(F.lit("Trajectory frame times must be strictly increasing (received "), text(time), F.lit(" after "), text(before), F.lit(")")))


def events(runs: DataFrame, labels: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Runs of (traj_id, source, place, start, end) as events; labels: type and selections of each source. Places order a list."""
    pick = lambda make: F.coalesce(*[F.when(F.col("source") == s, make(v)) for s, v in labels.items()])
    return runs.select(
        "source", "traj_id", F.array(F.col("place").cast("long")).alias("seq"), F.col("start").cast("double").alias("start_ps"), F.col("end").cast("double").alias("end_ps"), (F.col("end") - F.col("start")).cast("double").alias("duration_ps"),
        pick(lambda v: F.lit(v[0])).alias("type"), pick(lambda v: F.array(*map(F.lit, v[1])) if v[1] else F.array().cast("array<string>")).alias("selections"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
