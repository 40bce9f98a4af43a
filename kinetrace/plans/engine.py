"""From a plan to a DataFrame: observables, predicates, runs, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import observables as O
from ..operators import temporal as T
from ..sources.topology import Topology
from .language import For, Relation, Repeats, event_type, selections_of
from .planner import Plan

EVENT_COLUMNS = ("traj_id", "seq", "start_ps", "end_ps", "duration_ps", "type", "selections", "metadata")


def streams(plan: Plan, frames: DataFrame, topology: Topology) -> DataFrame:
    """The events of all frame predicates of a plan; column source tells them apart."""
    bounds = list(plan.observables.values())
    values = O.observe(frames, bounds, topology)
    column_of = {b.observable.key: F.col(f"o{i}") for i, b in enumerate(bounds)}
    predicates = {f"s{i}": O.condition(s, column_of) for s, i in plan.sources.items()}
    labels = {f"s{i}": (event_type(s), selections_of(s)) for s, i in plan.sources.items()}
    runs = E.islands(values, predicates, ["traj_id"], "frame_idx", "time_ps")
    return E.events(runs, labels)


def execute(plan: Plan, frames: DataFrame, topology: Topology) -> DataFrame:
    """The events of a query, lazily.  One scan of the frames serves all predicates of the query.

    Events of several predicates are kept until the table that is returned goes.
    """
    found = streams(plan, frames, topology)
    several = len(plan.sources) > 1
    if several:
        found = found.persist()

    def build(e) -> DataFrame:
        if e in plan.sources:
            return found.where(F.col("source") == f"s{plan.sources[e]}").select(*EVENT_COLUMNS)
        if isinstance(e, For):
            return T.lasting(build(e.operand), e.duration)
        if isinstance(e, Repeats):
            return T.repeated(build(e.operand), e.count, e.within)
        assert isinstance(e, Relation)
        return T.relate(e.op, build(e.left), build(e.right), e.within)

    out = build(plan.root)
    return E.released_with(out, found) if several else out
