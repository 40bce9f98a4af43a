"""Runs of true samples on a stream: one small state for each trajectory and predicate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN = "traj_id string, source string, start_ps double, end_ps double"


class RunDetector(StatefulProcessor):
    """Emits a run when the first false sample after it comes, or an end mark (a sample with a null value).

    A sample that is no later than the last one fails the query, as in a batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "active boolean, start double, last_true double, last_time double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, start, last_true, last_time = self.state.get() if self.state.exists() else (False, 0.0, 0.0, float("-inf"))
        traj, source = key
        samples = pd.concat(list(rows)).sort_values("time_ps", kind="stable")
        out = []
        for t, value in zip(samples["time_ps"], samples["value"], strict=True):
            end_mark = value is None or pd.isna(value)
            if not end_mark:
                if not t > last_time:
                    raise ValueError(f"Trajectory frame times must be strictly increasing (received {t} after {last_time})")
                last_time = t
            if not end_mark and bool(value):
                start = start if active else t
                active, last_true = True, t
            elif active:
                out.append((traj, source, start, last_true))
                active = False
        self.state.update((active, float(start), float(last_true), float(last_time)))
        if out:
            yield pd.DataFrame(out, columns=["traj_id", "source", "start_ps", "end_ps"])

    def close(self) -> None:
        pass


def streaming_runs(samples: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(traj_id, source, start_ps, end_ps) of a stream of samples (traj_id, time_ps, ...).

    An end mark is a sample all of whose predicates are null; it closes open runs.  The
    session needs the RocksDB state store.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), p.alias("value")) for n, p in predicates.items()]))
    long = samples.select("traj_id", "time_ps", each.alias("e")).select("traj_id", "time_ps", "e.source", "e.value")
    return long.groupBy("traj_id", "source").transformWithStateInPandas(RunDetector(), RUN, "Append", "None")


class Follower(StatefulProcessor):
    """FOLLOWED_BY WITHIN on streams of runs: holds the left runs that may still be followed."""

    def __init__(self, within: float):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "start double, end double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows))
        left = [tuple(x) for x in self.open.get()] + list(zip(d.loc[d["source"] == "left", "start_ps"], d.loc[d["source"] == "left", "end_ps"], strict=True))
        right = sorted(zip(d.loc[d["source"] == "right", "start_ps"], d.loc[d["source"] == "right", "end_ps"], strict=True))
        out, keep = [], []
        latest = max([s for s, _ in right], default=float("-inf"))
        for start, end in left:
            b = next((b for b in right if b[0] >= end), None)
            if b is not None:
                if b[0] - end <= self.within:
                    out.append((key[0], min(start, b[0]), max(end, b[1]), max(0.0, b[0] - end)))
            elif not latest > end + self.within:
                keep.append((float(start), float(end)))
        self.open.put(keep)
        if out:
            yield pd.DataFrame(out, columns=["traj_id", "start_ps", "end_ps", "gap_ps"])

    def close(self) -> None:
        pass


def streaming_followed_by(runs: DataFrame, within: float) -> DataFrame:
    """(traj_id, start_ps, end_ps, gap_ps) of a stream of runs whose source is left or right.

    Right runs must come in order of their starts, and no sooner than the left runs they may follow.
    """
    return runs.groupBy("traj_id").transformWithStateInPandas(Follower(within), "traj_id string, start_ps double, end_ps double, gap_ps double", "Append", "None")
