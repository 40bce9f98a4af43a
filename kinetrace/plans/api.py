"""Trajectories: load, query, explain."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.units import parse_duration
from ..sources import readers
from ..sources.topology import Topology
from .engine import execute
from .planner import Plan, plan
from .results import EventResults


class Trajectory:
    """Frames (a DataFrame of FRAMES) and the topology they share; many trajectories may lie in one table."""

    def __init__(self, frames: DataFrame, topology: Topology):
        self.frames, self._topology, self._plans = frames, topology, {}

    @property
    def topology(self) -> Topology:
        return self._topology

    @topology.setter
    def topology(self, value: Topology) -> None:
        """Plans hold for one topology."""
        self._topology = value
        self._plans.clear()

    def _plan(self, text: str) -> Plan:
        if text not in self._plans:
            self._plans[text] = plan(text, self._topology)
        return self._plans[text]

    def query(self, text: str) -> EventResults:
        return EventResults(execute(self._plan(text), self.frames, self._topology))

    def explain(self, text: str) -> dict:
        return self._plan(text).explanation()

    @property
    def cached_plan_count(self) -> int:
        return len(self._plans)

    def clear_plan_cache(self) -> None:
        self._plans.clear()


def load(trajectory: str | Path, *, topology: str | Path | Topology, default_timestep: str = "1ps", spark: SparkSession | None = None) -> Trajectory:
    """Open a trajectory with atoms and bonds from a PDB topology."""
    if not isinstance(default_timestep, str):
        raise TypeError("default_timestep must be a duration string with explicit units")
    step = parse_duration(default_timestep)
    if step <= 0:
        raise ValueError("default_timestep must be positive")
    spark = spark or SparkSession.builder.getOrCreate()
    own = topology if isinstance(topology, Topology) else Topology.from_pdb(str(topology))
    return Trajectory(readers.frames(spark, str(trajectory), own, step), own)
