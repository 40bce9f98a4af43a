"""Observables: one Arrow stage from frames to a column of doubles for each distinct observable."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.language import Comparison, Observable
from ..plans.planner import Bound
from ..sources.topology import Topology

FRAMES = "traj_id string, frame_idx long, time_ps double, coords array<double>, cell array<double>"
#: First frames are broadcast up to so many bytes.
FIRST_BYTES = 64 << 20
Kernel = Callable[[np.ndarray, np.ndarray | None, np.ndarray | None], np.ndarray]


def helix_residues(atoms, selection) -> list[tuple[int, ...]]:
    """(previous C, N, CA, C, next N) of each residue whose neighbours in number lie in the same chain of the selection."""
    backbone: dict[tuple[str, int], dict[str, int]] = {}
    for i in selection:
        backbone.setdefault((atoms[i].chain, atoms[i].residue_index), {})[atoms[i].name.upper()] = i
    out = []
    for (chain, number), own in sorted(backbone.items()):
        before, after = backbone.get((chain, number - 1), {}), backbone.get((chain, number + 1), {})
        if "C" in before and "N" in after and {"N", "CA", "C"} <= own.keys():
            out.append((before["C"], own["N"], own["CA"], own["C"], after["N"]))
    return out


def kernel(bound: Bound, topology: Topology) -> Kernel:
    """The function of (coordinates, cell, first frame) that gives an observable's values."""
    o, atoms, every, bonds = bound.observable, [list(a) for a in bound.atoms], topology.atoms, list(topology.bonds)
    opt = dict(o.options)
    if o.name in ("DISTANCE", "SURFACE_DISTANCE"):
        return lambda x, cell, ref: K.least_distance(x, cell, *atoms)
    if o.name in ("CONTACT", "SALT_BRIDGE"):
        return lambda x, cell, ref: K.in_contact(x, cell, *atoms, opt["cutoff"])
    if o.name == "CONTACT_COUNT":
        residues = [(a.chain, a.residue_index) for a in every] if opt["mode"] == "residue" else None
        return lambda x, cell, ref: K.contact_count(x, cell, *atoms, opt["cutoff"], residues)
    if o.name == "RG":
        masses = [every[i].mass_da for i in atoms[0]] if opt["mass_weighted"] else None
        return lambda x, cell, ref: K.radius_of_gyration(x, cell, atoms[0], bonds, masses)
    if o.name == "HBOND":
        hydrogens: dict[int, list[int]] = {}
        for a, b in bonds:
            for d, h in ((a, b), (b, a)):
                if every[h].element.upper() == "H":
                    hydrogens.setdefault(d, []).append(h)
        return lambda x, cell, ref: K.hydrogen_bond(x, cell, *atoms, hydrogens, opt["distance"], opt["min_angle"])
    if o.name == "DIHEDRAL":
        return lambda x, cell, ref: K.dihedral(x, cell, *(a[0] for a in atoms))
    if o.name == "HELIX":
        residues = helix_residues(every, atoms[0])
        return lambda x, cell, ref: (K.helix_fraction(x, cell, residues) >= opt["minimum_fraction"]).astype(float)
    if o.name == "SASA":
        elements = [a.element for a in every]
        return lambda x, cell, ref: K.accessible_surface(x, cell, atoms[0], elements, opt["probe"], opt["points"])
    if o.name == "RMSD":
        return lambda x, cell, ref: K.rmsd(x, cell, atoms[0], ref[:, atoms[0]], opt["align"])
    if o.name == "COORDINATION_NUMBER":
        return lambda x, cell, ref: K.coordination(x, cell, *atoms, opt["cutoff"])
    if o.name == "AROMATIC_STACKING":
        return lambda x, cell, ref: K.stacking(x, cell, *atoms, opt["distance"], opt["max_angle"])
    return lambda x, cell, ref: K.orientation(x, cell, *atoms, opt["axis"])


def coordinates(column: pa.Array, atoms: int, what: str) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    wrong = lengths[lengths != 3 * atoms]
    if column.null_count or len(wrong):
        raise ValueError(f"{what} has {int(wrong[0]) // 3 if len(wrong) else 0} atoms, topology has {atoms}")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), atoms, 3)
    if not np.isfinite(x).all():
        raise ValueError("Coordinates must be finite")
    return x


def values(x: np.ndarray, cells: list, ref: np.ndarray | None, kernels: list[Kernel]) -> list[np.ndarray]:
    """The values of all kernels; frames with and without a cell go apart."""
    periodic = np.array([c is not None for c in cells])
    out = [np.empty(len(x)) for _ in kernels]
    for own in (np.flatnonzero(~periodic), np.flatnonzero(periodic)):
        if not len(own):
            continue
        cell = None
        if periodic[own[0]]:
            cell = np.array([cells[i] for i in own], float).reshape(-1, 3, 3)
            K.check_cell(cell)
        for o, k in zip(out, kernels, strict=True):
            o[own] = k(x[own], cell, None if ref is None else ref[own])
    return out


def observe(frames: DataFrame, bounds: list[Bound], topology: Topology) -> DataFrame:
    """(traj_id, frame_idx, time_ps, o0, o1, ...): the values of the observables in each frame.

    Coordinates reach Python once, whatever the number of observables, and don't come back.
    The first frame of each trajectory is only looked up if an RMSD wants it.
    """
    kernels, atoms = [kernel(b, topology) for b in bounds], len(topology.atoms)
    wants_first = any(b.observable.name == "RMSD" for b in bounds)
    columns = ["traj_id", "frame_idx", "time_ps", "coords", "cell"]
    if wants_first:
        # One row a trajectory of known length: many trajectories are joined by a shuffle of their own first frames only.
        first = frames.groupBy("traj_id").agg(F.min_by("coords", "frame_idx").alias("first_coords"))
        few = first.limit(1 + FIRST_BYTES // (24 * max(atoms, 1))).count() * 24 * max(atoms, 1) <= FIRST_BYTES
        frames = frames.join(F.broadcast(first) if few else first, "traj_id")
        columns.append("first_coords")
    names = ["traj_id", "frame_idx", "time_ps", *(f"o{i}" for i in range(len(bounds)))]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = coordinates(b.column(3), atoms, "Frame")
            ref = coordinates(b.column(5), atoms, "First frame") if wants_first else None
            got = values(x, b.column(4).to_pylist(), ref, kernels)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *map(pa.array, got)], names=names)

    return frames.select(*columns).mapInArrow(run, "traj_id string, frame_idx long, time_ps double" + "".join(f", o{i} double" for i in range(len(bounds))))


def condition(e, column_of: dict):
    """A frame predicate as a Column; column_of has an observable's column by its key."""
    if isinstance(e, Observable):
        return column_of[e.key] != 0
    if isinstance(e, Comparison):
        v, t = column_of[e.operand.key], F.lit(float(e.threshold))
        return {"<": v < t, "<=": v <= t, ">": v > t, ">=": v >= t, "==": v == t, "!=": v != t}[e.op]
    a, b = condition(e.left, column_of), condition(e.right, column_of)
    return a & b if e.op == "AND" else a | b
