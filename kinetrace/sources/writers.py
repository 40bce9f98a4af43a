"""Frames written as extended XYZ files."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import filesystem
from .topology import Topology

#: Frames in a file.
CHUNK = 1 << 12


def xyz_frame(elements: list[str], time_ps: float, coords: list[float], cell: list[float] | None) -> str:
    """In angstrom, with the time, and the cell if there is one; numbers as short as they read back the same."""
    comment = f"time={time_ps!r}ps" if "e" not in repr(time_ps) else f"time={time_ps:.12f}ps"
    if cell is not None:
        comment += ' Lattice="' + " ".join(repr(10 * v) for v in cell) + '"'
    atoms = (f"{e} {10 * x!r} {10 * y!r} {10 * z!r}" for e, x, y, z in zip(elements, coords[::3], coords[1::3], coords[2::3], strict=True))
    return "\n".join([str(len(elements)), comment, *atoms]) + "\n"


def write_xyz(frames: DataFrame, topology: Topology, folder: str, chunk: int = CHUNK) -> list[str]:
    """One file for so many frames of a trajectory, in their order; gives the names of the files that count.

    A repeated task writes a file of another name; what it has left before is deleted.
    """
    elements = [a.element or a.name for a in topology.atoms]
    parts = frames.withColumn("part", F.floor(F.col("frame_idx") / chunk)).repartition("traj_id", "part").sortWithinPartitions("traj_id", "part", "frame_idx")

    def run(batches):
        fs, root = filesystem(folder)
        at, out, name = None, None, ""
        for b in batches:
            for traj, part, time_ps, coords, cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (traj, part) != at:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"name": [name]})
                    at, name = (traj, part), f"{part:08d}-{uuid.uuid4().hex}.xyz"
                    out = fs.open_output_stream(f"{root}/{name}")
                out.write(xyz_frame(elements, time_ps, coords, cell).encode())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    kept = {r.name for r in parts.select("traj_id", "part", "time_ps", "coords", "cell").mapInArrow(run, "name string").collect()}  # one row a file
    fs, root = filesystem(folder)
    from pyarrow.fs import FileSelector

    for i in fs.get_file_info(FileSelector(root)):
        if i.is_file and i.base_name not in kept:
            fs.delete_file(i.path)
    return sorted(kept)
