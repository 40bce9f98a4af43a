"""DCD trajectories: frames of equal size, so that any task finds its own by arithmetic."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: Angstrom to nanometres.
SCALE = 0.1


class Damaged(ValueError):
    pass


class Header:
    """What the records before the first frame state: byte order, atoms, whether frames have a cell and a fourth coordinate."""

    def __init__(self, stream):
        head = stream.read(92)
        self.order = next((o for o in "<>" if len(head) == 92 and struct.unpack(f"{o}i", head[:4])[0] == 84), None)
        if self.order is None or head[4:8] != b"CORD":
            raise Damaged("Malformed DCD header")
        control = struct.unpack(f"{self.order}20i", head[8:88])
        if control[8]:
            raise Damaged("DCD files with fixed atoms are not supported")
        charmm = control[19] != 0
        self.has_cell, self.has_fourth = bool(charmm and control[10]), bool(charmm and control[11])
        self.record(stream)  # titles
        atoms = self.record(stream)
        if len(atoms) != 4:
            raise Damaged("Malformed DCD header")
        self.atoms = struct.unpack(f"{self.order}i", atoms)[0]
        self.bytes = stream.tell()
        self.frame_bytes = self.has_cell * 56 + (3 + self.has_fourth) * (8 + 4 * self.atoms)

    def record(self, stream) -> bytes:
        mark = stream.read(4)
        size = struct.unpack(f"{self.order}i", mark)[0] if len(mark) == 4 else -1
        data = stream.read(size + 4) if size >= 0 else b""
        if len(data) != size + 4 or data[size:] != mark:
            raise Damaged("Malformed DCD record")
        return data[:size]


def cell_of(record: bytes, order: str) -> list[float] | None:
    """Lengths and angles are A, gamma, B, beta, alpha, C; angles in degrees or as cosines. No lengths: no cell."""
    a, gamma, b, beta, alpha, c = struct.unpack(f"{order}6d", record)
    if a == b == c == 0:
        return None
    cosines = [x if abs(x) <= 1 else float(np.cos(np.radians(x))) if x != 90 else 0.0 for x in (alpha, beta, gamma)]
    sides = np.array([a, b, c]) * SCALE
    products = np.eye(3)
    for (i, j), x in zip(((1, 2), (0, 2), (0, 1)), cosines, strict=True):
        products[i, j] = products[j, i] = x
    try:
        return np.linalg.cholesky(products * np.outer(sides, sides)).ravel().tolist()
    except np.linalg.LinAlgError:
        raise Damaged("DCD cell vectors must be finite and linearly independent") from None


def frames(stream, size: int, atoms: int, part: int, parts: int) -> Iterator[tuple[int, np.ndarray, list[float] | None]]:
    """(number, coordinates in nm, cell) of one of so many parts of a file of size bytes."""
    head = Header(stream)
    if head.atoms != atoms:
        raise Damaged(f"DCD frame has {head.atoms} atoms, topology has {atoms}")
    total, rest = divmod(size - head.bytes, head.frame_bytes)
    if rest:
        raise Damaged("Truncated DCD frame")
    first, last = total * part // parts, total * (part + 1) // parts
    stream.seek(head.bytes + first * head.frame_bytes)
    for i in range(first, last):
        cell = cell_of(head.record(stream), head.order) if head.has_cell else None
        axes = [np.frombuffer(head.record(stream), f"{head.order}f4") for _ in range(3 + head.has_fourth)][:3]
        if any(len(x) != atoms for x in axes):
            raise Damaged("Malformed DCD record")
        yield i, np.stack(axes, 1).astype(np.float64).ravel() * SCALE, cell
