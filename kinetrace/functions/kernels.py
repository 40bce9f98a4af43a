"""Geometry over batches of frames: arrays of shape (frames, atoms, 3), lengths in nm.

A cell is (frames, 3, 3) with the vectors a, b, c as rows, or None.
"""

from __future__ import annotations

import numpy as np

from .units import VDW_RADIUS

#: All neighbours of a fractional offset, in ascending order of (i, j, k).
SHIFTS = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], float)
TINY = 1e-15
#: Bytes of intermediate results that a kernel holds at once.
BLOCK = 32 << 20
GOLDEN_ANGLE = 2.39996322972865332
#: Selections of more pairs than this are searched by a grid of cells.
GRID_PAIRS = 1 << 15


def tolerance(cutoff: float) -> float:
    return 1e-12 * max(1.0, abs(cutoff))


def check_cell(cell: np.ndarray) -> None:
    if not np.isfinite(cell).all() or (np.abs(np.linalg.det(cell)) <= TINY).any():
        raise ValueError("Periodic cell vectors must be finite and linearly independent")


def minimum_image(d: np.ndarray, cell: np.ndarray | None) -> np.ndarray:
    """The shortest periodic image of displacements d (frames, ..., 3); of equals the first in order of the shifts."""
    if cell is None:
        return d
    shape = d.shape
    flat = d.reshape(len(d), -1, 3)
    if not cell[:, ~np.eye(3, dtype=bool)].any():  # a box: the nearest image by each axis
        sides = cell[:, range(3), range(3)][:, None, :]
        s = flat / sides
        near = flat - np.sign(s) * np.floor(np.abs(s) + 0.5) * sides
        return np.where(2 * near == np.abs(sides), near - np.abs(sides), near).reshape(shape)
    s = np.einsum("fpc,fck->fpk", flat, np.linalg.inv(cell))
    whole = np.sign(s) * np.floor(np.abs(s) + 0.5)
    near = flat - np.einsum("fpk,fkc->fpc", whole, cell)
    best, least = None, None
    for shift in SHIFTS:
        image = near + np.einsum("k,fkc->fc", shift, cell)[:, None, :]
        length = np.einsum("fpc,fpc->fp", image, image)
        if best is None:
            best, least = image, length
        else:
            closer = length < least
            best = np.where(closer[..., None], image, best)
            least = np.where(closer, length, least)
    return best.reshape(shape)


def norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...c,...c->...", v, v))


def between(x: np.ndarray, a, b, cell: np.ndarray | None) -> np.ndarray:
    """Displacements from atoms a to atoms b."""
    return minimum_image(x[:, b] - x[:, a], cell)


def pairs(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of distinct atoms of two selections."""
    i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    apart = i != j
    return i[apart], j[apart]


def frame_blocks(frames: int, width: int):
    step = max(1, BLOCK // max(1, 8 * width))
    for at in range(0, frames, step):
        yield slice(at, at + step)


def reduced(x, cell, i, j, reduce) -> np.ndarray:
    """reduce(distances of pairs, in blocks) for each frame."""
    out = [reduce(norm(between(x[f], i, j, None if cell is None else cell[f]))) for f in frame_blocks(len(x), 12 * len(i))]
    return np.concatenate(out) if out else np.empty(0)


def grid(points: np.ndarray, cell: np.ndarray | None, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """For points (n, 3) their places in a grid whose cells are no narrower than reach, and the numbers of cells (of a periodic grid)."""
    if cell is None:
        return np.floor(points / reach).astype(np.int64), np.zeros(3, np.int64), None
    volume = abs(np.linalg.det(cell))
    heights = volume / norm(np.cross(cell[[1, 2, 0]], cell[[2, 0, 1]]))
    count = np.maximum(1, np.floor(heights / reach)).astype(np.int64)
    inside = points @ np.linalg.inv(cell)
    return np.minimum(np.floor((inside - np.floor(inside)) * count).astype(np.int64), count - 1), count, count


def close_pairs(x: np.ndarray, cell: np.ndarray | None, a, b, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Atoms (i of a, j of b, i and j different) of one frame x (atoms, 3) within cutoff, in order of a, then of b.

    Many pairs are looked for in neighbouring cells of a grid; where a periodic box has fewer
    than three cells along an axis, all pairs are compared.
    """
    a, b, limit = np.asarray(a, np.int64), np.asarray(b, np.int64), cutoff + tolerance(cutoff)
    own = None if cell is None else cell[None]
    at = np.arange(len(a)).repeat(len(b)) if len(a) * len(b) <= GRID_PAIRS else None
    if at is None:
        reach = max(limit, 1e-6) * (1 + 1e-9)
        both, _, count = grid(x[np.concatenate([a, b])], cell, reach)
        if count is not None and (count < 3).any():
            at = np.arange(len(a)).repeat(len(b))
    if at is not None:
        to = np.tile(np.arange(len(b)), len(a))
    else:
        low = both.min(0) - 1 if count is None else np.zeros(3, np.int64)
        size = both.max(0) - low + 2 if count is None else count
        number = lambda p: ((p[..., 0] * size[1]) + p[..., 1]) * size[2] + p[..., 2]
        ca, cb = both[: len(a)] - low, both[len(a) :] - low
        order = np.argsort(number(cb), kind="stable")
        keys = number(cb)[order]
        around = ca[:, None, :] + SHIFTS.astype(np.int64)[None]
        wanted = number(around if count is None else around % size).ravel()
        first, last = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        many = last - first
        at = np.arange(len(a)).repeat(len(SHIFTS)).repeat(many)
        to = order[np.arange(many.sum()) - (np.cumsum(many) - many).repeat(many) + first.repeat(many)]
    found = []
    for s in range(0, len(at), BLOCK // 100):
        p, q = at[s : s + BLOCK // 100], to[s : s + BLOCK // 100]
        near = (a[p] != b[q]) & (norm(between(x[None], a[p], b[q], own))[0] <= limit)
        found.append(np.stack([p[near], q[near]]))
    p, q = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    order = np.lexsort((q, p))
    return a[p[order]], b[q[order]]


def contacts(x: np.ndarray, cell, a, b, cutoff: float) -> list[list[tuple[int, int]]]:
    """For each frame all ordered pairs of distinct atoms within cutoff."""
    return [list(zip(*(v.tolist() for v in close_pairs(p, None if cell is None else cell[f], a, b, cutoff)), strict=True)) for f, p in enumerate(x)]


class NeighborList:
    """Contacts of successive frames from candidates within cutoff and skin, looked for anew once an atom or the cell has moved too far."""

    def __init__(self, a, b, cutoff: float, skin: float = 0.1):
        if not (cutoff >= 0 and skin >= 0 and np.isfinite([cutoff, skin]).all()):
            raise ValueError("cutoff and skin must be finite and non-negative")
        self.a, self.b, self.cutoff, self.skin, self.rebuilds, self._last = a, b, cutoff, skin, 0, None

    def contacts(self, x: np.ndarray, cell: np.ndarray | None = None) -> list[tuple[int, int]]:
        if self._last is None:
            stale = True
        else:
            old, old_cell, _ = self._last
            stale = x.shape != old.shape or (cell is None) != (old_cell is None) or cell is not None and not np.array_equal(cell, old_cell)
        if stale or 2 * norm(x - self._last[0]).max(initial=0.0) > self.skin:
            self._last = x.copy(), cell, close_pairs(x, cell, self.a, self.b, self.cutoff + self.skin)
            self.rebuilds += 1
        i, j = self._last[2]
        near = norm(between(x[None], i, j, None if cell is None else cell[None]))[0] <= self.cutoff + tolerance(self.cutoff)
        return list(zip(i[near].tolist(), j[near].tolist(), strict=True))


def by_frames(x, cell, a, b, cutoff, count) -> np.ndarray:
    """count(i, j) of the close pairs of each frame."""
    return np.array([float(count(*close_pairs(p, None if cell is None else cell[f], a, b, cutoff))) for f, p in enumerate(x)])


def in_contact(x, cell, a, b, cutoff) -> np.ndarray:
    if len(a) * len(b) > GRID_PAIRS:
        return by_frames(x, cell, a, b, cutoff, lambda i, j: len(i) > 0)
    return (least_distance(x, cell, a, b) <= cutoff + tolerance(cutoff)).astype(float)


def least_distance(x, cell, a, b) -> np.ndarray:
    i, j = pairs(a, b)
    if not len(i):
        raise ValueError("Selections contain no distinct atom pair")
    return reduced(x, cell, i, j, lambda d: d.min(1))


def within_cutoff(x, cell, i, j, cutoff, count) -> np.ndarray:
    if not len(i):
        return np.zeros(len(x))
    limit = cutoff + tolerance(cutoff)
    return reduced(x, cell, i, j, lambda d: count(d <= limit))


def contact_count(x, cell, a, b, cutoff, residues: list[tuple] | None = None) -> np.ndarray:
    """Unordered pairs of atoms, or of different residues, with a contact."""
    if len(a) * len(b) > GRID_PAIRS:
        of = np.arange(x.shape[1]) if residues is None else np.unique(np.array([f"{c}\0{n}" for c, n in residues]), return_inverse=True)[1]

        def distinct(i, j):
            p, q = of[i], of[j]
            return len(np.unique((np.minimum(p, q) * (1 + int(of.max())) + np.maximum(p, q))[p != q]))

        return by_frames(x, cell, a, b, cutoff, distinct)
    i, j = pairs(a, b)
    if residues is None:
        low, high = np.minimum(i, j), np.maximum(i, j)
        keep = np.unique(low * (1 + int(high.max(initial=0))) + high, return_index=True)[1] if len(i) else []
        return within_cutoff(x, cell, i[keep], j[keep], cutoff, lambda near: near.sum(1).astype(float))
    names = {r: k for k, r in enumerate(sorted(set(residues)))}
    of = np.array([names[r] for r in residues])
    apart = of[i] != of[j] if len(i) else np.zeros(0, bool)
    i, j = i[apart], j[apart]
    group = np.minimum(of[i], of[j]) * len(names) + np.maximum(of[i], of[j]) if len(i) else i
    order = np.argsort(group, kind="stable")
    i, j, group = i[order], j[order], group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    return within_cutoff(x, cell, i, j, cutoff, lambda near: np.logical_or.reduceat(near, starts, axis=1).sum(1).astype(float))


def coordination(x, cell, centers, neighbors, cutoff) -> np.ndarray:
    if len(centers) * len(neighbors) > GRID_PAIRS:
        return by_frames(x, cell, centers, neighbors, cutoff, lambda i, j: len(i)) / len(centers)
    i, j = pairs(centers, neighbors)
    return within_cutoff(x, cell, i, j, cutoff, lambda near: near.sum(1).astype(float)) / len(centers)


def unwrap_path(selection: list[int], bonds: list[tuple[int, int]], atoms: int) -> list[tuple[int, int]]:
    """(parent, child) steps, breadth first over bonds from the first atom selected, that reach all of them."""
    near: dict[int, list[int]] = {}
    for p, q in bonds:
        near.setdefault(p, []).append(q)
        near.setdefault(q, []).append(p)
    steps, seen, queue = [], {selection[0]}, [selection[0]]
    for at in queue:
        for to in near.get(at, ()):
            if to not in seen:
                seen.add(to)
                steps.append((at, to))
                queue.append(to)
    if not seen.issuperset(selection):
        raise ValueError("Periodic RG selection spans atoms that are not connected by bonds")
    return steps


def unwrap_bonded(x, cell, selection, bonds) -> np.ndarray:
    if cell is None or len(selection) < 2:
        return x[:, selection]
    steps = unwrap_path(selection, bonds, x.shape[1])
    placed = x.copy()
    for parent, child in steps:
        placed[:, child] = placed[:, parent] + minimum_image(x[:, child] - x[:, parent], cell)
    return placed[:, selection]


def unwrap_first(points: np.ndarray, cell) -> np.ndarray:
    """The image of each point nearest to the first."""
    if cell is None:
        return points
    anchor = points[:, :1]
    out = anchor + minimum_image(points - anchor, cell)
    out[:, 0] = points[:, 0]
    return out


def radius_of_gyration(x, cell, selection, bonds, masses=None) -> np.ndarray:
    p = unwrap_bonded(x, cell, selection, bonds)
    w = np.ones(len(selection)) if masses is None else np.asarray(masses, float)
    center = (p * w[:, None]).sum(1) / w.sum()
    d = p - center[:, None]
    return np.sqrt((np.einsum("fac,fac->fa", d, d) * w).sum(1) / w.sum())


def unit_vectors(v: np.ndarray) -> np.ndarray:
    n = norm(v)
    if (n <= TINY).any():
        raise ValueError("Zero-length vector has no direction")
    return v / n[..., None]


def angle(u: np.ndarray, v: np.ndarray, unoriented: bool = False) -> np.ndarray:
    """Degrees between vectors; between lines if unoriented."""
    n = norm(u) * norm(v)
    if (norm(u) <= TINY).any() or (norm(v) <= TINY).any():
        raise ValueError("Zero-length vector has no direction")
    c = np.einsum("...c,...c->...", u, v) / n
    return np.degrees(np.arccos(np.clip(np.abs(c) if unoriented else c, -1, 1)))


def dihedral(x, cell, a, b, c, d) -> np.ndarray:
    b1, b2, b3 = between(x, a, b, cell), between(x, b, c, cell), between(x, c, d, cell)
    n1, n2, axis = unit_vectors(np.cross(b1, b2)), unit_vectors(np.cross(b2, b3)), unit_vectors(b2)
    dot = lambda p, q: np.einsum("...c,...c->...", p, q)
    return np.degrees(np.arctan2(dot(np.cross(n1, n2), axis), dot(n1, n2)))


def hydrogen_bond(x, cell, donors, acceptors, hydrogens: dict[int, list[int]], distance, least_angle) -> np.ndarray:
    """Whether any donor with a hydrogen bonds to an acceptor, in each frame; few pairs go for all frames at once."""
    donors = [d for d in donors if hydrogens.get(d)]
    most = max((len(hydrogens[d]) for d in donors), default=0)
    table = np.array([hydrogens[d] + [-1] * (most - len(hydrogens[d])) for d in donors], np.int64).reshape(len(donors), most)
    place = {d: k for k, d in enumerate(donors)}

    def bonded(p, own, i, j) -> np.ndarray:
        """Of pairs (i, j) of close donors and acceptors in frames p (pairs, atoms, 3)."""
        row, out = np.arange(len(i)), np.zeros(len(i), bool)
        of = table[[place[d] for d in i.tolist()]] if len(i) else table[:0]
        for k in range(most):
            good = np.flatnonzero((of[:, k] >= 0) & (of[:, k] != j) & ~out)
            if len(good):
                h, r = p[row[good], of[good, k]], row[good]
                c = None if own is None else own[good]
                image = lambda v: minimum_image(v[:, None], c)[:, 0]  # noqa: B023, E731
                out[good] = angle(image(p[r, i[good]] - h), image(p[r, j[good]] - h)) + 1e-12 >= least_angle
        return out

    out = np.zeros(len(x))
    if len(donors) * len(acceptors) > GRID_PAIRS:
        for f in range(len(x)):
            own = None if cell is None else cell[f]
            i, j = close_pairs(x[f], own, donors, acceptors, distance)
            out[f] = bonded(np.broadcast_to(x[f], (len(i), *x[f].shape)), None if own is None else np.broadcast_to(own, (len(i), 3, 3)), i, j).any()
        return out
    i, j = pairs(list(donors), list(acceptors)) if donors else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for f in frame_blocks(len(x), 12 * max(1, len(i))):
        own = None if cell is None else cell[f]
        frame, pair = np.nonzero(norm(between(x[f], i, j, own)) <= distance + 1e-12)
        for s in range(0, len(frame), max(1, BLOCK // (24 * x.shape[1]))):
            g, q = frame[s : s + max(1, BLOCK // (24 * x.shape[1]))], pair[s : s + max(1, BLOCK // (24 * x.shape[1]))]
            hit = bonded(x[f][g], None if own is None else own[g], i[q], j[q])
            out[f][g[hit]] = 1.0
    return out


def helix_fraction(x, cell, residues) -> np.ndarray:
    """residues: (previous C, N, CA, C, next N) of each residue that can be judged."""
    if not residues:
        raise ValueError("HELIX requires at least one residue with complete neighboring N-CA-C backbone atoms")
    helical = np.zeros(len(x))
    for before, n, ca, c, after in residues:
        phi, psi = dihedral(x, cell, before, n, ca, c), dihedral(x, cell, n, ca, c, after)
        helical += (phi >= -100) & (phi <= -30) & (psi >= -80) & (psi <= -5)
    return helical / len(residues)


def fibonacci_sphere(n: int) -> np.ndarray:
    i = np.arange(n)
    y = 1 - 2 * (i + 0.5) / n
    r, turn = np.sqrt(np.maximum(0, 1 - y * y)), GOLDEN_ANGLE * i
    return np.stack([np.cos(turn) * r, y, np.sin(turn) * r], 1)


def accessible_surface(x, cell, selection, elements, probe, points) -> np.ndarray:
    """The area that no other atom's sphere covers; in large systems only atoms whose spheres meet are compared."""
    radius = np.array([VDW_RADIUS[e.upper()] for e in elements]) + probe
    sphere, area = fibonacci_sphere(points), np.zeros(len(x))
    if len(selection) * x.shape[1] > GRID_PAIRS:
        chosen = np.asarray(selection, np.int64)
        place = np.full(x.shape[1], -1)
        place[chosen] = np.arange(len(chosen))
        for f, p in enumerate(x):
            own = None if cell is None else cell[f][None]
            i, j = close_pairs(p, None if cell is None else cell[f], chosen, np.arange(x.shape[1]), radius[chosen].max() + radius.max())
            hidden = np.zeros((len(chosen), points), bool)
            for s in range(0, len(i), max(1, BLOCK // (27 * points * 8))):
                a, b = i[s : s + max(1, BLOCK // (27 * points * 8))], j[s : s + max(1, BLOCK // (27 * points * 8))]
                d = p[b][:, None] - (p[a][:, None] + sphere[None] * radius[a][:, None, None])
                covered = norm(minimum_image(d.reshape(1, -1, 3), own).reshape(d.shape)) < radius[b][:, None]
                np.logical_or.at(hidden, place[a], covered)
            area[f] = (4 * np.pi * radius[chosen] ** 2 * (~hidden).sum(1) / points).sum()
        return area
    others = np.arange(x.shape[1])
    for atom in selection:
        rest = others[others != atom]
        for f in frame_blocks(len(x), 27 * points * max(1, len(rest))):
            surface = x[f, atom][:, None] + sphere * radius[atom]
            d = x[f][:, None, rest] - surface[:, :, None]
            free = ~(norm(minimum_image(d, None if cell is None else cell[f])) < radius[rest]).any(2)
            area[f] += 4 * np.pi * radius[atom] ** 2 * free.sum(1) / points
    return area


def rmsd(x, cell, selection, reference, align) -> np.ndarray:
    """reference: (frames, selected atoms, 3), unwrapped by the cell of the current frame."""
    p, q = unwrap_first(x[:, selection], cell), unwrap_first(reference, cell)
    if align:
        p, q = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
        s = np.einsum("fai,faj->fij", p, q)
        skew = np.stack([s[:, 1, 2] - s[:, 2, 1], s[:, 2, 0] - s[:, 0, 2], s[:, 0, 1] - s[:, 1, 0]], 1)
        trace = np.trace(s, axis1=1, axis2=2)
        k = np.empty((len(x), 4, 4))
        k[:, 0, 0] = trace
        k[:, 0, 1:] = k[:, 1:, 0] = skew
        k[:, 1:, 1:] = s + s.transpose(0, 2, 1) - trace[:, None, None] * np.eye(3)
        turn = np.linalg.eigh(k)[1][:, :, -1]
        w, v = turn[:, 0], turn[:, 1:]
        t = 2 * np.cross(v[:, None], p)
        p = p + w[:, None, None] * t + np.cross(v[:, None], t)
    d = p - q
    return np.sqrt(np.einsum("fac,fac->f", d, d) / len(selection))


def ring_normal(p: np.ndarray) -> np.ndarray:
    """The sum of the cross products of consecutive spokes from the centre."""
    spokes = p - p.mean(1, keepdims=True)
    return np.cross(spokes, np.roll(spokes, -1, 1)).sum(1)


def stacking(x, cell, first, second, distance, most_angle) -> np.ndarray:
    p, q = unwrap_first(x[:, first], cell), unwrap_first(x[:, second], cell)
    apart = norm(minimum_image((q.mean(1) - p.mean(1))[:, None], cell)[:, 0])
    return ((apart <= distance + 1e-12) & (angle(ring_normal(p), ring_normal(q), True) <= most_angle + 1e-12)).astype(float)


def orientation(x, cell, origin, target, axis: str) -> np.ndarray:
    p, q = unwrap_first(x[:, origin], cell).mean(1), unwrap_first(x[:, target], cell).mean(1)
    way = minimum_image((q - p)[:, None], cell)[:, 0]
    return angle(way, np.broadcast_to(np.eye(3)["xyz".index(axis.lower())], way.shape), True)


def minimum_image_distance(a, b, box_nm) -> float:
    """Between two points in an orthorhombic box of three lengths."""
    return minimum_image_distance_cell(a, b, np.diag(np.asarray(box_nm, float)))


def minimum_image_distance_cell(a, b, cell_nm) -> float:
    """Between two points in a cell of three vectors."""
    cell = np.asarray(cell_nm, float).reshape(1, 3, 3)
    check_cell(cell)
    d = (np.asarray(b, float) - np.asarray(a, float)).reshape(1, 1, 3)
    return float(norm(minimum_image(d, cell))[0, 0])


def distance(a, b) -> float:
    """Between two points."""
    return float(norm(np.asarray(b, float) - np.asarray(a, float)))
