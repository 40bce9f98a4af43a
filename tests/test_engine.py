import math

import numpy as np
import pytest

from kinetrace import load
from kinetrace.functions.selection import Atom
from kinetrace.operators.observables import FRAMES
from kinetrace.plans.api import Trajectory
from kinetrace.plans.cli import main
from kinetrace.sources import readers
from kinetrace.sources.topology import Topology

PDB_ATOM = "{:6}{:5d}  {:<3} {:3} {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00          {:>2}"


def pdb(path, atoms, extra=()):
    path.write_text("\n".join([*(PDB_ATOM.format("ATOM", i + 1, *a) for i, a in enumerate(atoms)), *extra, "END", ""]))
    return path


def xyz(path, frames, comments):
    path.write_text("".join(f"{len(f)}\n{c}\n" + "".join(f"C {x} {y} {z}\n" for x, y, z in f) for f, c in zip(frames, comments, strict=True)))
    return path


@pytest.fixture
def switching(tmp_path, spark):
    top = pdb(tmp_path / "s.pdb", [("CA", "ARG", "A", 17, 0, 0, 0, "C"), ("CA", "ASP", "A", 42, 3, 0, 0, "C"), ("CA", "GLU", "A", 53, 8, 0, 0, "C")])
    xs = [(3, 8), (3.5, 7), (4, 4), (7, 3.5), (8, 3), (8, 8)]
    traj = xyz(tmp_path / "s.xyz", [[(0, 0, 0), (a, 0, 0), (b, 0, 0)] for a, b in xs], [f"time={i * 1000}ps and more" for i in range(6)])
    return load(traj, topology=top, spark=spark), str(top), str(traj)


C42, C53 = "CONTACT(resid 17, resid 42)", "CONTACT(resid 17, resid 53)"


@pytest.mark.parametrize(("query", "expected"), [
    (f"{C42} FOLLOWED_BY {C53} WITHIN 3ns", [(0, 4000)]), (C42, [(0, 2000)]), (f"{C42} FOR >= 2ns", [(0, 2000)]), (f"{C42} FOR >= 2001ps", []),
    ("CONTACT(resid 17, resid 42, 0.35nm)", [(0, 1000)]), ("CONTACT_COUNT(resid 17, resid 42) >= 1", [(0, 2000)]), (f"{C42} REPEATS >= 1 WITHIN 3ns", [(0, 2000)]), (f"{C42} REPEATS >= 2", []),
    (f"{C42} DURING ({C42} OR {C53})", [(0, 4000)]), (f"{C42} IMMEDIATELY_FOLLOWED_BY {C53}", [(0, 4000)]), (f"{C42} UNTIL {C53}", [(0, 4000)]), (f"{C42} OVERLAPS {C53}", [(0, 4000)]),
    (f"{C42} BEFORE {C53}", [(0, 4000)]), (f"{C42} PRECEDES {C53}", []), (f"{C53} AFTER {C42}", [(0, 4000)]), (f"{C42} AND {C53}", [(2000, 2000)]), ("DISTANCE(resid 17, resid 42) <= 0.3nm", []), ("CONTACT(resid 17, resid 42, cutoff=0.3nm)", [(0, 0)]),
    ("RMSD(protein, align=false) > 0.01nm", [(1000, 5000)]), ("COORDINATION_NUMBER(resid 17, resid 42:53, cutoff=0.4nm) >= 2", [(2000, 2000)]), ("SASA(resid 17, points=24) > 0nm2", [(0, 5000)]),
])
def test_queries(switching, query, expected):
    assert [(e.start_ps, e.end_ps) for e in switching[0].query(f"FIND {query}")] == expected


def test_records_and_metadata(switching):
    r = switching[0].query(f"FIND {C42} FOLLOWED_BY {C53} WITHIN 3ns").to_records()
    assert r == [{"start_ps": 0.0, "end_ps": 4000.0, "duration_ps": 4000.0, "type": "FOLLOWED_BY", "selections": ["resid 17", "resid 42", "resid 53"], "metadata": {"left_type": "CONTACT(resid 17,resid 42)", "right_type": "CONTACT(resid 17,resid 53)", "transition_gap_ps": "0.000000"}}]
    assert switching[0].query(f"FIND {C42} REPEATS >= 1").to_records()[0]["metadata"] == {"source_type": "CONTACT(resid 17,resid 42)", "repeat_count": "1", "repeat_span_ps": "2000.000000"}


def test_plan_cache_and_cli(switching, capsys):
    t, top, traj = switching
    t.query(f"FIND {C42}"), t.explain(f"FIND {C42}"), t.query(f"FIND {C53}")
    assert t.cached_plan_count == 2
    t.clear_plan_cache()
    assert t.cached_plan_count == 0
    assert main(["query", "--topology", top, "--trajectory", traj, "--query", f"FIND {C42}", "--format", "json"]) == 0
    assert '"end_ps": 2000.0' in capsys.readouterr().out
    assert main(["explain", "--topology", top, "--query", f"FIND {C42}"]) == 0
    assert "Streaming: yes" in (out := capsys.readouterr().out) and "Plan:" in out
    assert main(["query", "--topology", top, "--trajectory", traj, "--query", "FIND nonsense"]) == 2
    assert main(["query", "--topology", top, "--trajectory", traj, "--query", f"FIND {C42}", "--format", "csv"]) == 0
    assert "selections,metadata" in capsys.readouterr().out


def test_readers(tmp_path, spark):
    two = [("CA", "ARG", "A", 1, 1, 0, 0, "C"), ("CA", "ASP", "A", 2, 19, 0, 0, "C")]
    top = pdb(tmp_path / "p.pdb", two, ["CONECT    1    2", "CONECT    2    1"])
    t = Topology.from_pdb(top)
    assert t.bonds == ((0, 1),) and t.atoms[0].mass_da == 12.011
    traj = xyz(tmp_path / "p.xyz", [[(1, 0, 0), (19, 0, 0)], [(2, 0, 0), (18, 0, 0)]], ["time=0ps box=20,20,20A", 'time=1ps Lattice="20 0 0 0 20 0 0 0 20" Properties=species:S:1:pos:R:3'])
    p = load(traj, topology=top, spark=spark)
    assert [(e.start_ps, e.end_ps) for e in p.query("FIND CONTACT(resid 1, resid 2, cutoff=0.4nm)")] == [(0, 1)]
    assert [(e.start_ps, e.end_ps) for e in p.query("FIND RG(protein) < .11nm".replace(" .", " 0."))] == [(0, 0)]
    # Runs of one frame each, compressed files, folders, default time steps.
    many = readers.frames(spark, str(traj), t, run_bytes=1)
    assert many.rdd.getNumPartitions() == 2 and many.orderBy("frame_idx").collect() == readers.frames(spark, str(traj), t).orderBy("frame_idx").collect()
    import gzip

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "q.xyz.gz").write_bytes(gzip.compress(b"2\n\nC 1 0 0\nC 4 0 0\n\n2\n\nC 1 0 0\nC 5 0 0\n"))
    q = load(tmp_path / "d", topology=top, default_timestep="2.5ps", spark=spark)
    assert [(e.start_ps, e.end_ps) for e in q.query("FIND CONTACT(resid 1, resid 2)")] == [(0, 2.5)]
    models = tmp_path / "m.pdb"
    atom = [PDB_ATOM.format("ATOM", i, "CA", r, "A", k, x, 0, 0, "C") for i, r, k, x in ((1, "ARG", 1, 1), (2, "ASP", 2, 4), (3, "ARG", 1, 1), (4, "ASP", 2, 5))]
    models.write_text("\n".join(["CRYST1   20.000   20.000   20.000  90.00  90.00  60.00 P 1           1", "MODEL        1", *atom[:2], "ENDMDL", "MODEL        2", *atom[2:], "ENDMDL", "END"]))
    for size in (1, 1 << 20):
        rows = readers.frames(spark, str(models), Topology.from_pdb(models), 2.0, size).orderBy("frame_idx").collect()
        assert [r.time_ps for r in rows] == [0, 2] and math.isclose(rows[1].cell[3], 1.0) and rows[1].coords[3] == 0.5
    gro = tmp_path / "g.gro"
    gro.write_text("".join(f"sys t= {k}.0\n    2\n" + "".join(f"{1:5d}{'ARG':<5}{'CA':>5}{i:5d}{x:8.3f}{0:8.3f}{0:8.3f}\n" for i, x in ((1, 0.1), (2, 0.2 + k))) + "   2.0   2.0   2.0\n" for k in range(2)))
    assert [r.coords[3] for r in readers.frames(spark, str(gro), t).orderBy("frame_idx").collect()] == [0.2, 1.2]
    dump = tmp_path / "l.lammpstrj"
    dump.write_text("ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 20\n0 20\n0 20\nITEM: ATOMS id x y z\n2 4 0 0\n1 1 0 0\n")
    assert readers.frames(spark, str(dump), t).first().coords[:4] == [0.1, 0, 0, 0.4]


def many_frames(kind, n):
    """n frames of two atoms whose numbers tell their place; comments and titles look like counts."""
    out = []
    for k in range(n):
        if kind == "xyz":
            out.append(f"2\n{2 if k % 3 else 'time=' + str(k) + 'ps'}\nC {k} 0 0\n2 {k} 1 1\n" + "\n" * (k % 4 == 1))
        elif kind == "pdb":
            cell = f"CRYST1{20 + k:9.3f}{20:9.3f}{20:9.3f}  90.00  90.00  90.00 P 1           1\n" if k % 5 == 0 else ""
            out.append(cell + f"MODEL {k:8d}\n" + "".join(PDB_ATOM.format("ATOM", i, "CA", "ARG", "A", i, k, i, 0, "C") + "\n" for i in (1, 2)) + "ENDMDL\n")
        elif kind == "gro":
            out.append(f"2\n2\n" + "".join(f"{1:5d}{'ARG':<5}{'CA':>5}{i:5d}{k:8.3f}{i:8.3f}{0:8.3f}\n" for i in (1, 2)) + "   2.0   2.0   2.0\n")
        else:
            out.append(f"ITEM: TIMESTEP\n{k}\nITEM: NUMBER OF ATOMS\n2\nITEM: ATOMS id x y z\n1 {k} 0 0\n2 {k} 1 1\n")
    return "".join(out) + "END\n" * (kind == "pdb")


@pytest.mark.parametrize("kind", ["xyz", "pdb", "gro", "lammpstrj"])
def test_ranges_of_bytes_give_the_same_frames(tmp_path, spark, kind):
    path = tmp_path / f"many.{kind}"
    path.write_text(many_frames(kind, 40))
    t = Topology.of([Atom(0, "CA", "ARG", 1, "A", "C"), Atom(1, "CA", "ARG", 2, "A", "C")])
    whole = readers.frames(spark, str(path), t).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in whole] == list(range(40)) and [round(r.coords[0] * (1 if kind == "gro" else 10)) for r in whole] == list(range(40))
    if kind == "pdb":
        assert [round(r.cell[0] * 10) for r in whole] == [20 + 5 * (k // 5) for k in range(40)]
    for size in (97, 400, 700):
        cut = readers.frames(spark, str(path), t, run_bytes=size)
        assert cut.rdd.getNumPartitions() > 1 and cut.orderBy("frame_idx").collect() == whole


def dcd_bytes(order, frames, cell=None, atoms=2, fixed=0):
    """A file of frames (atoms, 3) in angstrom, with the records of the common molecular dynamics programs."""
    import struct

    def record(data):
        mark = struct.pack(f"{order}i", len(data))
        return mark + data + mark

    control = [len(frames), 0, 1, 0, 0, 0, 0, 0, fixed, 0, int(cell is not None), *[0] * 8, 24]
    out = record(b"CORD" + struct.pack(f"{order}20i", *control)) + record(struct.pack(f"{order}i", 1) + b"title".ljust(80)) + record(struct.pack(f"{order}i", atoms))
    for f in frames:
        if cell is not None:
            out += record(struct.pack(f"{order}6d", *cell))
        for axis in range(3):
            out += record(np.array(f, f"{order}f4")[:, axis].tobytes())
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_dcd(tmp_path, spark, order):
    two = Topology.of([Atom(0, "CA", "ARG", 1, "A", "C"), Atom(1, "CA", "ASP", 2, "A", "C")])
    places = [[(k, 0, 0), (k + 3, 1, 2)] for k in range(50)]
    path = tmp_path / "t.dcd"
    path.write_bytes(dcd_bytes(order, places, (20.0, 60.0, 20.0, 90.0, 90.0, 30.0)))
    for size in (300, 1700, 1 << 20):
        df = readers.frames(spark, str(path), two, 2.0, size)
        rows = df.orderBy("frame_idx").collect()
        assert [(r.frame_idx, r.time_ps) for r in rows] == [(k, 2.0 * k) for k in range(50)] and (size == 1 << 20 or df.rdd.getNumPartitions() > 1)
        assert all(np.allclose(r.coords, np.ravel(places[k]) * 0.1) and np.allclose(r.cell, [2, 0, 0, 1, math.sqrt(3), 0, 0, 0, 3]) for k, r in enumerate(rows))
    path.write_bytes(dcd_bytes(order, places[:3]))
    assert [r.cell for r in readers.frames(spark, str(path), two).collect()] == [None] * 3
    t = load(path, topology=two, spark=spark)
    assert [(e.start_ps, e.end_ps) for e in t.query("FIND CONTACT(resid 1, resid 2, cutoff=0.4nm)")] == [(0, 2)]
    for damage, message in ((dcd_bytes(order, places)[:-5], "Truncated DCD frame"), (b"junk" * 40, "Malformed DCD header"), (dcd_bytes(order, places, fixed=1), "fixed atoms"), (dcd_bytes(order, [[(0, 0, 0)] * 3], atoms=3), "has 3 atoms")):
        path.write_bytes(damage)
        with pytest.raises(Exception, match=message):
            readers.frames(spark, str(path), two).collect()


def test_plans_read_no_file(tmp_path, spark, monkeypatch):
    """Runs are made of what tasks report; damage inside a range is met by the run before it."""
    path = tmp_path / "many.xyz"
    text = many_frames("xyz", 40)
    path.write_text(text.replace("C 20 0 0", "C 20 0"))
    t = Topology.of([Atom(0, "CA", "ARG", 1, "A", "C"), Atom(1, "CA", "ARG", 2, "A", "C")])
    df = readers.frames(spark, str(path), t, run_bytes=200)
    with pytest.raises(Exception, match="Malformed XYZ coordinate"):
        df.collect()

    def refuse(*_):
        raise AssertionError("the driver reads a file")

    monkeypatch.setattr(readers, "opened", refuse)
    options = {"path": str(path), "atoms": "2", "step": "1.0"}
    assert len(readers.FramesReader(options).partitions()) == 1
    assert len(readers.planned_runs(spark, [(str(path), 100)], 2, 200)) == 1


@pytest.mark.parametrize(("name", "text", "message"), [
    ("a.xyz", "3\n\nC 0 0 0\n", "XYZ frame has 3 atoms"), ("a.xyz", "2\n\nC 0 0 0\n", "Truncated XYZ frame"), ("a.xyz", "x\n", "Malformed XYZ atom count"), ("a.xyz", "2\n\nC 0 0\nC 0 0 0\n", "Malformed XYZ coordinate"),
    ("a.xyz", '2\nLattice="1 2"\nC 0 0 0\nC 0 0 0\n', "Malformed extended XYZ Lattice"), ("a.xyz", "2\nbox=1,2\nC 0 0 0\nC 0 0 0\n", "Malformed XYZ box"), ("a.pdb", "MODEL        1\n", "MODEL is missing ENDMDL"), ("a.xtc", "", "requires an optional backend"), ("a.foo", "", "Unsupported trajectory format"),
])
def test_reader_errors(tmp_path, spark, name, text, message):
    (tmp_path / name).write_text(text)
    t = Topology.of([Atom(0, "CA", "ARG", 1, "A", "C"), Atom(1, "CA", "ASP", 2, "A", "C")])
    with pytest.raises(Exception, match=message):
        readers.frames(spark, str(tmp_path / name), t).collect()


def trajectory(spark, atoms, frames, bonds=(), cell=None, times=None):
    rows = [("t", i, float(times[i] if times else i), [float(v) for p in f for v in p], cell) for i, f in enumerate(frames)]
    return Trajectory(spark.createDataFrame(rows, FRAMES), Topology.of([Atom(i, *a) for i, a in enumerate(atoms)], bonds))


def found(t, query):
    return [(e.start_ps, e.end_ps) for e in t.query(f"FIND {query}")]


def test_observables(spark):
    h = trajectory(spark, [("N", "SER", 1, "A", "N"), ("H", "SER", 1, "A", "H"), ("O", "ASP", 2, "A", "O")], [[(0, 0, 0), (0.1, 0, 0), (0.3, 0, 0)], [(0, 0, 0), (0, 0.1, 0), (0.3, 0, 0)]], [(0, 1)])
    assert found(h, "HBOND(name N, name O)") == [(0, 0)]
    assert found(h, "COORDINATION_NUMBER(name N, name H or name O, 0.3nm) == 2") == [(0, 1)]
    assert found(h, "SALT_BRIDGE(name N, name O, 0.3nm)") == [(0, 1)] and found(h, "SURFACE_DISTANCE(name N, name O) <= 0.3nm") == [(0, 1)]
    tri = [(0, 0, 0), (0.4, 0, 0), (0, 0.4, 0)]
    rings = trajectory(spark, [("C", "PHE", r, "A", "C") for r in (1, 1, 1, 2, 2, 2)], [[*tri, *((x, y, 0.4) for x, y, _ in tri)]])
    assert found(rings, "AROMATIC_STACKING(resid 1, resid 2)") == [(0, 0)] and found(rings, "ORIENTATION(resid 1, resid 2, axis=z) < 0.001deg") == [(0, 0)]
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    moved = [tuple(turn @ np.array(p) + (3, 2, 1)) for p in tri]
    r = trajectory(spark, [("C", "PHE", 1, "A", "C")] * 3, [tri, moved])
    assert found(r, "RMSD(resid 1) < 0.000001nm") == [(0, 1)] and found(r, "RMSD(resid 1, align=false) > 1nm") == [(1, 1)]
    d = trajectory(spark, [("C", "XXX", i, "A", "C") for i in range(1, 5)], [[(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1)]])
    assert found(d, "DIHEDRAL(resid 1, resid 2, resid 3, resid 4) < -89deg") == [(0, 0)]
    one = trajectory(spark, [("C", "XXX", 1, "A", "C")], [[(0, 0, 0)]])
    area = 4 * math.pi * 0.31**2
    assert found(one, f"SASA(resid 1) > {area - 1e-9:.10f}nm2") == [(0, 0)] and found(one, f"SASA(resid 1) > {area + 1e-9:.10f}nm2") == []
    with pytest.raises(Exception, match="no distinct atom pair"):
        found(one, "DISTANCE(resid 1, resid 1) > 0nm")
    assert found(one, "CONTACT_COUNT(resid 1, resid 1) == 0") == [(0, 0)]


def test_periodic(spark):
    atoms, box = [("C", "A", 1, "A", "C"), ("O", "A", 2, "A", "O")], [2, 0, 0, 0, 2, 0, 0, 0, 2.0]
    p = trajectory(spark, atoms, [[(0.1, 0, 0), (1.9, 0, 0)]], [(0, 1)], [float(v) for v in box])
    assert found(p, "DISTANCE(resid 1, resid 2) < 0.2000001nm") == [(0, 0)] and found(p, "RG(protein) < 0.1000001nm") == [(0, 0)]
    loose = trajectory(spark, atoms, [[(0.1, 0, 0), (1.9, 0, 0)]], [], [float(v) for v in box])
    with pytest.raises(Exception, match="not connected by bonds"):
        found(loose, "RG(protein) < 1nm")


def test_times(spark):
    atoms = [("C", "A", 1, "A", "C"), ("O", "A", 2, "A", "O")]
    close, q = [(0, 0, 0), (0.1, 0, 0)], "CONTACT(resid 1, resid 2)"
    assert found(trajectory(spark, atoms, [close] * 3, times=[0, 3, 10]), f"{q} FOR >= 10ps") == [(0, 10)]
    assert found(trajectory(spark, atoms, [close], times=[7]), q) == [(7, 7)]
    for times in ([0, 0], [1, 0], [0, float("nan")], [float("inf"), 0]):
        with pytest.raises(Exception, match="strictly increasing|must be finite"):
            found(trajectory(spark, atoms, [close] * 2, times=times), q)
