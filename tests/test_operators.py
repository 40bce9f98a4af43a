import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinetrace.functions import kernels as K
from kinetrace.operators import analytics as A
from kinetrace.operators import temporal as T
from kinetrace.operators.events import EVENT, events, islands
from kinetrace.plans.results import EventResults


def event_table(spark, rows):
    """rows: (traj, start, end, type)."""
    count: dict = {}
    out = []
    for traj, start, end, kind in rows:
        count[traj] = count.get(traj, 0) + 1
        out.append((traj, [count[traj]], float(start), float(end), float(end - start), kind, [kind], {}))
    return spark.createDataFrame(out, EVENT)


def brute(a, b, on):
    return sorted((x.traj_id, x.seq, y.seq) for x in a for y in b if x.traj_id == y.traj_id and on(x, y))


RULES = {
    "BEFORE": lambda x, y: x.end_ps <= y.start_ps, "AFTER": lambda x, y: x.start_ps >= y.end_ps, "PRECEDES": lambda x, y: x.end_ps < y.start_ps,
    "OVERLAPS": lambda x, y: x.start_ps <= y.end_ps and y.start_ps <= x.end_ps, "DURING": lambda x, y: y.start_ps <= x.start_ps and x.end_ps <= y.end_ps, "IMMEDIATELY_FOLLOWED_BY": lambda x, y: x.end_ps == y.start_ps,
}


@pytest.fixture(scope="module")
def two_lists(spark):
    rng = random.Random(3)

    def make(kind):
        return event_table(spark, sorted((t, s, s + rng.choice([0, 0, 1, 2, 5]), kind) for t in "pq" for s in rng.sample(range(60), 25)))

    return make("a").cache(), make("b").cache()


@pytest.mark.parametrize("relation", RULES)
def test_relations(two_lists, relation):
    a, b = two_lists
    got = sorted((r.traj_id, r.a.seq, r.b.seq) for r in T.PAIRS[relation](a, b).collect())
    assert got == brute(a.collect(), b.collect(), RULES[relation])


@pytest.fixture(params=[1 << 16, 2])
def long_lists(request, monkeypatch):
    """Lists of more than so many rows are cut into ranges."""
    from kinetrace.operators import ranges

    monkeypatch.setattr(ranges, "LIST", request.param)
    monkeypatch.setattr(ranges, "RANGES", 7)


@pytest.mark.parametrize("within", [None, 0.0, 2.0])
def test_next(two_lists, within, long_lists):
    a, b = two_lists
    want = []
    for x in a.collect():
        later = [y for y in b.collect() if y.traj_id == x.traj_id and y.start_ps >= x.end_ps]
        y = min(later, key=lambda y: (y.start_ps, y.seq), default=None)
        if y and (within is None or y.start_ps - x.end_ps <= within):
            want.append((x.traj_id, x.seq, y.seq))
    assert sorted((r.traj_id, r.a.seq, r.b.seq) for r in T.next_pairs(a, b, within).collect()) == sorted(want)


def test_list_order_decides_ties_and_repeats(spark, long_lists):
    a = event_table(spark, [("t", 0, 1, "a"), ("t", 3, 4, "a"), ("t", 7, 8, "a"), ("t", 12, 13, "a")])
    assert [(r.start_ps, r.end_ps) for r in T.repeated(a, 3).orderBy("seq").collect()] == [(0, 8), (3, 13)]
    assert [(r.start_ps, r.end_ps) for r in T.repeated(a, 3, 8.0).collect()] == [(0, 8)]
    assert T.repeated(a, 5).count() == 0 and T.repeated(a, 1).count() == 4 and T.repeated(a, 1 << 40).count() == 0
    b = event_table(spark, [("t", 1, 9, "x"), ("t", 1, 2, "y")])
    assert T.next_pairs(a.limit(1), b).first().b.type == "x"
    over = T.relate("OVERLAPS", a, b).orderBy("seq").collect()
    assert [r.seq for r in over] == sorted(r.seq for r in over) and len({tuple(r.seq) for r in over}) == len(over) and over[0].metadata["transition_gap_ps"] == "0.000000" and over[0].selections == ["a", "x"]
    same = T.combined(T.all_pairs(a, a, F.col("a.seq") == F.col("b.seq")), "SELF").first()
    assert same.selections == ["a"]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_islands_by_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(t, i, float(2 * i), rng.random() < 0.6, rng.choice([True, False, None])) for t in "ab" for i in range(60) if rng.random() < 0.9 or i > 40]
    df = spark.createDataFrame(rows, "traj_id string, frame_idx long, time_ps double, p boolean, q boolean").repartition(5)
    got = islands(df, {"p": F.col("p"), "q": F.col("q")}, ["traj_id"], "frame_idx", "time_ps", chunk).collect()
    want = []
    for t in "ab":
        for name, at in (("p", 3), ("q", 4)):
            run = []
            for r in [*(r for r in rows if r[0] == t), None]:
                if r and r[at]:
                    run.append(r[2])
                elif run:
                    want.append((t, name, run[0], run[-1]))
                    run = []
    assert sorted((r.traj_id, r.source, r.start, r.end) for r in got) == sorted(want) and all(2 * r.place == r.start for r in got)
    with pytest.raises(Exception, match="strictly increasing"):
        islands(df.withColumn("time_ps", F.when(F.col("frame_idx") == 50, 0.0).otherwise(F.col("time_ps"))), {"p": F.col("p")}, ["traj_id"], "frame_idx", "time_ps", chunk).collect()


def test_analytics(spark, long_lists):
    r = EventResults(event_table(spark, [("t", 0, 1, "A"), ("t", 2, 3, "B"), ("t", 4, 5, "A"), ("t", 6, 7, "B"), ("t", 20, 21, "C")]))
    s = r.recurrence_statistics()
    assert s["A"] == {"count": 2, "total_duration_ps": 2.0, "mean_duration_ps": 1.0, "median_duration_ps": 1.0, "mean_gap_ps": 3.0} and s["C"]["mean_gap_ps"] == 0.0
    assert r.event_frequency(observation_time_ps=10)["A"] == 0.2 and r.conditional_probability("A", "B", within_ps=1) == 1.0
    assert r.conditional_probability("B", "A", within_ps=1) == 0.5 and r.conditional_probability("X", "A", within_ps=1) == 0.0
    assert r.transition_matrix(within_ps=1)["A"] == {"A": 0, "B": 2, "C": 0} and r.motifs(2)[("A", "B")] == 2
    assert r.recurring_subsequences(2) == {("A", "B"): 2} and r.motifs(6) == {}
    c = r.temporal_clusters(max_gap_ps=1)
    assert [x["event_indices"] for x in c] == [[0, 1, 2, 3], [4]] and c[0]["types"] == ["A", "B", "A", "B"]
    g = r.event_graph(within_ps=1)
    assert len(g["nodes"]) == 5 and [(e["source"], e["target"]) for e in g["edges"]] == [(0, 1), (1, 2), (2, 3)] and len(r.event_graph()["edges"]) == 10
    assert {e["count"] for e in r.state_transition_network()["edges"]} == {1, 2}
    assert len(r) == 5 and r[0].type == "A" and "duration (ps)" in repr(r) and len(r.to_dataframe()) == 5
    for bad in (lambda: r.event_frequency(observation_time_ps=0), lambda: r.motifs(0), lambda: r.motifs(True), lambda: r.temporal_clusters(max_gap_ps=-1), lambda: r.conditional_probability("A", "B", within_ps=float("nan"))):
        with pytest.raises(ValueError):
            bad()
    none = EventResults(event_table(spark, [("t", 0, 1, "A")]).where("false"))
    assert none.temporal_clusters(max_gap_ps=1) == [] and none.transition_matrix() == {} and repr(none) == "Events: none"


def test_analytics_in_ranges(spark, monkeypatch):
    """Lists with ties, cut into ranges or not, give the same."""
    from kinetrace.operators import ranges

    rng = random.Random(12)
    rows = [(t, s, s + rng.choice([0, 1, 2, 9]), rng.choice("ABC")) for t in ("p", "q", None) for s in (rng.randrange(50) for _ in range(40))]
    e = event_table(spark, sorted(rows, key=str)).withColumn("k", F.col("seq")[0]).cache()
    seen = []
    for limit in (1 << 16, 3):
        monkeypatch.setattr(ranges, "LIST", limit)
        tables = [A.recurrence_statistics(e), A.recurrence_statistics(e, ()), A.conditional_probability(e, "A", "B", 3.0), A.transitions(e, tie=("k",)), A.transitions(e, 1.0, (), ("k",)), A.motifs(e, 3, tie=("k",)), A.motifs(e, 5, 20.0, (), ("k",)), A.motifs(e, 1), A.temporal_clusters(e, 1.0, tie=("k",)), A.graph_nodes(e, tie=("k",)), A.graph_edges(e, 4.0, tie=("k",)), T.repeated(e.drop("k"), 4), T.repeated(e.drop("k"), 30, 45.0)]
        seen.append([sorted(map(str, d.collect())) for d in tables])
    assert seen[0] == seen[1] and all(seen[0])


@pytest.mark.parametrize("grid_from", [1 << 15, 0])
def test_contacts_against_plain_loops(grid_from, monkeypatch):
    monkeypatch.setattr(K, "GRID_PAIRS", grid_from)
    rng = np.random.default_rng(1)
    x = rng.random((2, 40, 3)) * 3
    a, b, residues = list(range(25)) + [30], list(range(20, 40)), [("A", i // 3) for i in range(40)]
    for cell in (None, np.diag([2.0, 2.5, 3.0]), np.array([[2.0, 0, 0], [0.5, 2, 0], [0.2, 0.3, 2.5]])):
        own = None if cell is None else np.repeat(cell[None], 2, 0)

        def d(f, i, j):
            v = x[f, j] - x[f, i]
            if cell is None:
                return float(np.linalg.norm(v))
            shifts = [np.array([p, q, r]) @ cell for p in range(-3, 4) for q in range(-3, 4) for r in range(-3, 4)]
            return min(float(np.linalg.norm(v + s)) for s in shifts)

        for f in range(2):
            near = [(i, j) for i in a for j in b if i != j and d(f, i, j) <= 0.6]
            assert K.contacts(x, own, a, b, 0.6)[f] == near and K.in_contact(x, own, a, b, 0.6)[f] == 1 and K.in_contact(x, own, [0], [39], 1e-3)[f] == 0
            assert K.contact_count(x, own, a, b, 0.6)[f] == len({tuple(sorted(p)) for p in near})
            assert K.contact_count(x, own, a, b, 0.6, residues)[f] == len({tuple(sorted((residues[i], residues[j]))) for i, j in near if residues[i] != residues[j]})
            assert math.isclose(K.coordination(x, own, a, b, 0.6)[f], len(near) / len(a))
            assert math.isclose(K.least_distance(x, own, a, b)[f], min(d(f, i, j) for i in a for j in b if i != j), abs_tol=1e-12)


def test_grid_gives_the_same(monkeypatch):
    """Hydrogen bonds and surfaces by neighbours, with and without cells, equal those by all pairs."""
    rng = np.random.default_rng(4)
    x = rng.random((5, 60, 3)) * 2
    donors, acceptors, hydrogens = list(range(0, 30, 3)), list(range(30, 60)), {d: [d + 1, d + 2] for d in range(0, 30, 6)}
    for h, own in hydrogens.items():
        x[:, own] = x[:, [h]] + rng.standard_normal((5, 2, 3)) * 0.06
    elements = [("C", "N", "O")[i % 3] for i in range(60)]
    for cell in (None, np.diag([2.0, 2.1, 2.2]), np.array([[2.0, 0, 0], [0.4, 2, 0], [0.2, 0.3, 2.1]])):
        own = None if cell is None else np.repeat(cell[None], 5, 0)
        got = []
        for limit in (1 << 15, 0):
            monkeypatch.setattr(K, "GRID_PAIRS", limit)
            got.append((K.hydrogen_bond(x, own, donors, acceptors, hydrogens, 0.4, 120.0), K.accessible_surface(x, own, list(range(0, 60, 4)), elements, 0.14, 48)))
        assert (got[0][0] == got[1][0]).all() and np.allclose(got[0][1], got[1][1], rtol=1e-12)
        plain = np.zeros(5)
        for f in range(5):
            c = None if own is None else own[f : f + 1]
            for d in donors:
                for h in hydrogens.get(d, ()):
                    for a in acceptors:
                        near = K.norm(K.between(x[f : f + 1], d, a, c))[0] <= 0.4
                        plain[f] += near and K.angle(K.between(x[f : f + 1], h, d, c), K.between(x[f : f + 1], h, a, c))[0] >= 120
        assert (got[0][0] == (plain > 0)).all() and 0 < got[0][0].sum()


def test_neighbor_list_is_reused():
    rng = np.random.default_rng(5)
    x, cell = rng.random((50, 3)) * 2, np.diag([2.0, 2.0, 2.0])
    own = K.NeighborList(range(25), range(25, 50), 0.5, 0.1)
    for step in range(6):
        moved = x + 0.005 * step
        assert own.contacts(moved, cell) == K.contacts(moved[None], cell[None], range(25), range(25, 50), 0.5)[0]
    assert own.rebuilds == 1
    own.contacts(x + 0.2, cell), own.contacts(x + 0.2, 1.1 * cell)
    assert own.rebuilds == 3
    with pytest.raises(ValueError):
        K.NeighborList([0], [1], -1.0)


def test_observables_are_evaluated_once(spark):
    import os

    from kinetrace.plans.api import Trajectory
    from kinetrace.sources.adapters import embedding_frames, synthetic_topology

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    for text in ("DISTANCE(resid 1, resid 5) < 0.1nm", "RG(resid 1:6) < 0.2nm AND CONTACT(resid 1, resid 5)"):
        df = Trajectory(embedding_frames(spark, "/root/testdata/sf0.001"), synthetic_topology()).query(f"FIND {text}").df
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("MapInArrow") == 1 and final.count("FileScan parquet") == 1


def test_aligned_rmsd_is_least():
    rng = np.random.default_rng(2)
    p, q = rng.random((3, 6, 3)), rng.random((3, 6, 3))
    got = K.rmsd(p, None, list(range(6)), q, True)
    for f in range(3):
        a, b = p[f] - p[f].mean(0), q[f] - q[f].mean(0)
        u, s, v = np.linalg.svd(a.T @ b)
        s[-1] *= np.sign(np.linalg.det(u @ v))
        assert math.isclose(got[f] ** 2, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / 6, rel_tol=1e-9)


def test_streaming(spark, tmp_path):
    from kinetrace.streaming.detector import streaming_followed_by, streaming_runs

    rng = random.Random(5)
    rows = [Row(traj_id=t, time_ps=float(i), p=rng.random() < 0.5, q=rng.random() < 0.3) for t in "ab" for i in range(40)]
    schema = "traj_id string, time_ps double, p boolean, q boolean"
    for k in range(2):
        own = [r for r in rows if (r.time_ps >= 20) == (k == 1)]
        spark.createDataFrame(own + ([Row(traj_id=t, time_ps=99.0, p=None, q=None) for t in "ab"] if k else []), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_runs(stream, {"left": F.col("p"), "right": F.col("q")}).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("runs").collect())
    batch = islands(spark.createDataFrame(rows, schema).withColumn("i", F.col("time_ps").cast("long")), {"left": F.col("p"), "right": F.col("q")}, ["traj_id"], "i", "time_ps")
    assert got == sorted(tuple(r) for r in batch.drop("place").collect())
    spark.createDataFrame(got, "traj_id string, source string, start_ps double, end_ps double").coalesce(1).write.parquet(str(tmp_path / "runs"))
    runs = spark.readStream.schema("traj_id string, source string, start_ps double, end_ps double").parquet(str(tmp_path / "runs"))
    q = streaming_followed_by(runs, 2.0).writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    e = events(batch, {"left": ("l", []), "right": ("r", [])})
    want = T.relate("FOLLOWED_BY", e.where("source = 'left'").drop("source"), e.where("source = 'right'").drop("source"), 2.0)
    assert sorted((r.traj_id, r.start_ps, r.end_ps) for r in spark.table("followed").collect()) == sorted((r.traj_id, r.start_ps, r.end_ps) for r in want.collect())


def test_catalogue_matches_its_sql(spark):
    import os

    import duckdb

    from kinetrace.plans import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("events", "orders", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries = catalogue.queries()
    for name in ("evt_islands_multi_source", "tmp_chain", "tmp_overlaps", "ana_clusters", "obs_helix", "obs_distance_pbc_triclinic"):
        got = queries[name](spark, sf)
        want = con.sql(catalogue.oracle_sql()[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall())), name
