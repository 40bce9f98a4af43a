"""Queries over the test tables, one for each operator, and the same in DuckDB's SQL.

Sampled events come from ``events`` (a user is a trajectory, times are exact microseconds),
intervals from ``orders``, frames from ``embeddings`` (see sources.adapters).
"""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import temporal as T
from ..operators.events import events, islands, released_with
from ..operators.observables import condition
from ..sources.adapters import EVENT_TYPES, RESIDUES, embedding_frames, order_intervals, part_atoms, sampled_events, synthetic_topology
from ..sources.files import filesystem, new_folder
from ..sources.readers import frames
from ..sources.topology import Topology
from ..sources.writers import write_xyz
from .api import Trajectory, load
from .language import Observable, parse, walk
from .planner import check_types

DAY = 86_400_000_000.0
# Sampled events.

SQL_S = "s AS (SELECT user_id, epoch_us(ts) AS t, value, event_type FROM events)"


def sql_runs(name: str, predicate: str) -> str:
    """Runs of a predicate over s, with seq."""
    return (
        f"{name}_m AS (SELECT user_id, t, coalesce({predicate}, false) AS p, sum(CASE WHEN coalesce({predicate}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM s), "
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY st) AS seq FROM (SELECT user_id, min(t)::DOUBLE AS st, max(t)::DOUBLE AS en FROM {name}_m WHERE p GROUP BY user_id, g))"
    )


def runs(spark: SparkSession, sf_dir: str, **predicates: str) -> DataFrame:
    # A day of samples is a chunk here: rows are ordered by their time.
    found = islands(sampled_events(spark, sf_dir), {n: F.expr(p) for n, p in predicates.items()}, ["traj_id"], "at", "time_ps", int(30 * DAY))
    return events(found, {n: (n, [n]) for n in predicates})


def over(make, **predicates):
    """A query: make(lists of the runs of the predicates), which share one cached table."""

    def query(spark, sf_dir):
        r = runs(spark, sf_dir, **predicates).persist()
        return released_with(make(*(r.where(F.col("source") == n).drop("source") for n in predicates)), r)

    return query


def shown(d: DataFrame) -> DataFrame:
    return d.select(F.col("traj_id").cast("long").alias("user_id"), "start_ps", "end_ps")


SHOW = "SELECT user_id, st AS start_ps, en AS end_ps FROM"


def q_islands(spark, sf_dir):
    return shown(runs(spark, sf_dir, a="value > 50"))


def q_islands_multi(spark, sf_dir):
    r = runs(spark, sf_dir, a="value > 50", b=CLICKED, c=LOW_OR_ERROR)
    return r.select("source", F.col("traj_id").cast("long").alias("user_id"), "start_ps", "end_ps", "duration_ps")


def q_monotonic(spark, sf_dir):
    """Runs of the samples as they are, and whether samples out of order are refused: of the last user one more at the time of the last, one before it, one at no finite time."""
    good = sampled_events(spark, sf_dir)
    last = good.orderBy(F.desc(F.col("traj_id").cast("long")), F.desc("at")).limit(1)
    moved = lambda time: good.unionByName(last.withColumn("time_ps", time).withColumn("at", F.col("at") + 1))
    cases = {"as it is": good, "same time": moved(F.col("time_ps")), "earlier": moved(F.col("time_ps") - 1), "infinite": moved(F.lit(float("inf")))}
    rows = []
    for name, samples in cases.items():
        try:
            found = islands(samples, {"a": F.col("value").isNotNull()}, ["traj_id"], "at", "time_ps", int(30 * DAY))
            rows.append((name, found.count(), False))
        except Exception as e:
            if "strictly increasing" not in str(e) and "must be finite" not in str(e):
                raise
            rows.append((name, None, True))
    return spark.createDataFrame(rows, "input string, n_runs long, refused boolean")


def predicate_query(text):
    """Runs of a frame predicate of the query language; its observables are the value of a sample and the number of its type."""

    def query(spark, sf_dir):
        e = parse(f"FIND {text}")
        check_types(e)
        column_of = {o.key: F.col("value") if o.name == "DISTANCE" else F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) for o in walk(e) if isinstance(o, Observable)}
        found = islands(sampled_events(spark, sf_dir), {"a": condition(e, column_of)}, ["traj_id"], "at", "time_ps", int(30 * DAY))
        return shown(events(found, {"a": ("a", ["a"])}))

    return query


VALUE, KIND = "DISTANCE(value, origin)", "CONTACT_COUNT(type, type)"
#: Text and SQL; types are numbered from 1 in alphabetical order.
PREDICATES = {
    "pred_lt": (f"{VALUE} < 20nm", "value < 20"), "pred_le": (f"{VALUE} <= 20nm", "value <= 20"), "pred_gt": (f"{VALUE} > 100nm", "value > 100"), "pred_ge": (f"{VALUE} >= 100nm", "value >= 100"),
    "pred_eq": (f"{KIND} == 5", "event_type = 'view'"), "pred_ne": (f"{KIND} != 5", "event_type <> 'view'"), "pred_and": (f"{VALUE} > 30nm AND {KIND} != 5", "value > 30 AND event_type <> 'view'"),
    "pred_or": (f"{VALUE} > 100nm OR {KIND} == 1", "value > 100 OR event_type = 'click'"), "pred_grouped": (f"({VALUE} > 30nm OR {KIND} == 2) AND {VALUE} < 90nm", "(value > 30 OR event_type = 'error') AND value < 90"),
}

CLICKED, LOW_OR_ERROR = "event_type = 'click'", "value < 5 OR event_type = 'error'"
HIGH, LOW = "value > 100", "value < 5"
SQL_HIGH, SQL_LOW, SQL_CLICK = sql_runs("h", HIGH), sql_runs("l", LOW), sql_runs("c", CLICKED)


def pair_counts(pairs):
    """Counts and sums of pairs of each user: the pairs themselves are too many to return."""

    def counted(h, low):
        p = pairs(h, low)
        total = F.sum((F.col("a.start_ps") + 2 * F.col("b.end_ps")).cast("decimal(38,0)")).cast("double")
        return p.groupBy(F.col("traj_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n_pairs"), total.alias("checksum"))

    return over(counted, h=HIGH, l=LOW)


def sql_pair_counts(on: str) -> str:
    return f"WITH {SQL_S}, {SQL_HIGH}, {SQL_LOW} SELECT h.user_id, count(*) AS n_pairs, sum((h.st + 2 * l.en)::HUGEINT)::DOUBLE AS checksum FROM h JOIN l ON h.user_id = l.user_id AND {on} GROUP BY h.user_id"


def composite(d: DataFrame) -> DataFrame:
    """Events with their place in the list and all that they carry."""
    place = F.row_number().over(Window.partitionBy("traj_id").orderBy("seq")).cast("long")
    meta = F.array_join(F.transform(F.array_sort(F.map_keys("metadata")), lambda k: F.concat(k, F.lit("="), F.col("metadata")[k])), ";")
    return d.select(F.col("traj_id").cast("long").alias("user_id"), place.alias("seq"), "start_ps", "end_ps", "duration_ps", "type", F.array_join("selections", ",").alias("selections"), meta.alias("metadata"))


def q_followed(within=None, relation="FOLLOWED_BY"):
    return over(lambda h, low: composite(T.relate(relation, h, low, within)), h=HIGH, l=LOW)


def sql_next(a: str, b: str, out: str, within: float | None = None, types: tuple[str, str] | None = None, relation: str = "FOLLOWED_BY", selections: str | None = None) -> str:
    """Each a with the earliest b at or after its end; ties by seq."""
    extra = f" WHERE bst - aen <= {within}" if within is not None else ""
    left, right = types or (a, b)
    return (
        f"{out}_n AS (SELECT {a}.user_id, {a}.seq AS aseq, {a}.st AS ast, {a}.en AS aen, {b}.st AS bst, {b}.en AS ben, row_number() OVER (PARTITION BY {a}.user_id, {a}.seq ORDER BY {b}.st, {b}.seq) AS rn FROM {a} JOIN {b} ON {a}.user_id = {b}.user_id AND {b}.st >= {a}.en), "
        f"{out} AS (SELECT user_id, least(ast, bst) AS st, greatest(aen, ben) AS en, row_number() OVER (PARTITION BY user_id ORDER BY aseq) AS seq, '{relation}' AS type, '{selections or f'{a},{b}'}' AS selections, printf('left_type={left};right_type={right};transition_gap_ps=%.6f', greatest(0, bst - aen)) AS metadata FROM (SELECT * FROM {out}_n WHERE rn = 1){extra})"
    )


COMPOSITE = "SELECT user_id, seq::BIGINT AS seq, st AS start_ps, en AS end_ps, en - st AS duration_ps, type, selections, metadata FROM"


q_for = over(lambda a: composite(T.lasting(a, DAY / 4)), a="value > 30")


def q_repeats(within=None):
    return over(lambda a: composite(T.repeated(a, 3, within)), a="value > 50")


def sql_repeats(extra: str = "") -> str:
    return f"WITH {SQL_S}, {sql_runs('a', 'value > 50')}, r AS (SELECT user_id, seq AS place, st, lead(en, 2) OVER (PARTITION BY user_id ORDER BY seq) AS en FROM a), k AS (SELECT user_id, st, en, row_number() OVER (PARTITION BY user_id ORDER BY place) AS seq, 'REPEATS' AS type, 'a' AS selections, printf('repeat_count=3;repeat_span_ps=%.6f;source_type=a', en - st) AS metadata FROM r WHERE en IS NOT NULL{extra}) {COMPOSITE} k"


q_chain = over(lambda h, low, click: composite(T.relate("FOLLOWED_BY", T.relate("FOLLOWED_BY", h, low, 3 * DAY), click, DAY)), h=HIGH, l=LOW, c=CLICKED)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values above 100 followed by values below 5 within a day, per user."""
    return over(lambda h, low: T.relate("FOLLOWED_BY", h, low, DAY), h=HIGH, l=LOW)(spark, sf_dir)


# Intervals.

SQL_I = "i AS (SELECT o_custkey AS cust, o_orderkey AS key, epoch_us(o_orderdate)::DOUBLE / 86400000000 AS st, epoch_us(o_orderdate)::DOUBLE / 86400000000 + (o_orderkey % 30)::DOUBLE AS en, (o_orderkey % 30)::DOUBLE AS dur, o_orderpriority AS type FROM orders)"
ORDER = "PARTITION BY cust ORDER BY st, en, type, key"
URGENT, LATE = "type = '1-URGENT'", "type = '5-LOW'"


def interval_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    i = order_intervals(spark, sf_dir).withColumn("seq", F.array("key")).withColumn("selections", F.array("type"))
    return i.where(URGENT), i.where(LATE)


def interval_pairs(make):
    def query(spark, sf_dir):
        a, b = interval_lists(spark, sf_dir)
        return make(a, b).select(F.col("traj_id").cast("long").alias("cust"), F.col("a.seq")[0].alias("left_key"), F.col("b.seq")[0].alias("right_key"))

    return query


def sql_interval_pairs(on: str) -> str:
    return f"WITH {SQL_I} SELECT a.cust, a.key AS left_key, b.key AS right_key FROM i a JOIN i b ON a.cust = b.cust AND {on} WHERE a.type = '1-URGENT' AND b.type = '5-LOW'"


def intervals(spark, sf_dir) -> DataFrame:
    return order_intervals(spark, sf_dir)


def by_customer(d: DataFrame) -> DataFrame:
    return d.withColumn("cust", F.col("traj_id").cast("long")).drop("traj_id")


def rounded(d: DataFrame, *names: str) -> DataFrame:
    return d.withColumns({n: F.round(n, 6) for n in names})


def q_recurrence(spark, sf_dir):
    return by_customer(rounded(A.recurrence_statistics(intervals(spark, sf_dir)), "mean_duration_ps", "median_duration_ps", "mean_gap_ps"))


def q_clusters(spark, sf_dir):
    c = A.temporal_clusters(intervals(spark, sf_dir), 10.0, tie=("key",))
    return by_customer(c.select("traj_id", "cluster", "start_ps", "end_ps", F.size("event_indices").cast("long").alias("n_events"), F.array_join("types", ",").alias("types"), F.element_at("event_indices", 1).alias("first_index")))


def q_state_network(spark, sf_dir):
    return by_customer(A.transitions(intervals(spark, sf_dir), 20.0, tie=("key",)))


LEADS = f"n AS (SELECT cust, type AS source, lead(type) OVER w AS target, greatest(0.0::DOUBLE, lead(st) OVER w - en) AS gap FROM i WINDOW w AS ({ORDER}))"

# Frames.


def observed(text: str, kind: str = "backbone", scale: float = 1.0, cell: list[float] | None = None):
    """Events of a query over the embeddings."""

    def query(spark, sf_dir):
        t = Trajectory(embedding_frames(spark, sf_dir, scale, cell), synthetic_topology(kind))
        return t.query(f"FIND {text}").df.select("start_ps", "end_ps", "duration_ps")

    return query


def atom_rows() -> str:
    """The synthetic topology as SQL values: place, residue, name."""
    return ", ".join(f"({i}, {1 + i // 3}, '{('N', 'CA', 'C')[i % 3]}')" for i in range(21))


def sql_frames(predicate: str, ctes: str = "", scale: str = "1.0") -> str:
    """Runs of a predicate over frames p (f, ...) given by ctes."""
    return f"""WITH e AS (SELECT vec_id AS f, list_transform(embedding, lambda v: v::DOUBLE * {scale}::DOUBLE) AS v FROM embeddings),
atoms(k, r, name) AS (VALUES {atom_rows()}),
x AS (SELECT e.f, a.k, a.r, a.name, v[3 * k + 1] AS x, v[3 * k + 2] AS y, v[3 * k + 3] AS z FROM e CROSS JOIN atoms a),
{ctes},
m AS (SELECT f, p, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (ORDER BY f) AS g FROM (SELECT f, {predicate} AS p FROM o))
SELECT min(f)::DOUBLE AS start_ps, max(f)::DOUBLE AS end_ps, (max(f) - min(f))::DOUBLE AS duration_ps FROM m WHERE p GROUP BY g"""


def sql_pairs(a: str, b: str, what: str, box: float | None = None) -> str:
    """o (f, value): an aggregate over the pairs of two selections; box: a cubic cell."""
    near = (lambda c: f"(b.{c} - a.{c})") if box is None else (lambda c: f"((b.{c} - a.{c}) - {box} * round((b.{c} - a.{c}) / {box}))")
    d = f"sqrt({near('x')} * {near('x')} + {near('y')} * {near('y')} + {near('z')} * {near('z')})"
    return f"q AS (SELECT a.f, a.k AS i, b.k AS j, a.r AS ri, b.r AS rj, {d} AS d FROM x a JOIN x b ON a.f = b.f AND a.k <> b.k WHERE a.{a} AND b.{b}), o AS (SELECT f, {what} AS value FROM q GROUP BY f)"


def selected(low: int, high: int) -> str:
    return f"r BETWEEN {low} AND {high}"


S12, S57 = selected(1, 2), selected(5, 7)
SEL = "resid 1:2, resid 5:7"
TRICLINIC = [1.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
SQL_TRICLINIC = """q AS (SELECT f, min(d) AS value FROM (SELECT a.f, sqrt((b.x - a.x + si)^2 + (b.y - a.y + si * 0.1::DOUBLE + sj)^2 + (b.z - a.z + sk)^2) AS d
  FROM x a JOIN x b ON a.f = b.f AND a.k <> b.k CROSS JOIN (SELECT unnest(range(-9, 10)) AS si) CROSS JOIN (SELECT unnest(range(-9, 10)) AS sj) CROSS JOIN (SELECT unnest(range(-9, 10)) AS sk)
  WHERE a.r = 1 AND a.name = 'N' AND b.r = 5 AND b.name = 'N') GROUP BY f), o AS (SELECT * FROM q)"""
SQL_CENTER = "c AS (SELECT f, r, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM x GROUP BY f, r)"
SQL_RG = "c AS (SELECT f, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM x WHERE r <= 6 GROUP BY f), o AS (SELECT x.f, sqrt(avg((x - cx)^2 + (y - cy)^2 + (z - cz)^2)) AS value FROM x JOIN c ON c.f = x.f WHERE r <= 6 GROUP BY x.f)"
SQL_RG_MASS = "w AS (SELECT *, CASE WHEN name = 'N' THEN 14.007 ELSE 12.011 END::DOUBLE AS m FROM x WHERE r <= 6), c AS (SELECT f, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM w GROUP BY f), o AS (SELECT w.f, sqrt(sum(m * ((x - cx)^2 + (y - cy)^2 + (z - cz)^2)) / sum(m)) AS value FROM w JOIN c ON c.f = w.f GROUP BY w.f)"


def sql_dihedral(src: str, out: str) -> str:
    """out (f, key, value): dihedrals of rows src (f, key, x1..z4)."""
    return f"""{out}_b AS (SELECT f, key, x2 - x1 AS ax, y2 - y1 AS ay, z2 - z1 AS az, x3 - x2 AS bx, y3 - y2 AS by_, z3 - z2 AS bz, x4 - x3 AS cx, y4 - y3 AS cy, z4 - z3 AS cz FROM {src}),
{out}_n AS (SELECT *, ay * bz - az * by_ AS px, az * bx - ax * bz AS py, ax * by_ - ay * bx AS pz, by_ * cz - bz * cy AS qx, bz * cx - bx * cz AS qy, bx * cy - by_ * cx AS qz, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb FROM {out}_b),
{out} AS (SELECT f, key, degrees(atan2(((py * qz - pz * qy) * bx + (pz * qx - px * qz) * by_ + (px * qy - py * qx) * bz) / lb, px * qx + py * qy + pz * qz)) AS value FROM {out}_n)"""


def sql_four(places: list[tuple[int, int, int, int]], name: str) -> str:
    """name (f, key, x1..z4) of quadruples of atoms."""
    cols = ", ".join(f"v[3 * q[{n}] + {c}] AS {a}{n}" for n in range(1, 5) for c, a in ((1, "x"), (2, "y"), (3, "z")))
    rows = ", ".join(f"({i}, [{', '.join(map(str, p))}])" for i, p in enumerate(places))
    return f"{name}_p(key, q) AS (VALUES {rows}), {name} AS (SELECT e.f, key, {cols} FROM e CROSS JOIN {name}_p)"


#: Residues 2, 3 and 6 have neighbours on both sides in their chain: atoms of phi and of psi.
HELIX_RESIDUES = (2, 3, 6)
PHI = [(3 * r - 4, 3 * r - 3, 3 * r - 2, 3 * r - 1) for r in HELIX_RESIDUES]
PSI = [(3 * r - 3, 3 * r - 2, 3 * r - 1, 3 * r) for r in HELIX_RESIDUES]
SQL_HELIX = f"{sql_four(PHI, 'four1')}, {sql_dihedral('four1', 'phi')}, {sql_four(PSI, 'four2')}, {sql_dihedral('four2', 'psi')}, o AS (SELECT phi.f, avg(CASE WHEN phi.value BETWEEN -100 AND -30 AND psi.value BETWEEN -80 AND -5 THEN 1.0 ELSE 0.0 END) AS value FROM phi JOIN psi ON phi.f = psi.f AND phi.key = psi.key GROUP BY phi.f)"
SQL_HBOND = """h AS (SELECT d.f, d.k AS d, sqrt((a.x - d.x)^2 + (a.y - d.y)^2 + (a.z - d.z)^2) AS da, d.x - h.x AS ux, d.y - h.y AS uy, d.z - h.z AS uz, a.x - h.x AS wx, a.y - h.y AS wy, a.z - h.z AS wz
  FROM x d JOIN x h ON h.f = d.f AND h.k = d.k + 1 JOIN x a ON a.f = d.f AND a.k % 3 = 2 WHERE d.k % 3 = 0),
o AS (SELECT f, bool_or(da <= 0.35 + 1e-12 AND degrees(acos(greatest(-1, least(1, (ux * wx + uy * wy + uz * wz) / sqrt((ux * ux + uy * uy + uz * uz) * (wx * wx + wy * wy + wz * wz)))))) + 1e-12 >= 150) AS value FROM h GROUP BY f)"""
SQL_ORIENT = f"{SQL_CENTER}, o AS (SELECT a.f, degrees(acos(abs(b.z - a.z) / sqrt((b.x - a.x)^2 + (b.y - a.y)^2 + (b.z - a.z)^2))) AS value FROM c a JOIN c b ON a.f = b.f AND a.r = 1 AND b.r = 4)"
SQL_STACK = f"""{SQL_CENTER}, s AS (SELECT x.f, x.r, x.k % 3 AS n, x.x - c.x AS x, x.y - c.y AS y, x.z - c.z AS z FROM x JOIN c ON c.f = x.f AND c.r = x.r WHERE x.r IN (4, 5)),
nrm AS (SELECT a.f, a.r, sum(a.y * b.z - a.z * b.y) AS nx, sum(a.z * b.x - a.x * b.z) AS ny, sum(a.x * b.y - a.y * b.x) AS nz FROM s a JOIN s b ON a.f = b.f AND a.r = b.r AND b.n = (a.n + 1) % 3 GROUP BY a.f, a.r),
o AS (SELECT p.f, sqrt((c5.x - c4.x)^2 + (c5.y - c4.y)^2 + (c5.z - c4.z)^2) AS sep, degrees(acos(least(1, abs(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz) / sqrt((p.nx^2 + p.ny^2 + p.nz^2) * (q.nx^2 + q.ny^2 + q.nz^2))))) AS ang
  FROM nrm p JOIN nrm q ON p.f = q.f AND p.r = 4 AND q.r = 5 JOIN c c4 ON c4.f = p.f AND c4.r = 4 JOIN c c5 ON c5.f = p.f AND c5.r = 5)"""
SQL_RMSD = "z AS (SELECT k, x AS rx, y AS ry, z AS rz FROM x WHERE f = (SELECT min(f) FROM x)), o AS (SELECT f, sqrt(avg((x - rx)^2 + (y - ry)^2 + (z - rz)^2)) AS value FROM x JOIN z ON z.k = x.k WHERE r <= 6 GROUP BY f)"


def determinant(rows: list[list[str]]) -> str:
    """The determinant of a matrix of SQL expressions, along its first row."""
    if len(rows) == 1:
        return rows[0][0]
    terms = [f"{'-' if i % 2 else '+'} ({v}) * ({determinant([r[:i] + r[i + 1 :] for r in rows[1:]])})" for i, v in enumerate(rows[0])]
    return " ".join(terms).removeprefix("+ ")


#: Least RMSD by the largest root of the characteristic polynomial of the quaternion matrix, by Newton's method from above.
QUATERNION = [
    ["xx + yy + zz", "yz - zy", "zx - xz", "xy - yx"],
    ["yz - zy", "xx - yy - zz", "xy + yx", "zx + xz"],
    ["zx - xz", "xy + yx", "yy - xx - zz", "yz + zy"],
    ["xy - yx", "zx + xz", "yz + zy", "zz - xx - yy"],
]
SQL_ALIGNED = f"""s AS (SELECT f, k, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM x WHERE r <= 6 WINDOW w AS (PARTITION BY f)),
z0 AS (SELECT k, x AS rx, y AS ry, z AS rz FROM s WHERE f = (SELECT min(f) FROM s)),
cov AS (SELECT f, {", ".join(f"sum({a} * r{b}) AS {a}{b}" for a in "xyz" for b in "xyz")}, sum(x * x + y * y + z * z + rx * rx + ry * ry + rz * rz) AS gg, count(*) AS n FROM s JOIN z0 ON z0.k = s.k GROUP BY f),
pol AS (SELECT f, n, gg, -2 * ({" + ".join(f"{a}{b} * {a}{b}" for a in "xyz" for b in "xyz")}) AS c2, -8 * ({determinant([[f"{a}{b}" for b in "xyz"] for a in "xyz"])}) AS c1, {determinant(QUATERNION)} AS c0 FROM cov),
root AS (SELECT f, n, gg, list_reduce(list_concat([gg / 2], list_transform(range(60), lambda i: 0.0::DOUBLE)), lambda l, i: l - (((l * l + c2) * l + c1) * l + c0) / ((4 * l * l + 2 * c2) * l + c1)) AS l FROM pol),
o AS (SELECT f, sqrt(greatest(0, (gg - 2 * l) / n)) AS value FROM root)"""
SQL_SASA = """pts AS (SELECT i, 1 - 2 * (i + 0.5::DOUBLE) / 96 AS py, 2.39996322972865332::DOUBLE * i AS t FROM range(96) u(i)),
sph AS (SELECT i, cos(t) * sqrt(1 - py * py) AS sx, py AS sy, sin(t) * sqrt(1 - py * py) AS sz FROM pts),
rad AS (SELECT *, CASE WHEN name = 'N' THEN 0.155 ELSE 0.170 END::DOUBLE + 0.14::DOUBLE AS rr FROM x),
srf AS (SELECT a.f, a.k, a.rr, i, a.x + sx * a.rr AS px, a.y + sy * a.rr AS py, a.z + sz * a.rr AS pz FROM rad a CROSS JOIN sph WHERE a.r = 1),
occ AS (SELECT s.f, s.k, s.rr, s.i, bool_or(sqrt((b.x - s.px)^2 + (b.y - s.py)^2 + (b.z - s.pz)^2) < b.rr) AS hid FROM srf s JOIN rad b ON b.f = s.f AND b.k <> s.k GROUP BY s.f, s.k, s.rr, s.i),
o AS (SELECT f, sum(4 * pi() * rr * rr * CASE WHEN hid THEN 0 ELSE 1 END / 96) AS value FROM occ GROUP BY f)"""


def q_selection(text: str):
    """Selections filter a table of atoms: the parts, see adapters.part_atoms."""

    def query(spark, sf_dir):
        from ..functions.selection import predicate

        return part_atoms(spark, sf_dir).where(predicate(text)).select("atom_index", "name", "residue_name")

    return query


def sql_selection(where: str) -> str:
    pick = lambda values, n: f"[{', '.join(repr(v) for v in values)}][1 + {n}]"
    return f"""WITH t AS (SELECT p_partkey AS atom_index, {pick(("N", "CA", "C", "HA"), "p_partkey % 4")} AS name, {pick(RESIDUES, "p_size % 7")} AS residue_name, p_size AS residue_index,
{pick("ABC", "p_partkey % 3")} AS chain, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {pick(("N", "C", "C", "H"), "p_partkey % 4")} END AS element FROM part) SELECT atom_index, name, residue_name FROM t WHERE {where}"""


HYDROGEN = "(element = 'H' OR element = '' AND name[1] = 'H')"
SELECTIONS = {
    "sel_resid": ("resid 3", "residue_index = 3"), "sel_resid_range": ("resid 2:4", "residue_index BETWEEN 2 AND 4"), "sel_name": ("name CA", "name = 'CA'"), "sel_resname": ("resname ARG", "residue_name = 'ARG'"),
    "sel_chain": ("chain B", "chain = 'B'"), "sel_protein": ("protein", "residue_name NOT IN ('HOH', 'WAT')"), "sel_hydrogen": ("hydrogen", HYDROGEN), "sel_and": ("resid 1:30 and name N", "residue_index BETWEEN 1 AND 30 AND name = 'N'"),
    "sel_or": ("resname ARG or resname SER", "residue_name IN ('ARG', 'SER')"), "sel_not": ("not chain A", "chain <> 'A'"), "sel_grouped": ("(name CA or name N) and chain B", "name IN ('CA', 'N') AND chain = 'B'"),
    "sel_not_hydrogen": ("protein and not hydrogen", f"residue_name NOT IN ('HOH', 'WAT') AND NOT {HYDROGEN}"),
}

OBSERVED = {
    "obs_distance": (f"DISTANCE({SEL}) < 0.06nm", sql_frames("value < 0.06", ctes=sql_pairs(S12, S57, "min(d)"))),
    "obs_surface_distance": (f"SURFACE_DISTANCE({SEL}) > 0.08nm", sql_frames("value > 0.08", ctes=sql_pairs(S12, S57, "min(d)"))),
    "obs_contact": (f"CONTACT({SEL}, cutoff=0.06nm)", sql_frames("value <= 0.06 + 1e-12", ctes=sql_pairs(S12, S57, "min(d)"))),
    "obs_salt_bridge": (f"SALT_BRIDGE({SEL}, cutoff=0.05nm)", sql_frames("value <= 0.05 + 1e-12", ctes=sql_pairs(S12, S57, "min(d)"))),
    "obs_contact_count_atom": (f"CONTACT_COUNT({SEL}, cutoff=0.15nm) >= 8", sql_frames("value >= 8", ctes=sql_pairs(S12, S57, "count(*) FILTER (WHERE d <= 0.15 + 1e-12)"))),
    "obs_contact_count_residue": (f"CONTACT_COUNT({SEL}, cutoff=0.12nm, mode=residue) >= 3", sql_frames("value >= 3", ctes=sql_pairs(S12, S57, "count(DISTINCT (ri, rj)) FILTER (WHERE d <= 0.12 + 1e-12)"))),
    "obs_coordination_number": (f"COORDINATION_NUMBER({SEL}, cutoff=0.15nm) >= 1.5", sql_frames("value >= 1.5", ctes=sql_pairs(S12, S57, "count(*) FILTER (WHERE d <= 0.15 + 1e-12) / 6.0"))),
    "obs_rg": ("RG(resid 1:6) < 0.21nm", sql_frames("value < 0.21", ctes=SQL_RG)),
    "obs_rg_mass": ("RG(resid 1:6, mass_weighted=true) < 0.21nm", sql_frames("value < 0.21", ctes=SQL_RG_MASS)),
    "obs_dihedral": ("DIHEDRAL(resid 1 and name C, resid 2 and name N, resid 2 and name CA, resid 2 and name C) < -30deg", sql_frames("value < -30", ctes=f"{sql_four([(2, 3, 4, 5)], 'four')}, {sql_dihedral('four', 'o')}")),
    "obs_helix": ("HELIX(resid 1:7, minimum_fraction=0.3)", sql_frames("value >= 0.3", ctes=SQL_HELIX)),
    "obs_orientation": ("ORIENTATION(resid 1, resid 4, axis=z) < 45deg", sql_frames("value < 45", ctes=SQL_ORIENT)),
    "obs_aromatic_stacking": ("AROMATIC_STACKING(resid 4, resid 5, distance=0.2nm, max_angle=45deg)", sql_frames("sep <= 0.2 + 1e-12 AND ang <= 45 + 1e-12", ctes=SQL_STACK)),
    "obs_rmsd_raw": ("RMSD(resid 1:6, align=false) < 0.30nm", sql_frames("value < 0.30", ctes=SQL_RMSD)),
    "obs_rmsd_aligned": ("RMSD(resid 1:6) < 0.24nm", sql_frames("value < 0.24", ctes=SQL_ALIGNED)),
}


# Files.

PDB_LINE = "{:6}{:5d}  {:<3} {:3} {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00          {:>2}"
#: Record, serial, name, residue, chain, number, place, element.
PDB_ATOMS = (
    ("ATOM", 1, "N", "ARG", "A", 17, 1.0, 0.0, 0.0, "N"), ("ATOM", 2, "CA", "ARG", "A", 17, 2.5, 0.0, 0.0, "C"), ("ATOM", 3, "HB", "ARG", "A", 17, 3.0, 1.0, 0.0, ""),
    ("ATOM", 4, "CA", "ASP", "B", 42, 4.0, 0.0, 0.5, "C"), ("HETATM", 7, "O", "HOH", "W", 99, 9.0, 9.0, 9.0, "O"),
)
BONDS = ("CONECT    1    2", "CONECT    2    1    3    9", "CONECT    4    4    7")


def written_file(spark: SparkSession, name: str, text: str, pack=None) -> str:
    """The path of a new file in a folder that all executors share."""
    path = f"{new_folder(spark, 'files')}/{name}"
    fs, own = filesystem(path)
    with fs.open_output_stream(own, compression=None) as f:
        f.write(pack(text.encode()) if pack else text.encode())
    return path


def pdb_text(models: int = 0, cell: str = "") -> str:
    """The atoms once, or as models of which each is moved by one angstrom along z; every second one states a cell."""
    atoms = lambda k: [PDB_LINE.format(*a[:8], a[8] + k, a[9]) for a in PDB_ATOMS]
    body = [line for k in range(models) for line in ([cell] * (k % 2 == 0 and bool(cell)) + [f"MODEL     {k + 1:4d}", *atoms(k), "ENDMDL"])] if models else [cell] * bool(cell) + atoms(0)
    return "\n".join([*body, *BONDS, "END", ""])


def loaded(spark: SparkSession, name: str, text: str, step: str = "1ps", pack=None) -> DataFrame:
    """The frames of a file with that text, of the atoms above: place, time, the coordinates and the cell in thousandths."""
    t = load(written_file(spark, name, text, pack), topology=written_file(spark, "top.pdb", pdb_text()), default_timestep=step, spark=spark)
    milli = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 1000).cast("long")), ",")
    return t.frames.select("frame_idx", "time_ps", milli("coords").alias("coords"), F.coalesce(milli("cell"), F.lit("")).alias("cell"))


def sql_loaded(rows: list[tuple]) -> str:
    values = ", ".join(f"({i}, {t}::DOUBLE, '{','.join(str(round(100 * v)) for v in xs)}', '{cell}')" for i, t, xs, cell in rows)
    return f"SELECT i::BIGINT AS frame_idx, t AS time_ps, coords, cell FROM (VALUES {values}) v(i, t, coords, cell)"


def moved(k: float) -> list[float]:
    return [v for a in PDB_ATOMS for v in (a[6], a[7], a[8] + k)]


#: Comments of XYZ frames: time and cell as they are to be read (cells in thousandths of a nanometre).
XYZ_COMMENTS = (
    ("time=10ps and more", 10, ""), ("time = 0.02ns box=20,21,22A", 20, "2000,0,0,0,2100,0,0,0,2200"), ('time=30000fs Lattice="20 1 0 0 20 0 0 0 20" Properties=species:S:1:pos:R:3', 30, "2000,100,0,0,2000,0,0,0,2000"), ("box=2x3x4nm time=1us", 1000000, "2000,0,0,0,3000,0,0,0,4000"),
)


def xyz_text(comments) -> str:
    return "".join(f"{len(PDB_ATOMS)}\n{c}\n" + "".join(f"{a[2]} {a[6]} {a[7]} {a[8] + k}\n" for a in PDB_ATOMS) for k, c in enumerate(comments))


TRICLINIC_RECORD = "CRYST1   20.000   20.000   20.000  90.00  90.00  60.00 P 1           1"
FILES = {
    "src_xyz": (lambda s: loaded(s, "t.xyz", xyz_text([c for c, *_ in XYZ_COMMENTS])), sql_loaded([(k, t, moved(k), cell) for k, (_, t, cell) in enumerate(XYZ_COMMENTS)])),
    "src_xyz_without_times": (lambda s: loaded(s, "t.xyz", xyz_text(["", "no time here"]), "2.5ps"), sql_loaded([(k, 2.5 * k, moved(k), "") for k in range(2)])),
    "src_xyz_compressed": (lambda s: loaded(s, "t.xyz.gz", xyz_text(["time=1ps", "time=4ps"]), pack=gzip.compress), sql_loaded([(0, 1, moved(0), ""), (1, 4, moved(1), "")])),
    "src_pdb_models": (lambda s: loaded(s, "m.pdb", pdb_text(3, TRICLINIC_RECORD), "2ps"), sql_loaded([(k, 2 * k, moved(k), "2000,0,0,1000,1732,0,0,0,2000") for k in range(3)])),
    "src_pdb_box": (lambda s: loaded(s, "m.pdb", pdb_text(0, "CRYST1   20.000   30.000   40.000  90.00  90.00  90.00 P 1           1")), sql_loaded([(0, 0, moved(0), "2000,0,0,0,3000,0,0,0,4000")])),
    "src_pdb_unit_cell": (lambda s: loaded(s, "m.pdb", pdb_text(0, "CRYST1    1.000    1.000    1.000  90.00  90.00  90.00 P 1           1")), sql_loaded([(0, 0, moved(0), "")])),
    "src_pdb_atoms": (
        lambda s: Topology.from_pdb(written_file(s, "top.pdb", pdb_text())).atoms_frame(s),
        "SELECT i::BIGINT AS atom_index, name, residue_name, n::INTEGER AS residue_index, chain, element, mass::DOUBLE AS mass_da FROM (VALUES (0, 'N', 'ARG', 17, 'A', 'N', 14.007), (1, 'CA', 'ARG', 17, 'A', 'C', 12.011), (2, 'HB', 'ARG', 17, 'A', 'H', 1.008), (3, 'CA', 'ASP', 42, 'B', 'C', 12.011), (4, 'O', 'HOH', 99, 'W', 'O', 15.999)) v(i, name, residue_name, n, chain, element, mass)",
    ),
    "src_pdb_bonds": (lambda s: Topology.from_pdb(written_file(s, "top.pdb", pdb_text())).bonds_frame(s), "SELECT a::BIGINT AS a, b::BIGINT AS b FROM (VALUES (0, 1), (1, 2), (3, 4)) v(a, b)"),
}


def q_written_frames(spark, sf_dir):
    """All embeddings written as XYZ files and read back."""
    top = synthetic_topology()
    folder = new_folder(spark, "xyz")
    write_xyz(embedding_frames(spark, sf_dir, cell=TRICLINIC), top, folder)
    found = frames(spark, folder, top)
    total = F.aggregate("coords", F.lit(0.0), lambda a, v: a + v)
    return found.select(F.col("time_ps").cast("long").alias("vec_id"), F.size("coords").alias("n"), F.round(F.col("coords")[0], 7).alias("x"), F.round(total, 5).alias("total"), F.round(F.col("cell")[1], 9).alias("cell_ay"))


WRITTEN_SQL = "WITH e AS (SELECT vec_id, list_transform(embedding[1:63], lambda v: v::DOUBLE) AS c FROM embeddings) SELECT vec_id, len(c)::INTEGER AS n, round(c[1], 7) AS x, round(list_reduce(list_concat([0.0::DOUBLE], c), lambda a, v: a + v), 5) AS total, 0.1::DOUBLE AS cell_ay FROM e"


def orders_sql(rest: str) -> str:
    return f"WITH {SQL_I}, {rest}"


def queries() -> dict:
    out = {
        "evt_islands": q_islands, "evt_islands_multi_source": q_islands_multi, "evt_time_monotonic_check": q_monotonic,
        **{n: predicate_query(p) for n, (p, _) in PREDICATES.items()},
        "tmp_for": q_for, "tmp_repeats": q_repeats(), "tmp_repeats_within": q_repeats(4 * DAY),
        "tmp_before": pair_counts(T.before_pairs), "tmp_after": pair_counts(T.after_pairs), "tmp_precedes": pair_counts(T.precedes_pairs),
        "tmp_overlaps": interval_pairs(T.overlap_pairs), "tmp_during": interval_pairs(T.during_pairs), "tmp_immediately_followed_by": interval_pairs(T.immediate_pairs),
        "tmp_followed_by": q_followed(), "tmp_followed_by_within": q_followed(DAY), "tmp_until": q_followed(None, "UNTIL"), "tmp_chain": q_chain,
        "ana_recurrence": q_recurrence,
        "ana_frequency": lambda s, d: by_customer(rounded(A.event_frequency(intervals(s, d), 1000.0), "frequency_per_ps")),
        "ana_conditional_probability": lambda s, d: by_customer(rounded(A.conditional_probability(intervals(s, d), "1-URGENT", "5-LOW", 100.0), "probability")),
        "ana_transition_matrix": lambda s, d: by_customer(A.transition_matrix(intervals(s, d), tie=("key",))),
        "ana_motifs": lambda s, d: by_customer(A.motifs(intervals(s, d), 2, 200.0, tie=("key",)).withColumn("motif", F.array_join("motif", ">"))),
        "ana_recurring": lambda s, d: by_customer(A.recurring_subsequences(intervals(s, d), 2, 2, tie=("key",)).withColumn("motif", F.array_join("motif", ">"))),
        "ana_clusters": q_clusters,
        "ana_event_graph": lambda s, d: by_customer(A.graph_edges(intervals(s, d), 100.0, tie=("key",))),
        "ana_state_network": q_state_network,
        **{n: q_selection(t) for n, (t, _) in SELECTIONS.items()},
        **{n: (lambda make: lambda s, d: make(s))(make) for n, (make, _) in FILES.items()}, "src_written_frames": q_written_frames,
        **{n: observed(t) for n, (t, _) in OBSERVED.items()},
        "obs_hbond": observed("HBOND(name N, name O)", "hbond"),
        "obs_sasa": observed("SASA(resid 1) > 2.5nm2", scale=4.0),
        "obs_distance_pbc_ortho": observed(f"DISTANCE({SEL}) < 0.2nm", scale=4.0, cell=[1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]),
        "obs_distance_pbc_triclinic": observed("DISTANCE(resid 1 and name N, resid 5 and name N) < 0.45nm", scale=4.0, cell=TRICLINIC),
        "obs_rg_pbc_unwrap": observed("RG(resid 1:6) < 0.8nm", scale=4.0, cell=[1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]),
    }
    return out


UNWRAP = """st AS (SELECT f, k, r, name, x - lag(x, 1, x) OVER w AS dx, y - lag(y, 1, y) OVER w AS dy, z - lag(z, 1, z) OVER w AS dz FROM x WINDOW w AS (PARTITION BY f ORDER BY k)),
u AS (SELECT f, k, r, sum(dx - round(dx)) OVER w AS x, sum(dy - round(dy)) OVER w AS y, sum(dz - round(dz)) OVER w AS z FROM st WINDOW w AS (PARTITION BY f ORDER BY k)),
c AS (SELECT f, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM u WHERE r <= 6 GROUP BY f), o AS (SELECT u.f, sqrt(avg((x - cx)^2 + (y - cy)^2 + (z - cz)^2)) AS value FROM u JOIN c ON c.f = u.f WHERE r <= 6 GROUP BY u.f)"""


def oracle_sql() -> dict[str, str]:
    multi = " UNION ALL ".join(f"SELECT '{n}' AS source, user_id, st AS start_ps, en AS end_ps, en - st AS duration_ps FROM {n}" for n in "abc")
    out = {
        "evt_islands": f"WITH {SQL_S}, {sql_runs('a', 'value > 50')} {SHOW} a",
        "evt_islands_multi_source": f"WITH {SQL_S}, {sql_runs('a', 'value > 50')}, {sql_runs('b', CLICKED)}, {sql_runs('c', LOW_OR_ERROR)} {multi}",
        "evt_time_monotonic_check": f"WITH {SQL_S}, {sql_runs('a', 'value IS NOT NULL')} SELECT 'as it is' AS input, (SELECT count(*) FROM a) AS n_runs, false AS refused UNION ALL SELECT unnest(['same time', 'earlier', 'infinite']), NULL, true",
        **{n: f"WITH {SQL_S}, {sql_runs('a', p)} {SHOW} a" for n, (_, p) in PREDICATES.items()},
        "tmp_for": f"WITH {SQL_S}, {sql_runs('a', 'value > 30')}, k AS (SELECT user_id, st, en, row_number() OVER (PARTITION BY user_id ORDER BY st) AS seq, 'a' AS type, 'a' AS selections, '' AS metadata FROM a WHERE en - st >= {DAY / 4}) {COMPOSITE} k",
        "tmp_repeats": sql_repeats(),
        "tmp_repeats_within": sql_repeats(f" AND en - st <= {4 * DAY}"),
        "tmp_before": sql_pair_counts("h.en <= l.st"), "tmp_after": sql_pair_counts("h.st >= l.en"), "tmp_precedes": sql_pair_counts("h.en < l.st"),
        "tmp_overlaps": sql_interval_pairs("a.st <= b.en AND b.st <= a.en"), "tmp_during": sql_interval_pairs("b.st <= a.st AND a.en <= b.en"), "tmp_immediately_followed_by": sql_interval_pairs("a.en = b.st"),
        "tmp_followed_by": f"WITH {SQL_S}, {SQL_HIGH}, {SQL_LOW}, {sql_next('h', 'l', 'n')} {COMPOSITE} n",
        "tmp_followed_by_within": f"WITH {SQL_S}, {SQL_HIGH}, {SQL_LOW}, {sql_next('h', 'l', 'n', DAY)} {COMPOSITE} n",
        "tmp_until": f"WITH {SQL_S}, {SQL_HIGH}, {SQL_LOW}, {sql_next('h', 'l', 'n', relation='UNTIL')} {COMPOSITE} n",
        "tmp_chain": f"WITH {SQL_S}, {SQL_HIGH}, {SQL_LOW}, {SQL_CLICK}, {sql_next('h', 'l', 'n', 3 * DAY)}, {sql_next('n', 'c', 'z', DAY, ('FOLLOWED_BY', 'c'), selections='h,l,c')} {COMPOSITE} z",
        "ana_recurrence": orders_sql("g AS (SELECT *, CASE WHEN lag(en) OVER w IS NOT NULL THEN greatest(0.0::DOUBLE, st - lag(en) OVER w) END AS gap FROM i WINDOW w AS (PARTITION BY cust, type ORDER BY st, en)) SELECT cust, type, count(*) AS count, sum(dur) AS total_duration_ps, round(avg(dur), 6) AS mean_duration_ps, round(median(dur), 6) AS median_duration_ps, round(coalesce(avg(gap), 0.0::DOUBLE), 6) AS mean_gap_ps FROM g GROUP BY cust, type"),
        "ana_frequency": f"WITH {SQL_I} SELECT cust, type, round(count(*) / 1000.0::DOUBLE, 6) AS frequency_per_ps FROM i GROUP BY cust, type",
        "ana_conditional_probability": orders_sql("a AS (SELECT i.cust, max(CASE WHEN b.key IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit FROM i LEFT JOIN i b ON b.cust = i.cust AND b.type = '5-LOW' AND b.st >= i.en AND b.st <= i.en + 100.0::DOUBLE WHERE i.type = '1-URGENT' GROUP BY i.cust, i.key), p AS (SELECT cust, avg(hit)::DOUBLE AS p FROM a GROUP BY cust) SELECT DISTINCT i.cust, round(coalesce(p, 0.0::DOUBLE), 6) AS probability FROM i LEFT JOIN p ON p.cust = i.cust"),
        "ana_transition_matrix": orders_sql(f"{LEADS}, t AS (SELECT DISTINCT cust, type FROM i), k AS (SELECT cust, source, target, count(*) AS c FROM n WHERE target IS NOT NULL GROUP BY cust, source, target) SELECT a.cust, a.type AS source, b.type AS target, coalesce(c, 0) AS count FROM t a JOIN t b ON a.cust = b.cust LEFT JOIN k ON k.cust = a.cust AND k.source = a.type AND k.target = b.type"),
        "ana_motifs": orders_sql(f"n AS (SELECT cust, type || '>' || lead(type) OVER w AS motif, lead(en) OVER w - st AS span FROM i WINDOW w AS ({ORDER})) SELECT cust, motif, count(*) AS count FROM n WHERE motif IS NOT NULL AND span <= 200 GROUP BY cust, motif"),
        "ana_recurring": orders_sql(f"n AS (SELECT cust, type || '>' || lead(type) OVER w AS motif FROM i WINDOW w AS ({ORDER})) SELECT cust, motif, count(*) AS count FROM n WHERE motif IS NOT NULL GROUP BY cust, motif HAVING count(*) >= 2"),
        "ana_clusters": orders_sql(f"r AS (SELECT *, row_number() OVER w - 1 AS k, max(en) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WINDOW w AS ({ORDER})), c AS (SELECT *, sum(CASE WHEN st - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY k) AS cluster FROM r) SELECT cust, cluster::BIGINT AS cluster, min(st) AS start_ps, max(en) AS end_ps, count(*) AS n_events, string_agg(type, ',' ORDER BY k) AS types, min(k) AS first_index FROM c GROUP BY cust, cluster"),
        "ana_event_graph": orders_sql(f"k AS (SELECT *, row_number() OVER ({ORDER}) - 1 AS id FROM i) SELECT a.cust, a.id AS source, b.id AS target, b.st - a.en AS gap_ps FROM k a JOIN k b ON a.cust = b.cust AND b.id > a.id AND b.st >= a.en AND b.st - a.en <= 100"),
        "ana_state_network": orders_sql(f"{LEADS} SELECT cust, source, target, count(*) AS count FROM n WHERE target IS NOT NULL AND gap <= 20 GROUP BY cust, source, target"),
        **{n: sql_selection(w) for n, (_, w) in SELECTIONS.items()},
        **{n: sql for n, (_, sql) in FILES.items()}, "src_written_frames": WRITTEN_SQL,
        **{n: q for n, (_, q) in OBSERVED.items()},
        "obs_hbond": sql_frames("value", ctes=SQL_HBOND),
        "obs_sasa": sql_frames("value > 2.5", ctes=SQL_SASA, scale="4.0"),
        "obs_distance_pbc_ortho": sql_frames("value < 0.2", ctes=sql_pairs(S12, S57, "min(d)", 1.0), scale="4.0"),
        "obs_distance_pbc_triclinic": sql_frames("value < 0.45", ctes=SQL_TRICLINIC, scale="4.0"),
        "obs_rg_pbc_unwrap": sql_frames("value < 0.8", ctes=UNWRAP, scale="4.0"),
    }
    return out
