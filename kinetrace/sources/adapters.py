"""The test tables as samples, events and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selection import Atom
from .topology import Topology

RESIDUES = ("ARG", "ASP", "GLU", "PHE", "TYR", "SER", "HOH")
ATOMS = 21
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an observable sampled over time: traj_id = user_id, time in microseconds, value, event_type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("traj_id"), t.alias("at"), t.cast("double").alias("time_ps"), "value", "event_type")


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as events: traj_id = customer, from the order's day for key % 30 days, type = priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86400000000)).cast("double")
    length = (F.col("o_orderkey") % 30).cast("double")
    return o.select(F.col("o_custkey").cast("string").alias("traj_id"), F.col("o_orderkey").alias("key"), start.alias("start_ps"), (start + length).alias("end_ps"), length.alias("duration_ps"), F.col("o_orderpriority").alias("type"))


def part_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a table of atoms: residues by size, names, chains and elements in turn; every fifth atom has no element."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    key = F.col("p_partkey")
    element = F.when(key % 5 == 0, "").otherwise(pick(("N", "C", "C", "H"), key % 4))
    return p.select(key.alias("atom_index"), pick(("N", "CA", "C", "HA"), key % 4).alias("name"), pick(RESIDUES, F.col("p_size") % 7).alias("residue_name"), F.col("p_size").alias("residue_index"), pick("ABC", key % 3).alias("chain"), element.alias("element"))


def synthetic_topology(kind: str = "backbone") -> Topology:
    """21 atoms in 7 residues of N, CA, C; kind hbond: N, H, O instead. Neighbours are bonded."""
    names, elements = (("N", "CA", "C"), ("N", "C", "C")) if kind == "backbone" else (("N", "H", "O"), ("N", "H", "O"))
    atoms = [Atom(i, names[i % 3], RESIDUES[i // 3], 1 + i // 3, "A" if i < 12 else "B", elements[i % 3]) for i in range(ATOMS)]
    return Topology.of(atoms, [(i, i + 1) for i in range(ATOMS - 1)])


def embedding_frames(spark: SparkSession, sf_dir: str, scale: float = 1.0, cell: list[float] | None = None) -> DataFrame:
    """embeddings as frames of one trajectory: the first 63 numbers are coordinates, vec_id place and time."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coords = F.slice(F.col("embedding").cast("array<double>"), 1, 3 * ATOMS)
    coords = coords if scale == 1.0 else F.transform(coords, lambda x: x * F.lit(scale))
    own = F.array(*[F.lit(float(c)) for c in cell]) if cell else F.lit(None).cast("array<double>")
    return e.select(F.lit("embeddings").alias("traj_id"), F.col("vec_id").alias("frame_idx"), F.col("vec_id").cast("double").alias("time_ps"), coords.alias("coords"), own.alias("cell"))
