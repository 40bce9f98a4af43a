"""Helpers shared by the corpus operators: shared-folder tables, numbering, components."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import math
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word and line contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and all runs in one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_kinetrace_shared", None):
        sc._kinetrace_shared = tempfile.mkdtemp(prefix="kinetrace-")
        sc.setCheckpointDir(sc._kinetrace_shared)
    return sc._kinetrace_shared


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinetrace/{name}-{uuid.uuid4().hex}"


@contextmanager
def exchanges_deleted(spark: SparkSession):
    """What is evaluated meanwhile leaves no exchange files: Spark keeps them until the driver collects its garbage, however much disk they take."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stash(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with exchanges_deleted(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path, None
    return out


def stash_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """The same in buckets of a key, so that joins on it deal out the other side only."""
    spark = df.sparkSession
    parts, path = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), new_path(spark, name)
    table_ = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with exchanges_deleted(spark):
        df.write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(table_)
    out = spark.table(table_)
    out._stored = path, table_
    return out


def discard(*stored: DataFrame | None) -> None:
    """Delete what stash and stash_by have stored, once no table to come reads it; others are left alone."""
    for df in stored:
        path, table_ = getattr(df, "_stored", (None, None))
        if table_:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table_}")
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Long texts: fewer rows in an Arrow batch, so that a batch stays within some MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def tidied(run):
    """An Arrow function that gives memory back when it ends: its worker lives on and shares an executor with those of other stages."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether a row lies in the fold that is not learned from; false where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def excerpt(text: str, chars: int, pieces: int = 10):
    """A text of at most so many code points: of a longer one, pieces spread evenly from its start to its end, on lines of their own."""
    size = chars // pieces - 1
    at = lambda i: (F.floor((F.length(text) - size) * i / (pieces - 1)) + 1).cast("int")
    return F.when(F.length(text) <= chars, F.col(text)).otherwise(F.concat_ws("\n", *[F.substring(F.col(text), at(i), F.lit(size)) for i in range(pieces)]))


def fresh(df: DataFrame) -> DataFrame:
    """Deal an aggregate anew, in as many partitions as its size calls for, so that a join on its keys exchanges both sides and AQE may split a hot key."""
    return df.hint("rebalance")


def names_of(classes: DataFrame, first: str, second: str) -> dict[tuple[int, int], int]:
    """New names for classes of which the first half of a 128-bit digest is another's too; all others go by that half.

    Of 10**11 classes some hundred are expected here, of 10**9 none.
    """
    own = classes.select(F.col(first).alias("a"), F.col(second).alias("b"))
    shared = own.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").select("a")
    found = [(r.a, r.b) for r in own.join(shared, "a", "left_semi").distinct().collect()] if shared.head(1) else []
    names: dict[tuple[int, int], int] = {}
    for a, b in sorted(found):
        turn = 0
        while names.get((a, b)) is None:
            name = int.from_bytes(hashlib.blake2b(f"{a} {b} {turn}".encode(), digest_size=8).digest(), "little", signed=True)
            if name not in names.values() and not own.where(F.col("a") == name).head(1):
                names[a, b] = name
            turn += 1
    return names


def named(names: dict[tuple[int, int], int], first: str, second: str) -> Column:
    """The name of a class by the halves of its digest."""
    cases = [F.when((F.col(first) == a) & (F.col(second) == b), F.lit(n)) for (a, b), n in names.items()]
    return F.coalesce(*cases, F.col(first)) if cases else F.col(first)


#: Bits of a filter for each key that it holds, and the most bits in all (32 MB); fuller ones let more through.
BITS_A_KEY, MOST_BITS, BLOCK_BITS = 64, 28, 19


@lru_cache(2)
def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def held(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether a filter holds the low bits of each key: true for all that it was made from and a few others."""
    at = keys & (8 * len(data) - 1)
    return (unpacked(data)[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def key_filter(keys: DataFrame, n: int) -> bytes:
    """A bitmap of the low bits of n 64-bit keys (the one column of keys), each block of it made in one task."""
    bits = min(MOST_BITS, max(BLOCK_BITS, (BITS_A_KEY * max(n, 1) - 1).bit_length()))
    size, block = 1 << bits, 1 << BLOCK_BITS

    def mark(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy() & (size - 1)
            for k in np.unique(at // block).tolist():
                own.setdefault(k, np.zeros(block, bool))[at[at // block == k] % block] = True
        for k, marks in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["block", "bits"])

    name = keys.columns[0]
    rows = keys.where(F.col(name).isNotNull()).repartition(size // block, F.floor(F.col(name).bitwiseAND(size - 1) / block)).mapInArrow(mark, "block long, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in rows.collect():  # at most 512 rows of 64 KB
        out[r.block * block // 8 : (r.block + 1) * block // 8] |= np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


def maybe_held(data: bytes, key: Column) -> Column:
    """held for a column of keys that aren't null: only they go to Python, not the rows."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(held(data, keys.to_numpy()))

    return F.arrow_udf(run, "boolean")(key)


def numbered(df: DataFrame, group: list[str], by: list[str], total: int, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no single task.

    Rows are dealt into bins by a hash of ``by``, numbered inside a bin, and shifted
    by the sizes of the earlier bins.  ``df`` is read twice: pass a stored table.
    """
    size = max(512, math.isqrt(max(total, 1)))
    bins = max(1, math.ceil(total / size))
    d = df.withColumn("__bin", F.pmod(F.xxhash64(*by), F.lit(bins)))
    keys = [*group, "__bin"]
    before = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    shift = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inner = d.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long") - 1)
    return inner.join(shift, keys).withColumn(out, F.col("__rn") + F.col("__shift")).drop("__bin", "__rn", "__shift")


def components(edges: DataFrame, a: str = "a", b: str = "b", out: str = "comp") -> DataFrame:
    """Connected components of an undirected graph: (id, comp), comp the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Every step deals
    at most one row per edge; a step's table is stored, so lineage stays short, and the one
    before it is deleted.  The least neighbours are dealt anew, so that AQE may split the
    edges of one vertex that has a large share of them.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stash(e, "edges")

    def signature(d: DataFrame):
        r = d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = signature(e)
    while True:
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(fresh(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        l2 = large.join(fresh(least), "u")
        small = l2.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, e = e, stash(small, "edges")
        then = signature(e)
        discard(before)
        if then == now:
            break
        now = then
    ids = e.select(F.col("u").alias("id"), F.col("v").alias(out))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias(out)).distinct()
    return ids.union(roots)
