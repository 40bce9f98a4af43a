"""Embedding near-dedup: spherical-cap filters from structured random product codes.

A filter is a direction made of one codeword for each block of dimensions.  A vector falls
into every filter whose direction has an inner product with it of at least ``alpha``; these
are found by going through the blocks and leaving out partial sums that can't get there.
Vectors that share a filter are compared exactly.  A pair counts in the smallest filter that
both share, so that counts of links add up and no pairs have to be dealt out.

A table's rotation is drawn at random, so that two vectors share one of its filters with a
chance that depends on their angle only; ``plan`` measures it and takes as many tables as the
recall needs.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, fresh, named, names_of, small_batches, stash, table

COSINE = 0.95
#: Independent rotations with a product code each, at the least; filters of one that a vector falls into on average; vectors at random that one filter gets.
TABLES, FILTERS_PER_TABLE, VECTORS_PER_FILTER = 12, 2, 4
#: Share of the pairs of just the given cosine that share a filter, whatever the number of vectors.
RECALL = 0.999
#: Tables and random pairs in each that the chance of a shared filter is measured on; caps of a lesser chance are made wider.
TRIAL_TABLES, TRIAL_PAIRS, LEAST_CHANCE = 16, 250, 0.1
MOST_CODEWORDS = 512
#: A larger filter is dealt out in pairs of parts of about this size.
PART = 512
#: Shared filters of a group that are looked at together.
COLUMNS = 1 << 13


@lru_cache(16)
def cap_table(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of the unit sphere within each of a direction."""
    angle = np.linspace(0, np.pi, 100_001)
    density = np.sin(angle) ** (dim - 2)
    area = np.concatenate([[0], np.cumsum(density[1:] + density[:-1])])
    return angle, area / area[-1]


def cap(share: float, dim: int) -> float:
    """The inner product that such a share of all unit vectors has at least with a direction."""
    if dim < 2:
        return 0.5
    angle, area = cap_table(dim)
    return float(np.cos(np.interp(share, area, angle)))


def chance(dim: int, blocks: int, words: int, alpha: float, cosine: float) -> float:
    """How likely two vectors of that cosine share a filter of one table: two standard errors less than measured."""
    hits, pairs = 0, TRIAL_TABLES * TRIAL_PAIRS
    for t, (turn, books) in enumerate(codes(dim, blocks, words, TRIAL_TABLES)):
        rng = np.random.default_rng([dim, t, 1])
        x, y = rng.standard_normal((2, TRIAL_PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y = cosine * x + sqrt(max(0.0, 1 - cosine * cosine)) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = (decode(z @ turn, words, alpha, books) for z in (x, y))
        hits += sum(bool(np.isin(p, q).any()) for p, q in zip(a, b, strict=True))
    p = hits / pairs
    return p - 2 * sqrt(p * (1 - p) / pairs)


@lru_cache(64)
def plan(n: int, dim: int, cosine: float = COSINE) -> tuple[int, int, float, int]:
    """Blocks, codewords in each, alpha and tables, such that filters stay of a size and recall is at least RECALL, whatever the number n of vectors.

    With few dimensions such caps would be narrower than the angle of a link; they are made wider.
    """
    share = min(0.25, VECTORS_PER_FILTER / max(n, 1))
    while True:
        filters = FILTERS_PER_TABLE / share
        blocks = 1
        while filters > MOST_CODEWORDS**blocks and blocks < dim:
            blocks += 1
        blocks = min(max(blocks, 2), dim)
        words, alpha = max(2, ceil(filters ** (1 / blocks))), cap(share, dim)
        if dim < 2:  # only opposite vectors, which never link
            return blocks, words, alpha, TABLES
        p = chance(dim, blocks, words, alpha, cosine)
        if p >= LEAST_CHANCE or (share == 0.25 and p > 0):
            return blocks, words, alpha, max(TABLES, ceil(log(1 - RECALL) / log(1 - p))) if p < 1 else TABLES
        if share == 0.25:
            raise ValueError(f"no filters for vectors of {dim} dimensions at a cosine of {cosine}")
        share = min(0.25, 4 * share)


@lru_cache(16)
def codes(dim: int, blocks: int, words: int, tables: int) -> list[tuple[np.ndarray, list[tuple[slice, np.ndarray]]]]:
    """For each table a rotation, and for each block its dimensions and random codewords, scaled so that a whole direction has length 1."""
    out = []
    for t in range(tables):
        rng, books, at = np.random.default_rng([dim, t]), [], 0
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for b in range(blocks):
            size = dim // blocks + (b < dim % blocks)
            c = rng.standard_normal((words, size))
            books.append((slice(at, at + size), c / np.linalg.norm(c, axis=1, keepdims=True) * sqrt(size / dim)))
            at += size
        out.append((turn, books))
    return out


def decode(x: np.ndarray, words: int, alpha: float, books: list[tuple[slice, np.ndarray]]) -> list[np.ndarray]:
    """The filters of each row of x (unit vectors) in one table: all whose direction has an inner product of at least alpha.

    A vector that none gets has the one of the best codeword in each block.
    """
    parts = [x[:, s] @ c.T for s, c in books]
    best = np.stack([p.max(1) for p in parts], 1)
    rest = np.concatenate([np.cumsum(best[:, ::-1], 1)[:, ::-1], np.zeros((len(x), 1))], 1)
    out = []
    for i in range(len(x)):
        total, code = np.zeros(1), np.zeros(1, np.int64)
        for b, p in enumerate(parts):
            to = total[:, None] + p[i][None, :]
            u, v = np.nonzero(to >= alpha - rest[i, b + 1] - 1e-12)
            total, code = to[u, v], code[u] * words + v
        if not len(code):
            code = np.zeros(1, np.int64)
            for p in parts:
                code = code * words + p[i].argmax()
        out.append(code)
    return out


def filters_of(x: np.ndarray, planned: tuple[int, int, float, int], first: int = 0) -> list[np.ndarray]:
    """The sorted filters of each row of x in all tables of a plan; its tables are numbered from first."""
    blocks, words, alpha, tables = planned
    each = [[c + ((first + t) << 40) for c in decode(x @ turn, words, alpha, books)] for t, (turn, books) in enumerate(codes(x.shape[1], blocks, words, tables))]
    return [np.sort(np.concatenate(f)) for f in zip(*each, strict=True)]


def unit(v: list | None) -> np.ndarray | None:
    """The vector over its length, in double precision; None for what links with nothing."""
    if not v or any(c is None for c in v):
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def own_links(filter_: int, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, cosine: float):
    """Links between the rows left and right of a filter that no smaller filter has: (copies linked to each row, edges of a spanning forest)."""
    near = x[left] @ x[right].T >= cosine
    near &= ids[left][:, None] != ids[right][None, :]
    if len(left) == len(right) and (left == right).all():
        same = True
    else:
        same = False
    linked = np.zeros(len(ids), np.int64)
    if not near.any():
        return linked, []
    smaller = [f[f < filter_] for f in lists]
    known, back = np.unique(np.concatenate(smaller), return_inverse=True) if any(map(len, smaller)) else (np.empty(0), np.empty(0, int))
    if len(known):
        row = np.repeat(np.arange(len(ids)), [len(f) for f in smaller])
        often = np.bincount(back, minlength=len(known)) > 1
        if often.any():
            place = np.cumsum(often) - 1
            keep = often[back]
            row, place = row[keep], place[back[keep]]
            for at in range(0, int(often.sum()), COLUMNS):
                own = (place >= at) & (place < at + COLUMNS)
                m = np.zeros((len(ids), min(COLUMNS, int(often.sum()) - at)), np.float32)
                m[row[own], place[own] - at] = 1
                near &= (m[left] @ m[right].T) == 0
    linked[left] += near @ copies[right]
    if not same:
        linked[right] += near.T @ copies[left]
    root = list(range(len(ids)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    edges = []
    for i, row_ in zip(left.tolist(), near, strict=True):
        for j in right[row_].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((i, j))
    return linked, edges


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of vectors (vec_id, embedding).

    Two vectors link if the cosine of their angle, in double precision, is at least ``cosine``;
    every link given is exact, and of links of just that cosine about one in a thousand is missed, whatever
    the numbers of vectors and dimensions, and fewer of closer ones.  n_links counts the other rows linked directly, equal vectors
    among them; component_id is the smallest vec_id reachable by links.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different length.  Repeated rows are rows of their own and link with each other.  Other columns
    are left out, an empty table gives no rows.  A row without an id gets null for component_id and kept where it links
    with no row that has one.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    names = ["vec_id", "h1", "h2", "good"]

    def hashed(batches):
        for b in batches:
            x = [unit(v) for v in b.column(1).to_pylist()]
            d = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() if u is not None else bytes(16) for u in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int.from_bytes(k[:8], "little", signed=True) for k in d], pa.int64()), pa.array([int.from_bytes(k[8:], "little", signed=True) for k in d], pa.int64()), pa.array([u is not None for u in x], pa.bool_()), b.column(1)], names=[*names, "embedding"])

    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = stash(v.mapInArrow(hashed, "vec_id long, h1 long, h2 long, good boolean, embedding array<double>"), "vectors")
    # Equal directions are one class, by a digest of 128 bits; copies are counted before anything is dealt out.
    classes = v.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = stash(classes, "classes")
    name = named(names_of(classes, "h1", "h2"), "h1", "h2")
    classes = classes.withColumn("c", name)
    plans, first = {}, 0
    for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        plans[r.dim] = plan(r.n, r.dim, cosine), first
        first += plans[r.dim][0][3]

    def filters(batches):
        for b in batches:
            x = [unit(e) for e in b.column(2).to_pylist()]
            found: list = [None] * len(x)
            for dim in {len(u) for u in x}:
                own = [i for i, u in enumerate(x) if len(u) == dim]
                for i, f in zip(own, filters_of(np.stack([x[i] for i in own]), *plans[dim]), strict=True):
                    found[i] = f
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int64()))], names=["c", "copies", "x", "filters"])

    decoded = stash(classes.select("c", "copies", "embedding").mapInArrow(filters, "c long, copies long, x array<double>, filters array<long>"), "filters")
    light = decoded.select("c", F.explode("filters").alias("filter"))
    sizes = light.groupBy("filter").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    placed = light.join(fresh(sizes), "filter").withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    placed = placed.select("c", "filter", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    placed = placed.select("c", "filter", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    whole = placed.join(decoded, "c").select("filter", "i", "j", "part", "c", "copies", "x", "filters")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = whole.repartition(parts, "filter", "i", "j").sortWithinPartitions("filter", "i", "j")

    def compare(batches):
        held: list[tuple] = []

        def done():
            if len(held) < 2:
                return None
            (filter_, i, j), ids = held[0][0], np.array([h[2] for h in held], np.int64)
            copies, x, part = np.array([h[3] for h in held], np.int64), np.stack([h[4] for h in held]), np.array([h[1] for h in held])
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            linked, edges = own_links(filter_, ids, copies, x, [h[5] for h in held], left, right, cosine)
            rows = [(int(ids[k]), None, int(linked[k])) for k in np.flatnonzero(linked)]
            return rows + [(int(ids[a]), int(ids[b]), 0) for a, b in edges]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["c", "d", "linked"])

        out: list[tuple] = []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            xs, fs = b.column(6), b.column(7)
            for r, (f, i, j, part, c, m) in enumerate(zip(*cols, strict=True)):
                if held and held[0][0] != (f, i, j):
                    out += done() or []
                    held = []
                held.append(((f, i, j), part, c, m, xs[r].values.to_numpy(), fs[r].values.to_numpy()))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        out += done() or []
        if out:
            yield batch(out)

    found = stash(whole.mapInArrow(compare, "c long, d long, linked long"), "links")
    totals = found.groupBy("c").agg(F.sum("linked").alias("linked"))
    labels = components(found.where("d is not null"), "c", "d")
    state = classes.select("c", "rep", "copies").join(totals, "c", "left").join(fresh(labels.withColumnRenamed("id", "c")), "c", "left")
    state = stash(state.select("c", "rep", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("comp", "c").alias("comp")), "state")
    least = state.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = stash(state.join(fresh(least), "comp").select("c", "n_links", "component_id", F.lit(True).alias("good")), "known")
    discard(decoded, found)
    out = v.select("vec_id", name.alias("c"), "good").join(known, ["c", "good"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all embeddings. See near_duplicates for odd rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND list_cosine_similarity(v, v) > 0.5 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
way AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, way.b FROM reach JOIN way ON way.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM way GROUP BY a)
SELECT least.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, least.id = component_id AS kept FROM least LEFT JOIN n ON n.a = least.id
"""
