"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets at similarity 3/4.

Equal sets count as one class, found by a digest.  Two classes link when
100 * intersection >= 75 * union.  Then at least ceil(3n/4) shingles of a set of n are
common, so that in any one order of all shingles the first k common ones lie among the
first n - ceil(3n/4) + k of either set.  The order is by a count-min sketch of the corpus,
rare shingles first.

* Small sets (at most ``boundary`` shingles) enumerate the subsets of two of their first
  n - ceil(3n/4) + 2 shingles: keys that few unrelated sets share.
* Large sets scan the inverted lists of the single shingles of their first
  n - ceil(3n/4) + 1; so do small sets of at least 3/4 of the boundary, for the large
  sets they may link with.

The boundary is where the estimated cost, subsets against list entries and what a scan of
a list meets, is least.  Only short lists give all their pairs.  A long list first links its
members to one of them, in later rounds to some others; only classes of the same
list that are still in different components are then paired, but for those that the
triangle inequality keeps apart.

Candidates are first compared by images of their sets, bitmaps of 1 KB that bound what two
sets can share; only classes with a pair that may still link are dealt out as whole sets, on
which each such pair is verified.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, fresh, held, key_filter, maybe_held, named, names_of, small_batches, stash, stash_by, table, tidied

WORDS, PERCENT = 5, 75
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 14
BOUNDARIES = (0, 4, 8, 12, 16, 24, 32, 48, 64)
#: Members of a list that the others are compared with, in each round.
HUBS = (1, 16)
ROUNDS = len(HUBS)
#: Members of an open list to which distances are measured before its other pairs are.
REFERENCES = 3
#: The partners of a class are held in so many lists.
PARTNER_LISTS = 16
#: Bits of the image of a set. An image is crowded if its set has more than CROWDED shingles for each bit set.
IMAGE_BITS, CROWDED = 1 << 13, 1.25
#: Most distance of the images of two linked sets, for one shingle a bit: by (n + m) * (100 - PERCENT) / (100 + PERCENT) >= the shingles not shared.
LINK = 2 * (100 - PERCENT) / (100 + PERCENT)
#: Width of the bands of distances that pairs of an open list are looked for in, a little over the most for images that aren't crowded.
BAND = LINK * CROWDED + 4e-9
BANDS = int(1 / BAND) + 2
#: All pairs of a list of so many classes are candidates; longer lists go by hubs.
SHORT_LIST = 16
PAIRING = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles (A-Z lower-cased, words apart by [\\x20\\x09-\\x0D]).

    With fewer words than a shingle has, the whole sequence is the one shingle.  All words
    of a batch are hashed in one array; runs across two texts are left out.
    """
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    sizes = [len(w) for w in split]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, sum(sizes))
    n = len(h) - words + 1
    run = np.zeros(max(n, 0), np.uint64)
    for i in range(words if n > 0 else 0):
        run *= PAIRING
        run += h[i : i + n]
        run ^= run >> np.uint64(32)
        run *= np.uint64(0xFF51AFD7ED558CCD)
        run ^= run >> np.uint64(29)
    out, at = [], 0
    for w, size in zip(split, sizes, strict=True):
        if size >= words:
            s = run[at : at + size - words + 1]
            s.sort()
            distinct = np.empty(len(s), bool)
            distinct[0] = True
            np.not_equal(s[1:], s[:-1], out=distinct[1:])
            out.append(s[distinct])
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers; (0, 0) for the empty one."""
    if not len(s):
        return 0, 0
    d = xxhash.xxh3_128_digest(s)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def surveyed(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts: (doc_id, h, c1, c2, n_shingles) for each row, and a sketch of the corpus. h: the hash of the text.

    The sketch has the counts of all shingles by hash, one byte each on a logarithmic scale
    (8 steps a doubling).  Its size is fixed: 2**20 counters, summed over blocks before they
    reach the driver.
    """
    size = 1 << SKETCH_BITS
    names = ["block", "counts", "doc_id", "h", "c1", "c2", "n_shingles"]
    types = [pa.int64(), pa.binary(), *[pa.int64()] * 5]

    @tidied
    def run(batches):
        total, seen = np.zeros(size, np.int64), False
        for b in batches:
            own = shingle_sets(b.column(1).to_pylist())
            if own:
                total += np.bincount((np.concatenate(own) & np.uint64(size - 1)).astype(np.int64), minlength=size)
                seen = True
            d = [digest(s) for s in own]
            none = [None] * len(own)
            cols = [none, none, b.column(0), b.column(2), [x[0] for x in d], [x[1] for x in d], [len(s) for s in own]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        for i in range(0, size if seen else 0, SKETCH_BLOCK):
            cols = [[i // SKETCH_BLOCK], [total[i : i + SKETCH_BLOCK].astype("<u4").tobytes()], *[[None]] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def summed(batches):
        """Blocks come sorted: one running sum at a time."""
        at, total = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8).tobytes()], pa.binary())], names=["block", "counts"])

        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, total = block, np.zeros(SKETCH_BLOCK, np.int64)
                total += np.frombuffer(counts, "<u4")
        if at is not None:
            yield done()

    found = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("h")).mapInArrow(run, "block long, counts binary, doc_id long, h long, c1 long, c2 long, n_shingles long"), "survey", "zstd")
    parts = found.where("block IS NOT NULL").select("block", "counts")
    out = np.zeros(size, np.uint8)
    for r in parts.repartition(size // SKETCH_BLOCK, "block").sortWithinPartitions("block").mapInArrow(summed, "block long, counts binary").collect():
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(r.counts), np.uint8)
    return found.where("block IS NULL").select("doc_id", "h", "c1", "c2", "n_shingles"), out


def first(n: int, k: int) -> int:
    """How many of the rarest shingles of a set of n hold the k rarest of those it must share with any set it links with."""
    return min(n, n - -(-PERCENT * n // 100) + k)


def choose_boundary(sizes: dict[int, int], counts: np.ndarray) -> int:
    """The boundary of least cost. sizes: numbers of sets by size (rounded to 3 bits); counts: the sketch.

    A key costs 1 to deal out.  A single shingle also costs what a scan of its list meets:
    the mean excess of a counter over the usual one, as seen from a shingle at random.
    """
    c = 2.0 ** (counts.astype(float) / 8) - 1
    usual = np.median(c)
    met = float((c * np.maximum(c - usual - 3 * np.sqrt(usual), 0)).sum() / max(c.sum(), 1) / max(usual, 1))
    scan = 1 + min(met, 1000.0)

    def cost(x: int) -> float:
        pairs = sum(m * first(n, 2) * (first(n, 2) - 1) / 2 for n, m in sizes.items() if 3 <= n <= x)
        single = sum(m * first(n, 1) * scan for n, m in sizes.items() if n > 0.75 * x and n >= 3)
        return pairs + single

    return min(BOUNDARIES, key=cost)


def keys_of(s: np.ndarray, counts: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set of at least 3 shingles is listed, and the most it can share with a set if that key is the first they share.

    Keys of subsets are even numbers, those of single shingles odd.
    """
    n = len(s)
    rank = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    k = first(n, 2)
    s = s[np.lexsort((s, rank))[:k]]
    keys, most = [], []
    if n <= boundary:
        i, j = np.triu_indices(len(s), 1)
        a, b = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
        keys.append(mixed(a * PAIRING + mixed(b + np.uint64(7))) & ~np.uint64(1))
        most.append(n - j + 1)
    if n > 0.75 * boundary:
        keys.append(mixed(s[: first(n, 1)]) | np.uint64(1))
        most.append(n - np.arange(first(n, 1)))
    return np.concatenate(keys), np.concatenate(most)


def may_link(n, m, r, q):
    """Whether sets of n and m shingles that share at most r and q may link."""
    return (100 + PERCENT) * np.minimum(r, q) >= PERCENT * (n + m)


def listed(docs: DataFrame, counts: np.ndarray, boundary: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """What the lists hold: pairs (key, c, n, r, d, m) of short lists, and entries (key, c, n, r) of long ones.

    r of a pair is 1 if it may link with the key as the first it shares, else 0.
    A class is listed at most once by a task, however many copies it has there.  Lists are
    read in order of their keys, and no more than a batch and one short list is held.
    """
    names = ["key", "c", "n", "r"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    @tidied
    def run(batches):
        met: set[tuple[int, int]] = set()

        def batch(cols):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        cols, held = [[], [], [], []], 0
        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist()):
                if len(s) < 3 or (d := digest(s)) in met:
                    continue
                met.add(d)
                k, r = keys_of(s, counts, boundary)
                for c, v in zip(cols, (k.view(np.int64), np.full(len(k), renamed.get(d, d[0])), np.full(len(k), len(s), np.int32), r), strict=True):
                    c.append(v)
                held += len(k)
                if held > 50_000:
                    yield batch(cols)
                    cols, held = [[], [], [], []], 0
        if held:
            yield batch(cols)

    out_names = [*names, "d", "m"]
    out_types = [*types, pa.int64(), pa.int32()]

    @tidied
    def read(batches):
        last, long = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)], None
        for b in chain(batches, [None]):
            cols = last if b is None else [np.concatenate([x, c.to_numpy()]) for x, c in zip(last, b.columns, strict=True)]
            # Entries of one class in one list come together: tasks have listed its copies.
            fresh_ = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])] if len(cols[0]) else np.zeros(0, bool)
            cols = [c[fresh_] for c in cols]
            key = cols[0]
            if not len(key):
                continue
            # The last list may go on in the next batch, unless it is already long.
            cut = len(key) if b is None else int(np.searchsorted(key, key[-1]))
            more = len(key) - cut > SHORT_LIST
            if more:
                cut = len(key)
            last = [c[cut:] for c in cols]
            key, c, n, r = (x[:cut] for x in cols)
            if not cut:
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, cut])
            keep = np.repeat(sizes > SHORT_LIST, sizes)
            if long is not None:
                keep |= key == long
            if more:
                long = key[-1]
            if keep.any():
                count = int(keep.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array(x[keep], t) for x, t in zip((key, c, n, r), types, strict=True)), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int32())], names=out_names)
            left, right = [], []
            for size in range(2, SHORT_LIST + 1):
                own = starts[(sizes == size) & ~keep[starts]]
                if len(own):
                    i, j = np.triu_indices(size, 1)
                    left.append((own[:, None] + i).ravel())
                    right.append((own[:, None] + j).ravel())
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                near = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
                i, j = i[near], j[near]
                i, j = np.where(c[i] < c[j], i, j), np.where(c[i] < c[j], j, i)
                can = may_link(n[i], n[j], r[i], r[j]).astype(np.int32)
                for at in range(0, len(i), 50_000):
                    p, q = i[at : at + 50_000], j[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((key[p], c[p], n[p], can[at : at + 50_000], c[q], n[q]), out_types, strict=True)], names=out_names)

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = docs.select("text").mapInArrow(run, "key long, c long, n int, r int")
    return entries.repartition(parts, "key").sortWithinPartitions("key", "c").mapInArrow(read, "key long, c long, n int, r int, d long, m int")


def short_pairs(found: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of short lists that may link by the number of single shingles they share there.

    Beyond the ones counted, all that two sets share lies behind the first first(n, 1)
    shingles of one of them.  A pair of which one is in a long list, or that shares a subset, stays.
    """
    pairs = found.where("d IS NOT NULL").groupBy(F.col("c").alias("a"), F.col("d").alias("b"), "n", "m").agg(F.count(F.lit(1)).alias("t"), F.max((F.col("key").bitwiseAND(1) == 0).cast("int")).alias("subset"), F.max("r").alias("can")).where("can = 1")
    pairs = counted = stash(pairs, "counted", "zstd")
    behind = lambda n: F.least(F.ceil(PERCENT * F.col(n) / 100) - 1, F.col(n))
    enough = (100 + PERCENT) * (F.col("t") + F.greatest(behind("n"), behind("m"))) >= PERCENT * (F.col("n") + F.col("m"))
    few = pairs.where(~enough & (F.col("subset") == 0))
    long = lists.select("c").distinct()
    spared = few.join(long.withColumnRenamed("c", "a"), "a", "left_semi").union(few.join(long.select(F.col("c").alias("b")), "b", "left_semi").select(*few.columns))
    out = stash(pairs.where(enough | (F.col("subset") == 1)).select("a", "b").union(spared.select("a", "b").distinct()), "short-pairs")
    discard(counted)
    return out


def sets_of(docs: DataFrame, wanted: bytes, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(c, s): the sets of the classes that the filter holds (and a few more), by task one row for each class."""

    @tidied
    def run(batches):
        met = set()
        for b in batches:
            own = [s for s in shingle_sets(b.column(0).to_pylist()) if len(s) >= 3]
            named_ = [renamed.get(d, d[0]) for d in map(digest, own)]
            ids, sets = [], []
            for c, s, good in zip(named_, own, held(wanted, np.array(named_, np.int64)), strict=True):
                if good and c not in met:
                    met.add(c)
                    ids.append(c)
                    sets.append(s.view(np.int64))
            if ids:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["c", "s"])

    return docs.select("text").mapInArrow(run, "c long, s array<long>")


def image(s: np.ndarray) -> bytes:
    """The bits that a set's shingles fall on."""
    on = np.zeros(IMAGE_BITS, bool)
    on[(s & np.uint64(IMAGE_BITS - 1)).astype(np.int64)] = True
    return np.packbits(on).tobytes()


def images_of(docs: DataFrame, wanted: bytes, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(c, n, p, image): size, bits set and image of the classes that the filter holds (and a few more), by task one row for each class."""

    @tidied
    def run(batches):
        met = set()
        for b in batches:
            own = [s for s in shingle_sets(b.column(0).to_pylist()) if len(s) >= 3]
            named_ = [renamed.get(d, d[0]) for d in map(digest, own)]
            rows = []
            for c, s, good in zip(named_, own, held(wanted, np.array(named_, np.int64)), strict=True):
                if good and c not in met:
                    met.add(c)
                    bits = image(s)
                    rows.append((c, len(s), int(np.bitwise_count(np.frombuffer(bits, np.uint8)).sum()), bits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["c", "n", "p", "image"])

    return docs.select("text").mapInArrow(run, "c long, n int, p int, image binary")


def dealt_by_class(rows: DataFrame, name: str) -> DataFrame:
    """One row a class, stored in buckets of it."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stash_by(rows.repartition(parts, "c").dropDuplicates(["c"]), "c", name)


def faced(pairs: DataFrame, classes_: DataFrame, hubs: bool = False) -> DataFrame:
    """(a, b, x, y): pairs (a, b) with the other columns of both classes; classes_ lies in buckets of c and isn't dealt out again.

    The partners of a class meet its row in some lists, not one by one.  hubs: few classes b
    stand in many pairs.  Their rows are dealt anew together with the pairs, so that AQE may
    split the pairs of one hub.
    """
    held_ = F.struct(*[x for x in classes_.columns if x != "c"])
    theirs = classes_.select(F.col("c").alias("b"), held_.alias("y"))
    if hubs:
        theirs = fresh(theirs.join(pairs.select("b").distinct(), "b", "left_semi"))
    partners = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(PARTNER_LISTS)).alias("part")).agg(F.collect_list("b").alias("bs"))
    left = partners.join(classes_.select(F.col("c").alias("a"), held_.alias("x")), "a").select("a", "x", F.explode("bs").alias("b"))
    return left.join(theirs, "b").select("a", "b", "x", "y")


def shared_bits(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many bits are set in both images."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint64).reshape(len(v), -1) for v in (a, b))
    return pa.array(np.bitwise_count(x & y).sum(axis=1).astype(np.int32))


def imaged(pairs: DataFrame, images: DataFrame, hubs: bool = False) -> DataFrame:
    """(a, b, n, m, p, q, both) of pairs (a, b): sizes, bits set in either image and in both."""
    return faced(pairs, images, hubs).select("a", "b", F.col("x.n").alias("n"), F.col("y.n").alias("m"), F.col("x.p").alias("p"), F.col("y.p").alias("q"), F.arrow_udf(shared_bits, "int")("x.image", "y.image").alias("both"))


def bounded(pairs: DataFrame, images: DataFrame, hubs: bool = False) -> DataFrame:
    """The pairs (a, b) that may link by their images: a bit that only one image has stands for a shingle at least that only its set has."""
    most = F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) + F.col("both")
    return imaged(pairs, images, hubs).where((100 + PERCENT) * most >= PERCENT * (F.col("n") + F.col("m"))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, hubs: bool = False) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= 75 * union."""
    both = faced(pairs, sets, hubs).select("a", "b", F.size(F.array_intersect("x.s", "y.s")).alias("common"), (F.size("x.s") + F.size("y.s")).alias("total"))
    return both.where(100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).select("a", "b")


def linked(candidates: list[tuple[DataFrame, bool]], docs: DataFrame, images: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """The links (a, b) of candidates, tables of pairs (and whether few classes b stand in many); only sets of pairs that may link by their images are dealt out."""
    near = [(stash(bounded(pairs, images, hubs), "near"), hubs) for pairs, hubs in candidates]
    all_ = reduce(DataFrame.union, [pairs for pairs, _ in near])
    ids = all_.select(F.col("a").alias("c")).union(all_.select(F.col("b").alias("c"))).distinct()
    n = ids.count()
    sets = dealt_by_class(sets_of(docs, key_filter(ids, n), renamed), "sets") if n else None
    out = stash(reduce(DataFrame.union, [verified(pairs, sets, hubs) for pairs, hubs in near]) if n else all_, "links")
    discard(*[pairs for pairs, _ in near], sets)
    return out


def placed(entries: DataFrame, images: DataFrame) -> DataFrame:
    """Entries with d0, d1, ...: the Jaccard distances of their images to those of some members of their list, and load: shingles for each bit set.

    That distance is a metric: two classes link only if their distances to any third differ
    by no more than LINK times the larger load, the most that the images of a link are apart.
    """
    marks = entries.groupBy("key").agg(F.array(*[F.min_by("c", F.xxhash64(F.lit(-1 - i), "c")) for i in range(REFERENCES)]).alias("marks"))
    entries = stash(entries.join(fresh(marks), "key"), "marked")
    wanted = entries.select(F.col("c").alias("a"), F.explode("marks").alias("b")).distinct()
    d = imaged(wanted, images, True).select(F.col("a").alias("c"), (F.col("n") / F.col("p")).alias("load"), F.struct(F.col("b").alias("mark"), (1 - F.col("both") / (F.col("p") + F.col("q") - F.col("both"))).alias("d")).alias("x"))
    # At most REFERENCES marks for each list that a class is in.
    d = d.groupBy("c").agg(F.max("load").alias("load"), F.map_from_entries(F.collect_list("x")).alias("distance"))
    out = entries.join(fresh(d), "c")
    out = stash(out.select("key", "c", "n", "r", "comp", "load", *[F.element_at("distance", F.col("marks")[i]).alias(f"d{i}") for i in range(REFERENCES)]), "placed")
    discard(entries)
    return out


def open_pairs(left: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes of one list, not of one component, that may link.

    Both sides are dealt by list and band of distances to its first mark; pairs are looked for
    in one band and the next: others are too far apart, and no list is compared as a whole.
    Crowded images (of very large sets) tell little and are looked for in all bands.
    """
    # A pair is met at the first open key that both have, in the order of all shingles: there r is largest.
    own_keys = left.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("at"), "key"))), lambda x: x["key"]).alias("keys"))
    left = left.join(fresh(own_keys), "c").withColumn("band", F.floor(F.col("d0") / BAND).cast("int")).withColumn("crowded", F.col("load") > CROWDED)
    bands = lambda own: F.when(F.col("crowded"), F.array(*[F.lit(i) for i in range(BANDS)])).otherwise(F.array(*own))
    marks = [f"d{i}" for i in range(REFERENCES)]
    other = left.select("key", F.col("c").alias("d"), F.col("comp").alias("dcomp"), F.col("n").alias("m"), F.col("r").alias("q"), F.col("keys").alias("other_keys"), "band", "crowded", F.col("load").alias("other_load"), *[F.col(x).alias(f"e{x}") for x in marks])
    other = other.withColumn("own_band", F.col("band")).withColumn("band", F.explode(bands([F.col("own_band"), F.col("own_band") + 1]))).withColumnRenamed("crowded", "other_crowded")
    left = left.withColumn("band", F.explode(bands([F.col("band")])))
    near = reduce(and_, [F.abs(F.col(x) - F.col(f"e{x}")) <= LINK * F.greatest("load", "other_load") + 1e-9 for x in marks])
    pairs = left.join(other, ["key", "band"]).where(F.col("crowded") | F.col("other_crowded") | (F.col("band") > F.col("own_band")) | (F.col("c") < F.col("d")))
    pairs = pairs.where((F.col("comp") != F.col("dcomp")) & linkable("n", "m", "r", "q") & near & (F.get(F.array_intersect("keys", "other_keys"), F.lit(0)) == F.col("key")))
    return pairs.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))


def link_classes(docs: DataFrame, own: DataFrame, counts: np.ndarray, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(c, comp): components of classes, by their names; classes without links may be missing."""
    spark = docs.sparkSession
    step = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) - 2)
    sizes = own.where("n_shingles > 0").groupBy((F.floor(F.col("n_shingles") / step) * step).cast("long").alias("n")).agg(F.countDistinct("c").alias("m")).collect()
    found = stash(listed(docs, counts, choose_boundary({r.n: r.m for r in sizes}, counts), renamed), "lists", "zstd")
    lists = found.where("d IS NULL").select("key", "c", "n", "r")
    short = short_pairs(found, lists)
    ids = short.select(F.col("a").alias("c")).union(short.select(F.col("b").alias("c"))).union(lists.select("c")).distinct()
    # Documents without candidates aren't dealt out.
    images = dealt_by_class(images_of(docs, key_filter(ids, ids.count()), renamed), "images")
    links = labels = tried = None
    stored = [found, short, images]
    for turn in range(ROUNDS + 1):
        if labels is None:
            now = lists.withColumn("comp", F.col("c"))
        else:
            now = lists.join(fresh(labels.withColumnRenamed("id", "c")), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        hub = [F.min_by(F.struct("c", "comp", "n", "r"), F.xxhash64(F.lit(turn * 100 + i), "c")) for i in range(HUBS[min(turn, ROUNDS - 1)])]
        hubs = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_distinct(F.array(*hub)).alias("hubs")).where("lo < hi")
        hubs = stash(hubs.select("key", F.explode("hubs").alias("hub")), "hubs")
        stored.append(hubs)
        if turn and not hubs.head(1):  # no list has classes of two components
            break
        if turn < ROUNDS:
            pairs = now.join(fresh(hubs), "key").where((F.col("comp") != F.col("hub.comp")) & linkable("n", "hub.n", "r", "hub.r")).select(F.col("c").alias("a"), F.col("hub.c").alias("b"))
        else:
            open_ = stash(now.join(fresh(hubs.select("key").distinct()), "key"), "open")
            left = placed(open_, images)
            pairs = open_pairs(left)
            stored += [open_, left]
        pairs = pairs.distinct()
        if tried is not None:
            ordered = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            pairs = pairs.join(fresh(ordered), (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
        pairs = stash(pairs, "pairs")
        good = linked([(pairs, True), *[(short, False)] * (turn == 0)], docs, images, renamed)
        stored += [pairs, good]
        tried = pairs.union(short) if tried is None else tried.union(pairs)
        if good.head(1):
            links = good if links is None else links.union(good)
            before, labels = labels, stash(components(links), "labels")
            stored.append(before)
    discard(*stored)
    if labels is None:
        return spark.createDataFrame([], "c long, comp long")
    out = labels.select(F.col("id").alias("c"), "comp")
    return out


def linkable(n: str, m: str, r: str, q: str):
    """may_link for columns."""
    return (100 + PERCENT) * F.least(r, q) >= PERCENT * (F.col(n) + F.col(m))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, c, n_shingles) of all rows, c the name of their set's class; and (c, comp), components of classes by links."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    own, counts = surveyed(docs)
    renamed = names_of(own.where("n_shingles > 0"), "c1", "c2")
    own = own.select("doc_id", "h", named(renamed, "c1", "c2").alias("c"), "n_shingles")
    return own, link_classes(docs, own, counts, renamed)


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs.

    Two documents link when 100 * intersection >= 75 * union of their sets; component_id is the
    smallest doc_id reachable by links, itself included.  A null or blank text has an empty set
    and links with nothing.  Rows that repeat an id are one document: they share a component,
    to which the links of all their texts lead; n_shingles is each row's own.  Rows without an
    id take part and get their component's smallest id, null if there is none.  Texts of any
    length are taken whole, an empty table gives no rows, other columns are left out.
    """
    own, labels = classes(docs)
    reps = own.where("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("rep"))
    tagged = stash(reps.join(fresh(labels), "c", "left").withColumn("comp", F.coalesce("comp", "c")), "reps")
    repeated = bool(own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1))
    if repeated:
        spread = stash(own.where("doc_id IS NOT NULL AND n_shingles > 0").join(tagged.select("c", "comp"), "c").select("doc_id", "comp").distinct(), "spread")
        several = spread.groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("last")).where("a < last").select("doc_id", "a")
        joined = components(spread.join(fresh(several), "doc_id").select("a", F.col("comp").alias("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("whole"))
        tagged = tagged.join(fresh(joined), "comp", "left").select("c", "rep", F.coalesce("whole", "comp").alias("comp"))
    least = tagged.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = stash(tagged.join(fresh(least), "comp").select(F.col("c").alias("known"), "component_id"), "known")
    out = own.join(known, (own["c"] == known["known"]) & (own["n_shingles"] > 0), "left").select("doc_id", "n_shingles", "component_id")
    if repeated:  # a blank text of an id that has others
        of = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("id_component"))
        out = out.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "id_component").alias("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of all rows whose texts are joined by links, that of the smallest doc_id stays.

    Each text of a repeated id counts on its own (of rows alike in id and component, that of
    the least hash of its text stays); rows alike in id and text are one.  A null or blank text
    links with nothing and stays.  Rows without an id come after all others.  Columns and their
    names are as in docs.  Only rows that a filter of those to go may hold are dealt out.
    """
    own, labels = classes(docs)
    rows = stash(own.where("n_shingles > 0").join(fresh(labels), "c", "left").select(F.coalesce("comp", "c").alias("comp"), F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h").alias("row")), "rows")
    groups = rows.groupBy("comp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", "first")
    gone = rows.join(fresh(groups), "comp").where("row <> first").select("row.doc_id", "row.h", F.lit(False).alias("once"))
    twice = own.where("n_shingles > 0 OR doc_id IS NOT NULL").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "h", F.lit(True).alias("once"))
    marked = gone.union(twice).groupBy("doc_id", "h").agg(F.min("once").alias("once"))
    marked = stash(marked.select(F.xxhash64("doc_id", "h").alias("key"), F.col("doc_id").alias("marked_id"), "once"), "marked")
    n = marked.count()
    if not n:
        return docs
    # Names of our own that no input column has.
    key, hit, once, id_ = (next(f"{x}{i}" for i in range(len(docs.columns) + 1) if f"{x}{i}" not in docs.columns) for x in ("key", "hit", "once", "marked_id"))
    marked = marked.toDF(key, id_, once)
    here = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), text_hash()))
    here = here.withColumn(hit, maybe_held(key_filter(marked.select(key), n), F.col(key)))
    dealt = here.where(F.col(hit))
    both = dealt.join(marked.hint("merge"), (dealt[key] == marked[key]) & dealt["doc_id"].cast("long").eqNullSafe(marked[id_]), "left").select(*[dealt[c] for c in docs.columns], dealt[key].alias(key), once)
    kept = here.where(~F.col(hit)).select(*docs.columns).union(both.where(F.col(once).isNull()).select(*docs.columns))
    return kept.union(both.where(F.col(once)).dropDuplicates([key, "doc_id"]).select(*docs.columns))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents. See join_documents for odd rows."""
    return join_documents(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= 75 * (len(sa.s) + len(sb.s) - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, way.b FROM reach JOIN way ON way.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(s.s) AS n_shingles, least.component_id FROM s JOIN least ON least.id = s.doc_id
"""
