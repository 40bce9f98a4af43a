"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

#: Words in a shingle; the share of all hashes that a sketch retains is 1 / KEEP_ONE_IN.
WORDS, KEEP_ONE_IN = 5, 4
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, as the variable of a higher-order function."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, words: int = WORDS, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """The sorted distinct 32-bit shingle hashes of text below a fixed fraction of the hash range.

    With fewer words than a shingle has, the whole sequence is the one shingle.  The smallest
    hash of a text that has words is retained in any case, so that no such sketch is empty.
    merge makes the sketch of two texts' shingles together.  A hash that unrelated shingles share
    counts as common: one in 2**32 pairs of them.
    """
    limit = -(1 << 31) + (1 << 32) // keep_one_in
    hashes = F.transform(F.filter(F.split(F.lower(text), SPLIT, -1), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.when(n > 0, F.array(F.hash(h))).otherwise(F.array().cast("array<int>"))
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.hash(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n < words, whole).otherwise(each)

    def retained(s: Column) -> Column:
        below = F.filter(s, lambda x: x < limit)
        return F.when(F.size(s) == 0, s).when(F.exists(s, lambda x: x < limit), F.array_sort(F.array_distinct(below))).otherwise(F.array(F.array_min(s)))

    return let(let(hashes, shingles), retained)


def merge(a: Column, b: Column, keep_one_in: int = KEEP_ONE_IN) -> Column:
    """The sketch of all shingles that either sketch stands for; null with a null one."""
    limit = -(1 << 31) + (1 << 32) // keep_one_in

    def retained(s: Column) -> Column:
        below = F.filter(s, lambda x: x < limit)
        return F.when(F.size(s) == 0, s).when(F.size(below) > 0, below).otherwise(F.array(F.array_min(s)))

    return let(F.array_sort(F.array_union(a, b)), retained)


def likeness(a: Column, b: Column) -> Column:
    """The share of two sketches' hashes that both have; 1 if both are empty."""
    common, both = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(common / (both - common))


def containment(a: Column, b: Column) -> Column:
    """The share of the hashes of sketch a that b has too: how much of a text lies in another, of whatever length."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def written(sketch_: Column) -> Column:
    """A sketch as text: 8 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(sketch_, lambda x: F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0")), "")


def following(ids: DataFrame) -> DataFrame:
    """ids (doc_id, k, n, copies) with next_id, next_k: the next in descending order, after the last the first.

    Ids are dealt into ranges, ordered inside each, and the ends of ranges are joined
    through a table of one row for each range.
    """
    spark = ids.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = stash(ids.repartitionByRange(parts, "doc_id", "k").withColumn("part", F.spark_partition_id()), "ids")
    order = [F.col("doc_id").desc_nulls_last(), F.col("k").desc()]
    top = F.max(F.struct("doc_id", "k"))
    tops = ids.groupBy("part").agg(top.alias("top"), F.lit(1).alias("one"))
    lower = Window.partitionBy("one").orderBy(F.desc("part"))
    whole = Window.partitionBy("one")
    tops = tops.withColumn("below", F.coalesce(F.lead("top").over(lower), F.max_by("top", "part").over(whole))).select("part", "below")
    w = Window.partitionBy("part").orderBy(*order)
    nxt = F.lead(F.struct("doc_id", "k")).over(w)
    return ids.withColumn("nxt", nxt).join(tops, "part").withColumn("nxt", F.coalesce("nxt", "below")).select("doc_id", "k", "n", "copies", F.col("nxt.doc_id").alias("next_id"), F.col("nxt.k").alias("next_k"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in descending doc_id, after the last the first.
    A null text counts as empty.  Rows that repeat both id and text count as one document and
    give that document's row each; different texts under one id are ordered by a hash of the
    text.  A null id comes last.  Texts of any length are taken whole, columns other than doc_id and
    text are left out, an empty table gives no rows.  Only DataFrame functions are used.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    ids = d.select("doc_id", "k", F.length("text").cast("long").alias("n")).groupBy("doc_id", "k", "n").agg(F.count(F.lit(1)).alias("copies"))
    ids = stash(following(ids), "following")
    repeated = bool(ids.where("copies > 1").head(1))
    # How much of each document the one before it takes.
    takers = ids.select(F.col("next_id").alias("doc_id"), F.col("next_k").alias("k"), F.col("doc_id").alias("to_id"), F.col("k").alias("to_k"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    same = lambda a, b, x, y: a["doc_id"].eqNullSafe(b[x]) & (a["k"] == b[y])
    one = d.dropDuplicates(["doc_id", "k"]) if repeated else d  # seldom so: it deals all texts anew
    heads = one.join(takers.withColumnsRenamed({"doc_id": "by_id", "k": "by_k"}), same(one, {"by_id": F.col("by_id"), "by_k": F.col("by_k")}, "by_id", "by_k"))
    heads = heads.select("to_id", "to_k", F.expr("substring(text, 1, need)").alias("head"))
    n = F.length("text")
    t = d.join(heads, d["doc_id"].eqNullSafe(F.col("to_id")) & (d["k"] == F.col("to_k")))
    t = t.select("doc_id", "k", "text", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), "head").alias("edited"))
    t = t.select("doc_id", "k", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("s"), sketch(F.col("edited")).alias("e"))
    t = stash(t, "sketches")
    own = (t.dropDuplicates(["doc_id", "k"]) if repeated else t).select(F.col("doc_id").alias("next_id"), F.col("k").alias("next_k"), F.col("s").alias("next_s"))
    links = ids.select(F.col("doc_id").alias("d"), F.col("k").alias("dk"), "next_id", "next_k")
    nxt = links.join(own, links["next_id"].eqNullSafe(own["next_id"]) & (links["next_k"] == own["next_k"])).select("d", "dk", "next_s")
    out = t.join(nxt, t["doc_id"].eqNullSafe(nxt["d"]) & (t["k"] == nxt["dk"]))
    return out.select("doc_id", "n_chars", "edited_sha256", written(F.col("s")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. See fingerprint_documents for odd rows."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
