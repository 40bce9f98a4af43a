"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, fresh, held, key_filter, maybe_held, small_batches, stash, table, tidied

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line):
    """The key of a line: stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, h, drop): the sorted positions of the lines that each text loses; h is its 64-bit hash.

    Rows that repeat a doc_id are one document, but each text of it has positions of its own.
    Only hashes of lines are dealt out (two 64-bit hashes: one key of 128 bits); the
    counts are partly aggregated first, and the join on them may be split by AQE.
    """
    lines = docs.select("doc_id", text_hash().alias("h"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "h", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    per_key = lines.groupBy("h1", "h2")
    if min_docs == 2:
        shared = per_key.agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    else:
        each = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        shared = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.sum("one").alias("n")).where(F.col("n") >= min_docs)
    lost = lines.join(fresh(shared.select("h1", "h2", "first_id")), ["h1", "h2"]).where("doc_id > first_id")
    return lost.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(text: str | None, drop: list[int] | None) -> tuple[int, str]:
    """The number of lines of text, and the text of those whose positions are not in drop."""
    lines = (text or "").split("\n")
    if not drop:
        return len(lines), text or ""
    gone = set(drop)
    return len(lines), "\n".join(x for i, x in enumerate(lines) if i not in gone)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of docs with n_lines, n_dropped and kept_text.

    Keys of at least min_chars code points found in at least min_docs documents lose all
    their lines except in the smallest doc_id holding it (all of them there, if it repeats
    the line); the other lines stay in order.  Null or empty text is one empty line.  Rows
    that repeat a doc_id count as one document; each loses only lines of its own text.  Rows
    with a null doc_id lose nothing and count for nobody.  Long texts are handled whole.  An
    empty table gives no rows.  Result columns replace input columns of the same name; all
    other columns are kept, whatever their names.

    Only texts that a filter of the losing ones may hold are dealt out to meet their positions,
    by the same join whatever the size.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    drop = stash(dropped_lines(docs, min_chars, min_docs), "drops", "zstd")
    # Names of our own that no input column has.
    id_, h, gone = (next(f"{n}{i}" for i in range(len(docs.columns) + 1) if f"{n}{i}" not in docs.columns) for n in ("drop_id", "drop_h", "drop"))
    here = docs.withColumn(h, F.xxhash64("doc_id", text_hash()))
    losing = drop.select(F.col("doc_id").alias(id_), F.xxhash64("doc_id", "h").alias(h), F.col("drop").alias(gone))
    n = losing.count()
    bits = key_filter(losing.select(h), n) if n else None
    names, at = list(docs.columns), docs.columns.index("text")
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")

    def results(cols: list, texts: list, drops: list) -> pa.RecordBatch:
        done = [without(t, d) for t, d in zip(texts, drops, strict=True)]
        own = [pa.array([n for n, _ in done], pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64()), pa.array([t for _, t in done], pa.string())]
        return pa.RecordBatch.from_arrays([*cols, *own], names=[*names, "n_lines", "n_dropped", "kept_text"])

    @tidied
    def whole(batches):
        """Texts that lose nothing; the last column is the key."""
        for b in batches:
            if bits is not None:
                b = b.filter(pa.array(~held(bits, b.column(b.num_columns - 1).to_numpy())))
            texts = b.column(at).to_pylist()
            yield results(b.columns[:-1], texts, [None] * len(texts))

    @tidied
    def cut(batches):
        """Texts that may lose lines; the last column has the positions."""
        for b in batches:
            yield results(b.columns[:-1], b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())

    kept = here.mapInArrow(whole, schema)
    if not n:
        return kept
    dealt = here.where(maybe_held(bits, F.col(h)))
    both = dealt.join(losing.hint("merge"), (dealt[h] == losing[h]) & (F.col("doc_id") == F.col(id_)), "left").select(*[dealt[c] for c in names], gone)
    return kept.union(both.mapInArrow(cut, schema))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of documents: doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id > s.first_id AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
