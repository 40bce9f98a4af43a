"""Packing: power-of-two decomposition, equal lengths in one bucket, no sequence across documents."""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Bpe, tokenizer_path
from .common import small_batches, stash, table, tidied

MAX_TOKENS, END_ID = 2048, 1
#: The offsets of buckets are broadcast up to so many rows (24 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Chunks longer than this aren't kept; about twice so many chunks are held.
KEEP_BYTES, KEEP_CHUNKS = 64, 800_000
#: The split pattern of the word tokenizer, for text without white space.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: Marks that end a word without being part of it.
MARKS = b"!\"#$%&*+,-./:;=?@^_`|~"
#: Chunks that Unicode normalisation leaves alone and that are lower-cased letter by letter.
PLAIN = regex.compile(r"[!-~\u00A1-\u00AC\u00AE-\u012F\u0131-\u017F]+")


class Chunks:
    """The ids of texts by the tokenizers library, with those of chunks between blanks kept.

    The word tokenizer drops white space and no word, mark or special token of it crosses
    one, so that a text's ids are those of its chunks in turn.
    """

    def __init__(self, path: str, keep: int = KEEP_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.bpe = Tokenizer.from_file(path), Bpe(path)
        self.keep = keep
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def split(self, chunk: bytes) -> tuple[bytes, ...] | None:
        """The words of a chunk that Unicode normalisation leaves alone; None for any other."""
        base = chunk.rstrip(MARKS)
        if base.isalpha():  # ASCII letters
            return (base.lower(),) if len(base) == len(chunk) else (base.lower(), chunk[len(base) :])
        t = base.decode()
        if t.isalpha() and max(t) < "\u0180" and "\u0130" not in t:
            return (t.lower().encode(),) if len(base) == len(chunk) else (t.lower().encode(), chunk[len(base) :])
        t = chunk.decode()
        if "<|" in t or not PLAIN.fullmatch(t):
            return None
        return tuple(w.encode() for w in WORD.findall(t.lower()))

    def learn(self, chunks: list[bytes]) -> None:
        """Keep the ids of new chunks: plain ones by their words' segment trees, others by the library."""
        if len(self.words) > self.keep // 2:
            self.words.clear()
        words, kept = self.words, self.kept
        cut = [*map(self.split, chunks)]
        new = list({w for ws in cut if ws for w in ws}.difference(words))
        words.update(zip(new, self.bpe.words(new), strict=True))
        odd = [c.decode() for c, ws in zip(chunks, cut, strict=True) if ws is None]
        rest = iter(self.tokenizer.encode_batch(odd, add_special_tokens=False)) if odd else iter(())
        for c, ws in zip(chunks, cut, strict=True):
            if ws is None:
                kept[c] = b"".join(i.to_bytes(4, "little") for i in next(rest).ids)
            else:
                kept[c] = words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > self.keep:
            self.older, self.kept = self.kept, {}
        kept = self.kept
        cut = [t.encode("utf-8", "replace").split() for t in texts]
        new = set().union(*cut).difference(kept)
        for c in new & self.older.keys():
            kept[c] = self.older[c]
        new = list(new.difference(kept))
        self.learn(new)
        out = [b"".join(map(kept.__getitem__, c)) for c in cut]
        for c in new:
            if len(c) > KEEP_BYTES:
                del kept[c]
        return out


@lru_cache(2)
def loaded(path: str, keep: int) -> Chunks:
    return Chunks(path, keep)


def pieces(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of the most as fit, then the powers of two of the rest."""
    out = [(s, most) for s in range(0, n - most + 1, most)]
    at = len(out) * most
    for bit in range(most.bit_length() - 1, -1, -1):
        if (n - at) >> bit:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack_documents(docs: DataFrame, path: str, most: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, keep: int = KEEP_CHUNKS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids), one row per piece.

    A document's ids end in end_id, so that a null or empty text is that one id.  Every piece
    has a power of two of ids, at most ``most``, and is a sequence of its own: no padding,
    and offset is 0.  Sequences of one length are numbered in turn, shortest first, without
    gaps.  Repeated rows are packed each.  Columns other than doc_id and text are left out, and an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number", *(["ids"] if with_ids else [])]
    types = [pa.int64()] * 7 + [pa.binary()]

    @tidied
    def run(batches):
        from pyspark import TaskContext

        chunks, task, numbers = loaded(path, keep), TaskContext.get().partitionId(), {}
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, ids in zip(b.column(0).to_pylist(), chunks.encode_batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in pieces(n, most):
                    own = ids[4 * start : 4 * (start + length)]
                    number = numbers[length] = numbers.get(length, -1) + 1
                    for c, v in zip(cols, (doc_id, start, length, zlib.crc32(own), n, task, number, own), strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)
        if keep < KEEP_CHUNKS:  # the worker may serve other stages next
            chunks.kept, chunks.older, chunks.words = {}, {}, {}

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long" + ", ids binary" * with_ids
    cut = stash(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces", "zstd" if with_ids else "snappy")
    # One row for each task and length: where the numbers of a bucket go on.
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    bucket = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(counts.withColumn("before", F.coalesce(F.sum("n").over(bucket), F.lit(0))), "buckets")
    first, total = F.lit(0), 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect():  # one row for each power of two
        first, total = F.when(F.col("length") >= r.length, F.lit(total)).otherwise(first), total + r.n
    starts = counts.select("length", "task", (F.col("before") + first).alias("first"))
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    done = cut.join(starts, ["length", "task"])
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("number")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents. See pack_documents for odd rows."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
