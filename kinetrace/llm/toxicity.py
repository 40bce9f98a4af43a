"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Both classes share a large dictionary that zstandard trains on ordinary text, and each has
one of its own behind it, trained on the windows of its texts that the common one compresses
badly.  The gain of a window is the number of bytes by which it is shorter with the toxic
dictionary than with the ordinary one; it is measured where the toxic one holds a run of the
window that the ordinary one lacks, and 0 elsewhere.  What toxic texts have in common is found by
compression too: their documents are parted in two, and of either part those windows train
the toxic dictionary that the dictionaries of the other part find toxic, by a gain that
hardly an ordinary window exceeds.

Documents that no dictionary was trained on give the thresholds: how much evidence each gain
is, and from which sum of evidence over all windows a document counts as toxic.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import excerpt, held_out, small_batches, table, tidied
from .language import logistic, normal

#: Bytes of a window, and from one to the next.
WINDOW, STEP = 24, 12
#: Goes after every window: its match makes each block worth compressing, so that no gain is a step to or from a stored block.
PAD = bytes(48)
#: The training sample: about so many documents of either label; of longer ones than so many code points an excerpt.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_CHARS = 1600, 6000, 20_000
#: The common dictionary, its training windows and the length of its segments. With one of its own behind it, it has to fit into a search table of 2**20 places.
BASE_BYTES, BASE_WINDOW, BASE_SEGMENT = (1 << 20) - (1 << 17) - (1 << 16), 120, 400
#: The dictionaries of a class: bytes in a trial, of the ordinary one in the end and, at least and at most, of the toxic one; segments and the runs they are chosen by.
TRIAL_BYTES, CALM_BYTES, OWN_BYTES, SEGMENT, RUN = 1 << 18, 1 << 17, (1 << 13, 1 << 16), 16, 6
#: The least match that the compressor looks for.
MATCH = 5
#: Of ordinary windows, this share is easy for the common dictionary, and that share gains less than a toxic one must.
EASY, CALM = 0.95, 0.9998
#: Gains are told apart from and up to these values.
LOW, HIGH = -2, 10
#: Such a share of the ordinary documents that calibrate lies above the threshold, at most.
FALSE_ALARMS = 0.003
CUT = 0.7


#: Bits of the table that rules out most runs at once.
TABLE_BITS = 22


def windows(doc: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Overlapping windows of a normalised text; the last takes what is left."""
    return [doc[i : i + size] for i in range(0, max(1, len(doc) - (size - step)), step)]


@lru_cache(2)
def packer(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(compression_level=3, min_match=MATCH, strategy=zstandard.STRATEGY_BTLAZY2, window_log=21, hash_log=19, chain_log=21, search_log=5, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def lengths(content: bytes, own: list[bytes]) -> np.ndarray:
    """The compressed length of each window with a dictionary."""
    pack = packer(content).compress
    return np.fromiter((len(pack(w + PAD)) for w in own), np.int64, len(own))


def trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary that zstandard trains; of too little text, that text."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=RUN).as_bytes()
    except zstandard.ZstdError:
        return b"\xff".join(samples)[-size:]


def runs(text: bytes) -> np.ndarray:
    """The RUN bytes from each place on, as a number."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(data) - RUN + 1)
    key = np.zeros(n, np.uint64)
    for i in range(RUN):
        key = (key << np.uint64(8)) | data[i : i + n]
    return key


def places(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@lru_cache(1)
def marks(keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted runs, and a table of their places."""
    own, table_ = np.frombuffer(keys, np.uint64), np.zeros(1 << TABLE_BITS, bool)
    table_[places(own)] = True
    return own, table_


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    only_toxic: bytes  # the runs that the toxic dictionary holds and the ordinary one doesn't, sorted
    evidence: np.ndarray  # of each gain from LOW to HIGH
    threshold: float  # the sum of evidence from which a document is toxic
    slope: float  # of the score in that sum

    @classmethod
    def of(cls, ordinary: bytes, toxic: bytes) -> Model:
        return cls(ordinary, toxic, np.setdiff1d(runs(toxic), runs(ordinary)).tobytes(), np.zeros(HIGH - LOW + 1), 0.0, 1.0)

    def gains(self, doc: bytes) -> np.ndarray:
        """Of each distinct window."""
        at: dict[bytes, int] = {}
        for i, w in enumerate(windows(doc)):
            at.setdefault(w, i)
        start = np.fromiter(at.values(), np.int64, len(at)) * STEP
        own, table_ = marks(self.only_toxic)
        key = runs(doc)
        hit = table_[places(key)]
        if hit.any():
            maybe = np.flatnonzero(hit)
            hit[maybe] = own[np.minimum(np.searchsorted(own, key[maybe]), len(own) - 1)] == key[maybe]
        count = np.concatenate([[0], np.cumsum(hit)])
        last = len(count) - 1
        look = np.flatnonzero(count[np.minimum(start + WINDOW - RUN + 1, last)] > count[np.minimum(start, last)])
        out = np.zeros(len(at), np.int64)
        if len(look):
            found = list(at)
            found = [found[i] for i in look.tolist()]
            out[look] = lengths(self.ordinary, found) - lengths(self.toxic, found)
        return out

    def sum(self, doc: bytes) -> float:
        return float(self.evidence[np.clip(self.gains(doc), LOW, HIGH) - LOW].sum())

    def score(self, text: str | None) -> float:
        """CUT where the sum of evidence is the threshold."""
        above = self.slope * (self.sum(normal(text or "")) - self.threshold)
        return float(1 / (1 + np.exp(-np.clip(np.log(CUT / (1 - CUT)) + above + 1e-9, -30, 30))))


def apart(docs: list[bytes]) -> list[bytes]:
    """The documents that share neither the least nor the largest hash of their three-word runs with an earlier one: few near copies stay."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in docs:
        w = t.split()
        h = [zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))]
        keys = {(0, min(h)), (1, max(h))}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic one: each the common dictionary and that of the class."""
    base = trained(BASE_BYTES, [w for t in ordinary[::2] for w in windows(t, BASE_WINDOW, BASE_WINDOW)], BASE_SEGMENT) + b"\xff"
    rest = ordinary[1::2] or ordinary
    own = {(y, k): [w for t in docs[k::2] for w in windows(t)] for y, docs in ((1, toxic), (0, rest)) for k in (0, 1)}
    packed = {i: lengths(base, w) for i, w in own.items()}
    hard_from = np.quantile(np.concatenate([packed[0, 0], packed[0, 1]]), EASY)
    hard = {i: [w for w, n in zip(own[i], packed[i], strict=True) if n >= hard_from] for i in own}
    found = []
    for k in (0, 1):
        trial = [base + trained(TRIAL_BYTES, hard[y, k], SEGMENT) for y in (0, 1)]
        calm, gain = (lengths(trial[0], hard[y, 1 - k]) - lengths(trial[1], hard[y, 1 - k]) for y in (0, 1))
        most = np.sort(calm)[::-1]  # easy windows count as calm
        at = int((1 - CALM) * len(own[0, 1 - k]))
        least = max(2, int(most[at]) + 1 if at < len(most) else 2)
        found += [w for w, g in zip(hard[1, 1 - k], gain, strict=True) if g >= least]
    size = int(np.clip(sum(map(len, found)) // 8, *OWN_BYTES))
    return base + trained(CALM_BYTES, hard[0, 0] + hard[0, 1], SEGMENT), base + trained(size, found, SEGMENT)


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """Learn from (text, label): dictionaries from three quarters of the toxic and two thirds of the ordinary documents, thresholds from the others. None without both labels."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "replace")), r[0]))  # not by text: like ones would alternate
    toxic, ordinary = (apart([normal(t) for t, y in rows if y == want]) for want in (1, 0))
    if not toxic or not ordinary:
        return None
    part = lambda docs, k, n: ([t for i, t in enumerate(docs) if i % n < k], [t for i, t in enumerate(docs) if i % n >= k] or docs)
    (learn, judge), (learn_calm, judge_calm) = part(toxic, 3, 4), part(ordinary, 2, 3)
    model = Model.of(*dictionaries(learn, learn_calm))
    counts = [[np.bincount(np.clip(model.gains(t), LOW, HIGH) - LOW, minlength=HIGH - LOW + 1) for t in docs] for docs in (judge_calm, judge)]
    calm, marked = (sum(c) + 0.5 for c in counts)
    model.evidence = np.log((marked / marked.sum()) / (calm / calm.sum()))
    sums = [np.array(c) @ model.evidence for c in counts]
    slope, _ = logistic(np.clip(np.concatenate(sums), -60, 60), np.repeat([0.0, 1.0], [len(s) for s in sums]))
    model.slope = max(slope, 1e-3)
    calm = np.sort(sums[0])[::-1]
    # At the least the sum that makes a document toxic with probability CUT, labels being as frequent as in the sample.
    model.threshold = max(float(calm[int(FALSE_ALARMS * len(calm))]) + 1e-6, float(np.log(CUT / (1 - CUT) * len(ordinary) / len(toxic))))
    return model


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """About TRAIN_TOXIC and TRAIN_ORDINARY (text, label) of rows that are not held out: those of the least hashes of doc_id.

    Of contrary labels of one document the larger counts.
    """
    own = labels.where(~held_out("doc_id", 3, 1) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part, most = 1 << 30, {1: TRAIN_TOXIC, 0: TRAIN_ORDINARY}
    limit = F.coalesce(*[F.when(F.col("toxic") == y, F.lit(min(part, part * most[y] // n))) for y, n in counts.items()], F.lit(0))
    picked = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < limit)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", excerpt("text", TRAIN_CHARS).alias("text")).join(F.broadcast(picked), "doc_id")  # about 4800 ids
    return sorted((r.text, r.toxic) for r in rows.select("text", "toxic").collect())


def rate(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of docs with score and predicted, which replace columns of these names; all other columns are kept.

    Only the text is looked at, so that repeated rows and equal texts score alike; a null text
    counts as empty, and an empty one is a window without gain.  Long texts are scored whole.
    A score of CUT or more is predicted toxic.  Without a model (no labels, or of one kind
    only) all scores are 0.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names, at = list(docs.columns), docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    @tidied
    def run(batches):
        for b in batches:
            score = [model.score(t) if model else 0.0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array([int(s >= CUT) for s in score], pa.int32())], names=[*names, "score", "predicted"])
        packer.cache_clear()  # the worker may serve other stages next
        marks.cache_clear()

    return docs.mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, a row for each; learned from rows that aren't held out. See rate for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(sample(docs, table(spark, sf_dir, "labels")))
    return rate(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
