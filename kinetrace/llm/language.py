"""Language ID: error-correcting output codes over byte n-grams, loss-weighted decoding."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import excerpt, held_out, small_batches, table, tidied

ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: The training sample: about so many documents of each language; of longer ones than so many code points an excerpt; the most languages, those of most documents.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LANGS = 400, 20_000, 200
#: A document is ambiguous if the losses of the two nearest codewords differ by less than this share of all weights.
AMBIGUOUS = 0.02
CHUNK = 1 << 18
UNKNOWN = "und"
#: ASCII letters to lower case, all else in ASCII to a blank; other bytes stay.
LETTERS = bytes(i | 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def normal(text: str) -> bytes:
    """The letters of a text, words one blank apart."""
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(LETTERS).split()) + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(data: np.ndarray):
    """The hash bucket of the n-gram that starts at each byte, for each order."""
    key = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        key = key[: len(data) - n + 1] * np.uint32(16777619) + (data[n - 1 :].astype(np.uint32) + np.uint32(n))
        if n in ORDERS:
            mixed = key ^ (key >> np.uint32(15))
            mixed = mixed * np.uint32(2246822519)
            yield (mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def codewords(k: int) -> np.ndarray:
    """One row of bits for each of k classes.

    Up to 7 classes: all distinct splits in two (the exhaustive code).  More: 8 bits for each
    doubling of k, drawn from a fixed seed; the draw of the largest least distance of 50.
    """
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        return np.array([(1, *rest) for rest in product((0, 1), repeat=k - 1) if not all(rest)], np.int8).T
    bits, rng, best = 8 * k.bit_length(), np.random.default_rng(0), (-1, None)
    for _ in range(50):
        code = rng.integers(0, 2, (k, bits), np.int8)
        distance = (code[:, None] != code[None]).sum(2) + bits * np.eye(k, dtype=int)
        useful = (code.min(0) != code.max(0)).all()
        if useful and distance.min() > best[0]:
            best = distance.min(), code
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, 0 or 1
    weights: np.ndarray  # buckets x bits: the log odds that a gram gives for each bit
    scale: np.ndarray  # bits: slope and offset that turn a mean log odds into a margin
    shift: np.ndarray
    trust: np.ndarray  # bits: the weights of their losses

    def means(self, docs: list[bytes]) -> np.ndarray:
        """The mean log odds of each document's grams, for each bit."""
        total, count = np.zeros((len(docs), self.code.shape[1])), np.zeros(len(docs))
        for i, doc in enumerate(docs):
            data = np.frombuffer(doc, np.uint8)
            for at in range(0, len(data), CHUNK):
                for g in grams(data[at : at + CHUNK + max(ORDERS) - 1]):
                    total[i] += self.weights[g].sum(0)
                    count[i] += len(g)
        return total / np.maximum(count, 1)[:, None]

    def losses(self, docs: list[bytes]) -> np.ndarray:
        """The weighted logistic loss of each language's codeword, as a share of all weights."""
        margin = self.means(docs) * self.scale + self.shift
        sign = 2 * self.code.astype(float) - 1
        each = np.logaddexp(0, -margin[:, None, :] * sign[None])
        return (each * self.trust).sum(2) / self.trust.sum()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether it is ambiguous, of each text."""
        good = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        lang, score, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if good:
            loss = self.losses([normal(texts[i]) for i in good])
            near = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
            near /= near.sum(1, keepdims=True)
            order = np.sort(loss, 1)
            gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(good), np.inf)
            for j, i in enumerate(good):
                best = int(loss[j].argmin())
                lang[i], score[i], unclear[i] = self.langs[best], float(near[j, best]), bool(gap[j] < AMBIGUOUS)
        return lang, score, unclear


def fit(rows: list[tuple[str, str]]) -> Model:
    """Learn from (text, language): one naive Bayes classifier of n-grams for each bit, then its slope.

    Every language weighs the same in a bit, whatever its number of documents.  The slopes are
    fitted on every third row, on which the classifiers of the first fit were not trained.
    """
    rows = [(normal(t), lang) for t, lang in rows if has_letter(t)]
    langs = sorted({lang for _, lang in rows})
    code = codewords(len(langs))
    bits = code.shape[1] if langs else 1
    if len(langs) < 2:
        return Model(langs, code.reshape(len(langs), bits), np.zeros((BUCKETS, bits), np.float32), np.ones(bits), np.zeros(bits), np.ones(bits))
    label = np.array([langs.index(lang) for _, lang in rows])

    def weights(own: list[int]) -> np.ndarray:
        counts = np.full((len(langs), BUCKETS), 0.05)
        for i in own:
            for g in grams(np.frombuffer(rows[i][0], np.uint8)):
                counts[label[i]] += np.bincount(g, minlength=BUCKETS)
        share = counts / counts.sum(1, keepdims=True)
        one = np.array([np.log(share[code[:, b] == 1].mean(0)) - np.log(share[code[:, b] == 0].mean(0)) for b in range(bits)])
        return one.T.astype(np.float32)

    everyone = list(range(len(rows)))
    apart = [i for i in everyone if i % 3 == 0] if len(rows) >= 6 * len(langs) else everyone
    trial = Model(langs, code, weights([i for i in everyone if i % 3] or everyone), np.ones(bits), np.zeros(bits), np.ones(bits))
    mean = trial.means([rows[i][0] for i in apart])
    scale, shift, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        y = code[label[apart], b].astype(float)
        scale[b], shift[b] = logistic(mean[:, b], y)
        right = ((mean[:, b] * scale[b] + shift[b] > 0) == (y > 0.5)).mean()
        trust[b] = max(0.05, 2 * right - 1)
    return Model(langs, code, weights(everyone), scale, shift, trust)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic regression in one variable (Newton's method, slightly penalised)."""
    spread = x.std() or 1.0
    z, w = np.c_[x / spread, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w[0] / spread, w[1]


def sample(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """About per_lang (text, lang) for each language, from rows that are not held out: those of the least hashes of doc_id."""
    own = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("doc_id").isNotNull())
    counts = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGS).collect()}
    if not counts:
        return []
    part = 1 << 30
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(part, part * per_lang // n))) for lang, n in sorted(counts.items())], F.lit(0))
    rows = own.where((F.pmod(F.xxhash64("doc_id"), F.lit(part)) < limit) & F.col("text").isNotNull())
    return sorted((r.text, r.lang) for r in rows.select(excerpt("text", TRAIN_CHARS).alias("text"), "lang").collect())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with lang_pred, score and ambiguous, which replace columns of these names; all other columns are kept.

    Only the text is looked at, so that repeated rows and equal texts get equal results.  A text
    that is null or has no letter is ``und`` with score 0.  Of equal losses the first language
    in alphabetical order wins, and the text is ambiguous.  Long texts are judged whole.  An
    empty table gives no rows; without any training rows all is ``und``.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names, at = list(docs.columns), docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    @tidied
    def run(batches):
        for b in batches:
            lang, score, unclear = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())], names=[*names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of all documents, a row for each; learned from rows that aren't held out. See identify for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs.select("doc_id", "text", "lang")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
