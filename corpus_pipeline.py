"""Documents to packed training sequences: language ID, toxicity, line dedup, n-gram Jaccard join, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm import jaccard, language, lines, packing, toxicity
from kinetrace.llm.bpe import tokenizer_path
from kinetrace.llm.common import stash, table


#: Workers live on from stage to stage and share an executor's memory: less than the packing query keeps.
KEEP_CHUNKS = 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is ambiguous, go."""
    model = language.fit(language.sample(docs.select("doc_id", "text", "lang")))
    found = language.identify(docs.withColumnsRenamed({c: f"__{c}" for c in ("score", "ambiguous", "lang_pred") if c in docs.columns}), model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).drop("score", "ambiguous", "lang_pred")
    return kept.toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    model = toxicity.fit(toxicity.sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    rated = toxicity.rate(docs.withColumnsRenamed({c: f"__{c}" for c in ("score", "predicted") if c in docs.columns}), model)
    return rated.where("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that an earlier one has too; n_chars follows the text. A null text stays null."""
    done = lines.dedup_lines(docs.withColumnsRenamed({c: f"__{c}" for c in ("n_lines", "n_dropped", "kept_text") if c in docs.columns}))
    done = done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).drop("n_lines", "n_dropped", "kept_text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays; see jaccard.drop_copies."""
    return jaccard.drop_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences of a power of two of token ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True, keep=KEEP_CHUNKS)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("packing", pack),
]

#: Trained classifiers and tokenizers are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
