"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, embeddings, fingerprints, jaccard, language, lines, packing, shards, toxicity, warc

QUERIES = {
    "op1_language": language.op1_language,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_sharding": shards.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_embeddings": embeddings.op10_embeddings,
}

SQL = {
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op10_embeddings": embeddings.OP10_SQL,
}
