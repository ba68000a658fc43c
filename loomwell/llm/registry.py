"""The operators' queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, class_ngrams, collocations, decontamination, language_id, line_dedup, media_sequences, mixing, ngram_join, quality, toxicity, vector_codes
from .common import narrow_batches, table

_QUERIES = {
    "op1_media_sequences": lambda spark, d: media_sequences.query(table(spark, d, "documents")),
    "op2_byte_bpe": lambda spark, d: byte_bpe.query(table(spark, d, "documents")),
    "op3_ngram_join": lambda spark, d: ngram_join.query(table(spark, d, "documents")),
    "op4_chat_format": lambda spark, d: chat_format.query(table(spark, d, "conversations")),
    "op5_quality": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_benchmark_decontamination": lambda spark, d: decontamination.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_class_ngrams": lambda spark, d: class_ngrams.query(table(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language_id.query(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
    "op11_source_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op12_collocations": lambda spark, d: collocations.query(table(spark, d, "documents")),
    "op13_vector_codes": lambda spark, d: vector_codes.query(table(spark, d, "embeddings")),
}


def _narrow(query):
    def run(spark, sf_dir):
        narrow_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _narrow(query) for name, query in _QUERIES.items()}

ORACLE_SQL = {
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op6_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_source_mixing": mixing.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
