"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from acrelens.llm import ann, audit, bpe, chat, dac, exact_dedup, packing, simhash, spelling, spm, substring, toxicity, url_trust
from acrelens.scratch import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_url_trust(spark, sf_dir):
    return url_trust.judge_pages(_table(spark, sf_dir, "pages"))


def op3_packing(spark, sf_dir):
    return packing.digest(packing.pack_documents(_table(spark, sf_dir, "documents"), WORDS))


def op4_prefix_forest(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op5_repeated_passages(spark, sf_dir):
    return substring.digest(_table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    path = scratch_path(spark, "token_files")
    dac.write(_table(spark, sf_dir, "documents"), path, WORDS)
    return dac.read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_pieces(spark, sf_dir):
    return spm.digest(_table(spark, sf_dir, "documents"), PIECES)


def op10_perspectives(spark, sf_dir):
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark, sf_dir):
    return bpe.digest(_table(spark, sf_dir, "documents"), BYTES)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_trust": op2_url_trust,
    "op3_packing": op3_packing,
    "op4_prefix_forest": op4_prefix_forest,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pieces": op9_pieces,
    "op10_perspectives": op10_perspectives,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op2_url_trust": url_trust.oracle_sql(),
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_perspectives": chat.ORACLE_SQL,
    "op11_spelling_variants": spelling.ORACLE_SQL,
    "op12_filter_audit": audit.ORACLE_SQL,
}
