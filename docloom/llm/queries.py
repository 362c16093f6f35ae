"""The queries over whole tables that apply the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import alignment, bpe, exact_dedup, langid, mixing, packing, phrases, quality_gam, quality_rules, sharding, simhash, toxicity, wordpiece
from docloom.llm._common import documents, held_out


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, learn=~held_out(F.col("doc_id"), 3, 1))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = toxicity.train(docs, labels(spark, sf_dir), learn=~held_out(F.col("doc_id"), 3, 1))
    found = toxicity.score(docs, lexicon, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece.load_vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(documents(spark, sf_dir), pieces, keep=["doc_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")
    return bpe.digests(tokens, "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_gam.train(docs, labels(spark, sf_dir), learn=~held_out(F.col("doc_id"), 5, 0))
    found = quality_gam.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.load(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    found = packing.pack(documents(spark, sf_dir), tokenizer, keep=["doc_id"])
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = alignment.load(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    rows, postings = alignment.groups(documents(spark, sf_dir), vocabularies, keep=["doc_id"], digest="sha256")
    return alignment.scored(rows, postings).withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_sharding, op4_token_counts, op5_mixing, op6_byte_bpe, op7_simhash, op8_quality_gam, op9_exact_dedup, op10_quality_rules, op11_phrases, op12_packing, op13_alignment)}

ORACLE_SQL = {
    "op3_sharding": sharding.ORACLE_SQL,
    "op9_exact_dedup": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, ''))::bigint as group_size,
               row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
    "op11_phrases": phrases.ORACLE_SQL,
}
