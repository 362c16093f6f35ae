"""A corpus pipeline of training-data operators: each stage works on what its predecessor kept, written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, exact_dedup, mixing, quality_gam, simhash
from docloom.llm._common import documents, forget, held_out, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled ones outside the fold held out.

    Null and empty texts are judged like any other, very long ones whole, repeated rows alike. Of an empty table none is kept.
    Columns with other names, and with those of the classifier's own, pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gam.train(docs, labels, learn=~held_out(F.col("doc_id"), 5, 0))
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    judged = quality_gam.score(plain, model, text=plain.columns[docs.columns.index("text")])
    return judged.filter("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    Null and empty texts are equal; null doc_ids come last; of repeated rows one stays. Texts of any length are compared
    whole. An empty table gives an empty one, and columns may have any names.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id.

    Null and empty texts are near copies of each other; null doc_ids come last; of repeated rows one stays. Texts of any
    length count whole. An empty table gives an empty one, and columns may have any names.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null and empty texts have size 0 and go by their source's whole rounds; a null source is a source. Very long texts are
    counted whole; ties are the seed's to decide. An empty table gives an empty one, and columns may have any names.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, token ids, and whether they decode to the text's bytes.

    Null and empty texts have no ids, very long ones are encoded whole, repeated rows alike. An empty table gives an empty
    one; other columns are left out.
    """
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    body = docs.select("doc_id", "source", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"))
    tokens = bpe.encode(body, ranks, public_tokenizers.PATTERN, keep=["doc_id", "source", "lang", "md5"], decoded="decoded")
    return tokens.select("doc_id", "source", "lang", F.size("ids").alias("n_tokens"), "ids", (F.md5("decoded") == F.col("md5")).alias("round_trip"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]

#: The classifier is learned, SQL can't express it: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read as the next one's docs.

    A stage's table is deleted once the next one's is written; the last stays, the result is read from it.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
