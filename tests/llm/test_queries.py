import importlib
import os
import subprocess
import sys
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docloom.llm import queries
from tests.llm.helpers import PROSE, awkward

COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_quality_gam": {"doc_id", "held_out", "score", "predicted"},
    "op9_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op13_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op10_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


#: Queries whose rows aren't documents: phrases, and pieces of documents.
OTHER = {"op11_phrases", "op12_packing"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OTHER))
def test_every_row_gets_a_result(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.collect()
    assert len(rows) == n and COLUMNS.get(name, {"doc_id"}) <= set(got.columns)
    if "held_out" in got.columns:
        mod, rest = (5, 0) if name.startswith("op8") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
    if "score" in got.columns:
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        seen[name], at = out.collect(), spark.createDataFrame(out.collect(), docs.schema)
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert set(ids["quality"]) >= set(ids["exact_dedup"]) >= set(ids["near_dedup"]) >= set(ids["mix"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    gone = set(text) - set(ids["quality"])
    assert sum(labels.get(i) == 1 for i in gone) <= 1 and all(labels.get(i) != 0 for i in ids["near_dedup"][:50])
    best = {}
    for i in ids["quality"]:
        best[text[i]] = max(i, best.get(text[i], -1))
    assert sorted(ids["exact_dedup"]) == sorted(best.values())
    assert max(ids["mix"].count(i) for i in set(ids["mix"])) <= 2
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(ids["mix"]) and all(r.round_trip and r.n_tokens == len(r.ids) for r in final)


def test_pipeline_stages_take_awkward_documents(spark, sf):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0, name
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name


def test_the_rest_works_without_these_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name not in (".git", "corpus_pipeline.py", "tests") and not name.startswith("."):
            subprocess.run(["cp", "-r", os.path.join(root, name), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "docloom" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert importlib.util.find_spec("docloom.llm") and PROSE
