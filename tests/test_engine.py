import pytest
from pyspark.sql import functions as F

from docloom.operators.models import hashed_embedding
from docloom.plans.strategies import Engine
from docloom.sources import stores


def engine(spark, generate=None):
    texts = ["alpha router setup", "beta switch alarm", "gamma cable length", "alpha router reset"]
    catalog = spark.createDataFrame([(i, f"f{i % 3}.txt", "pdf" if i % 2 else "docx", "net" if i else "", ["g"] if i < 3 else ["h"]) for i in range(4)], "doc_id int, filename string, doc_type string, category string, acl_groups array<string>")
    chunks = spark.createDataFrame([(i, i, 0, 0, "medium", "text", t, hashed_embedding(t), ["g"] if i < 3 else ["h"]) for i, t in enumerate(texts)], "id int, doc_id int, chunk_index int, start_char int, chunk_size_tier string, content_type string, text string, vector array<double>, acl_groups array<string>")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r")], "source string, target string, relation_type string")
    return Engine(spark, catalog, chunks, hashed_embedding, edges, {"pay": spark.createDataFrame([("x", 1.0), ("y", 2.0)], "grade string, salary double")}, generate)


def test_engine(spark):
    e = engine(spark, lambda prompt: "```sql\nselect grade from pay where salary > 1\n```")
    assert [r.id for r in e.search_documents("alpha router", ["g"], k=1).collect()] == [0]
    assert 3 not in {r.id for r in e.search_documents("alpha router", ["g"]).collect()}
    assert {r.doc_type for r in e.search_documents("alpha router", ["g"], "docx").collect()} == {"docx"}
    assert [r.id for r in e.lookup_document("1", ["g"]).collect()] == [1] and e.lookup_document("f2.txt", ["g"]).count() == 1
    with pytest.raises(LookupError):
        e.lookup_document("3", ["g"])
    with pytest.raises(LookupError):
        engine(spark).lookup_document("f0.txt", ["g", "h"])
    assert e.list_documents("net", ["g"]).count() == 2 and e.list_documents("none", ["g"]).count() == 3
    assert {r.category: r.n_docs for r in e.list_sources(["g"]).collect()} == {"net": 2, "uncategorized": 1}
    assert e.query_database("who earns more", ["g"]).rows == [{"grade": "y"}] and engine(spark).query_database("x", ["g"]).verdict == "skipped"
    assert {r.node for r in e.search_graph(["a"], 1).collect()} == {"a", "b"}
    assert 0 in {r.id for r in e.ask("alpha router", ["g"]).collect()}


def test_store(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    assert store.read() is None
    store.delete(spark.range(1), "id")
    store.append(spark.range(3))
    store.append(spark.range(3, 5).withColumn("kind", F.lit("new")), {"kind": "old"})
    assert {(r.id, r.kind) for r in store.read().collect()} == {(0, "old"), (1, "old"), (2, "old"), (3, "new"), (4, "new")}
    parts = {p["name"] for p in store._parts()}
    assert len(parts) == 2  # an append writes its own rows and no more
    (tmp_path / "s" / "part-dead").mkdir()  # a write that never ended
    store.delete(spark.range(2), "id")
    assert store.versions()[-1] == "v00000003.json" and store.read().count() == 3 and store.read("v00000002.json").count() == 5
    assert len(parts & {p["name"] for p in store._parts()}) == 1  # the part without such rows stays
    store.back_up(str(tmp_path / "copy"))
    store.optimise(1)
    assert len(store.versions()) == 1 and store.read().count() == 3 and len(list((tmp_path / "s").glob("part-*"))) == 1
    assert stores.Store(spark, str(tmp_path / "copy")).read().count() == 3
    assert stores.registered("a=jdbc:x, b=jdbc:y=z") == {"a": "jdbc:x", "b": "jdbc:y=z"}
