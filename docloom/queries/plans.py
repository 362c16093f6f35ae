"""Guarded statements, generated SQL, prompts, composed searches, the facade and editions over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.operators import editions as L, models as Q, tabular as K, views as W
from docloom.operators.models import hashed_embedding
from docloom.plans import sqlguard as G, strategies as S, technical as T
from docloom.queries import bind

QUESTION = "the thing and onre with"


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a model, one for each part: statements that are fine, that write, that read other tables, several, and none."""
    p, name = bind.table(spark, sf, "part"), F.col("p_name")
    said = [
        F.concat(F.lit("select * from part where p_name = '"), name, F.lit("';")), F.concat(F.lit("with x as (select '"), name, F.lit("' as n) select * from x, nation")), F.lit("drop table part"), F.lit("select 1; select 2"),
        F.concat(F.lit("select '"), name, F.lit("' from orders")), F.lit("select * from part p, nation"), F.concat(F.lit("insert into part select '"), name, F.lit("'")), F.lit("select * from read_csv('x')"),
        F.lit("select * from (select * from part) q"), F.concat(F.lit("Sure, "), name, F.lit(":\n```sql\nselect 2\n```\nor\n```\nselect 'drop' from part\n```")), F.lit("select * from parquet.`/etc`"), F.concat(F.lit("I can't "), name), F.lit("select * from other.part"),
    ]
    return p.select("p_partkey", F.element_at(F.array(*said), (F.col("p_partkey") % len(said) + 1).cast("int")).alias("text"))


def c23_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that pass the guard: one SELECT or WITH over the tables given; for other databases SELECT alone."""
    return G.examined(_statements(spark, sf), allowed=["part", "nation"]).select("p_partkey", "ours", "theirs")

def c25_references(spark: SparkSession, sf: str) -> DataFrame:
    """Tables that a statement reads, names that it defines, and documents whose tables they are."""
    got = G.examined(_statements(spark, sf), owners={"part": "d1", "nation": "d2"})
    return got.select("p_partkey", *[F.concat_ws(",", c).alias(c) for c in ("tables", "defined", "documents")])

def f2_extracted_sql(spark: SparkSession, sf: str) -> DataFrame:
    """the statement in a model's answer."""
    return G.examined(_statements(spark, sf)).select("p_partkey", "statement")

def _scripted(*answers: str) -> Callable[[str], str]:
    said = iter(answers)
    return lambda prompt: next(said)


def f6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Generated SQL, run, judged and repaired, three times at most; the trace of what was tried."""
    nation = bind.table(spark, sf, "nation")

    def engine(*answers: str) -> G.Trace:
        return S.Engine(spark, bind.catalog(spark, sf), bind.chunks(spark, sf), hashed_embedding, tables={"nation": nation}, generate=_scripted(*answers)).query_database("how many nations", ["g"])

    good, empty, bad = "select count(*) as n from nation", "select n_name from nation where n_nationkey < 0", "select * from part"
    got = {"at once": engine(good), "second": engine(empty, good), "third": engine(bad, "hm", good), "never": engine(bad, bad, bad), "empty": engine(empty, empty, empty), "no sql": engine("a", "b", "c")}
    rows = [(k, t.verdict, len(t.attempts), ",".join(a for _, a in t.attempts), t.rows[0]["n"] if t.rows else None) for k, t in got.items()]
    return spark.createDataFrame(rows, "asked string, verdict string, attempts long, states string, n long")


def f9_schema_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """tables with columns and values as far as the budget goes, then without values, then names only."""
    region, nation = bind.table(spark, sf, "region"), bind.table(spark, sf, "nation")
    values = {("region", "r_name"): G.distinct_values(region, "r_name")}
    said = [G.schema_prompt([("region", region), ("nation", nation)], values, budget) for budget in (12_000, 150, 20)]
    return spark.createDataFrame([(i, len(s.split("\n")), "AFRICA" in s, "r_name (string)" in s) for i, s in enumerate(said)], "place long, n_lines long, has_values boolean, has_columns boolean")


def f10_schema_context(spark: SparkSession, sf: str) -> DataFrame:
    """a table's columns with their meaning, and what codes stand for, as one text for each table."""
    n, r = bind.table(spark, sf, "nation"), bind.table(spark, sf, "region")
    columns = r.select(F.col("r_name").alias("table_name"), F.lit("nations").alias("description"), F.explode(F.array(F.struct(F.lit(0).alias("position"), F.lit("code").alias("column"), F.lit("int").alias("dtype"), F.lit("its number").alias("meaning")), F.struct(F.lit(1).alias("position"), F.lit("name").alias("column"), F.lit("string").alias("dtype"), F.lit("").alias("meaning")))).alias("c")).select("table_name", "description", "c.*")
    glossary = n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter("r_name != 'ASIA'").select(F.col("r_name").alias("table_name"), F.lit("code").alias("column"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_name").alias("meaning"))
    return W.schema_context(columns, glossary)


def f12_available_tables(spark: SparkSession, sf: str) -> DataFrame:
    """tables as a classifier sees them: name, description and notes, each once, up to 200 characters."""
    n, r = bind.table(spark, sf, "nation"), bind.table(spark, sf, "region")
    notes = n.join(r, n["n_regionkey"] == r["r_regionkey"]).filter("r_name != 'ASIA'").select(F.col("r_name").alias("table_name"), F.col("n_nationkey").alias("place"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("a common note")).otherwise(F.concat(F.lit("a long note about "), F.repeat("n_name", 5))).alias("note"))
    return W.available_tables(r.select(F.col("r_name").alias("table_name"), F.lit("nations").alias("description")), notes)


def f17_json_safe(spark: SparkSession, sf: str) -> DataFrame:
    """times and dates as ISO text."""
    o = bind.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.to_date("o_orderdate").alias("day"))
    return G.json_safe(o)


def f13_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """number of files, files by type and the first names: what answers when no SQL did."""
    n, kinds, names = G.catalog_snapshot(bind.catalog(spark, sf), 5)
    return spark.createDataFrame([(n, ",".join(f"{k}={c}" for k, c in kinds), ",".join(names))], "n long, kinds string, names string")


def a30_catalog_views(spark: SparkSession, sf: str) -> DataFrame:
    """Guarded SQL with set operations over the catalog's views, and nothing else."""
    views = G.catalog_views(bind.catalog(spark, sf))
    return G.run(spark, "select category as name, n_files from categories where n_files > 1 union all select cast(dataset_id as string), n_files from datasets except select 'x', 1 intersect select doc_type, 1 from files", views)


def q6_categorised(spark: SparkSession, sf: str) -> DataFrame:
    """Q1, Q3, Q6: a registered model's guesses in the spelling of the catalog, null if there is no such category."""
    before = Q.REGISTRY.get("categorise")
    Q.register("categorise", lambda c: F.when(c % 3 == 0, F.concat(F.lit(" SRC"), c % 10)).otherwise(F.lit("nothing")))
    try:
        d = bind.catalog(spark, sf).select("doc_id", Q.REGISTRY["categorise"](F.col("doc_id")).alias("guess"))
    finally:
        Q.REGISTRY.pop("categorise")
        if before:
            Q.register("categorise", before)
    names = spark.createDataFrame([(f"src{i}",) for i in range(0, 10, 2)], "name string")
    return Q.categorised(d, names).select("doc_id", "category")


def h8_runs(spark: SparkSession, sf: str) -> DataFrame:
    """H8, K5: sheets with a banner, a header, a run of rows and a wider last row: where each run begins and ends."""
    n, r = bind.table(spark, sf, "nation"), bind.table(spark, sf, "region")
    place = F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey"))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("doc_id"), (place + 1).alias("row_idx"), F.array("n_name", F.length("n_name").cast("string")).alias("cells"))
    rest = r.select(F.col("r_name").alias("doc_id"), F.explode(F.array(F.struct(F.lit(0).alias("row_idx"), F.array("r_name").alias("cells")), F.struct(F.lit(1).alias("row_idx"), F.array(F.lit("Nation"), F.lit("Letters")).alias("cells")), F.struct(F.lit(99).alias("row_idx"), F.array(F.lit("so"), F.lit("it"), F.lit("ends")).alias("cells")))).alias("x")).select("doc_id", "x.*")
    return K.regions(rows.unionByName(rest).withColumn("sheet", F.lit("s")))


def j9_planted_furniture(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a line worth keeping among links, sharing widgets, stock phrases and rules."""
    p = bind.table(spark, sf, "part")
    page = F.concat(F.lit("Skip to main content\n* [News](http://x)\n"), "p_name", F.lit(" stays here.\n---\n![pic](a.png)\nfollow on facebook.com/x\nShare\n[a](b) [c](d)\n"))
    return p.select("p_partkey", X.strip_furniture(page).alias("text"))


def j1_planted_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with a date, an amount, a long number and an organisation: all masked, common words left out."""
    p = bind.table(spark, sf, "part")
    q = F.concat(F.lit("What did the Army pay for "), "p_name", F.lit(" on March 5th, 2024: $"), "p_size", F.lit(" million, order "), F.col("p_partkey") + 10000, F.lit("?"))
    return p.select("p_partkey", X.query_pattern(q).alias("pattern"))


def _text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind.catalog(spark, sf).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    figure = F.when(F.col("id") % 5 == 0, "figure").otherwise("text")
    c = bind.chunks(spark, sf).drop("content_type").join(docs, "id")
    return c.withColumns({"start_char": F.lit(0), "content_type": figure, "figure_kind": F.when(F.col("id") % 2 == 0, "diagram").otherwise("photo"), "page": F.col("chunk_index") + 1})


BM25 = """
 q as (select embedding as v from embeddings where vec_id = {vec}), dist as (select r.*, list_sum(list_transform(range(1, len(r.vector) + 1), lambda i: power(r.vector[i]::double - q.v[i]::double, 2))) as distance from r, q),
 nr as (select id, row_number() over (order by distance, id) as rk from dist),
 tok as (select id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x != '') as w from r),
 terms as (select distinct unnest(regexp_split_to_array('{question}', ' ')) as t), f as (select count(*) as n, avg(len(w)) as a from tok),
 tf as (select id, t, len(w) as l, len(list_filter(w, lambda x: x = t)) as tf from tok, terms), df as (select t, count(*) as df from tf where tf > 0 group by t),
 bm as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) as score from tf join df using (t), f where tf > 0 group by id),
 ft as (select id, row_number() over (order by score desc, id) as rk from bm),
 hy as (select id, sum(1.0 / (60 + rk)) as score from (select * from nr where rk <= 50 union all select * from ft where rk <= 50) group by id order by sum(1.0 / (60 + rk)) desc, id limit {k})"""
CHUNKS = f"""{bind.CHUNKS}, t as (select c.* exclude (content_type), case when c.id % 5 = 0 then 'figure' else 'text' end as content_type, case when c.id % 2 = 0 then 'diagram' else 'photo' end as figure_kind, coalesce(d.text, '') as text from chunks c join documents d on d.doc_id = c.id)"""
SHARE = "(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in sorted(set(QUESTION.split()))) + f") / {len(set(QUESTION.split()))}.0"


def d3_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """D3: hybrid search, ordered anew by a model's score (the share of the question's words)."""
    got = T.hybrid_reranked(_text_chunks(spark, sf), bind.query_vector(spark, sf), QUESTION, 12)
    return got.select("id", F.round("score", 4).alias("score"))


def d24_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of a kind by vector and words, in documents that the caller may see, whatever the figures' rows say."""
    seen = bind.catalog(spark, sf).filter(F.array_contains("acl_groups", "g2")).select("doc_id")
    got = T.search_figures(_text_chunks(spark, sf), [], bind.query_vector(spark, sf), QUESTION, 8, "diagram", seen)
    return got.select("id", F.round("score", 6).alias("score"))


def d21_technical(spark: SparkSession, sf: str) -> DataFrame:
    """A lookup, pages around its figures, and one more search where roles are missing: how much each adds, and what is
    covered in the end. The marks of roles are planted in some passages."""
    c = _text_chunks(spark, sf)
    mark = F.when(F.col("id") % 6 == 1, "rollback").when(F.col("id") % 6 == 2, "caution").when(F.col("id") % 6 == 3, "verify").otherwise("onre")
    c = c.withColumn("text", mark).withColumn("section_id", F.lit(""))
    chunks, report = T.technical(c, ["ALL"], "onre", bind.query_vector(spark, sf), "procedure", lambda q: bind.query_vector(spark, sf, 11), 10, 6)
    own = chunks.filter("content_type != 'figure'").select("id", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(r).alias("role")) for w, r in (("rollback", "rollback"), ("caution", "warnings"), ("verify", "verification"))])).alias("x"), "text").filter("text = x.word")
    counted = own.groupBy(F.col("x.role").alias("role")).agg(F.count("*").alias("counted"))
    met = report.join(counted, "role", "left")
    return met.select("role", (F.coalesce("counted", F.lit(0)) == F.col("n_chunks")).alias("agrees"))


def f15_structured(spark: SparkSession, sf: str) -> DataFrame:
    """SQL over tables that the question is near to, beside the nearest row narratives; a failure leaves the rows."""
    tables = bind.table(spark, sf, "embeddings").filter("vec_id in (7, 8)").select(F.when(F.col("vec_id") == 7, "nation").otherwise("far").alias("table_name"), F.col("embedding").alias("vector"))
    rows = bind.chunks(spark, sf).withColumn("chunk_size_tier", F.lit("table_row"))
    relations, v = {"nation": bind.table(spark, sf, "nation")}, bind.query_vector(spark, sf)

    def look_up(names: list[str]) -> G.Trace:
        return G.repaired(lambda p: f"select count(*) as n from {names[0]}", lambda q: [r.asDict() for r in G.run(spark, q, relations).collect()], "q")

    def fails(names: list[str]) -> G.Trace:
        raise RuntimeError("no model")

    out = []
    for name, how, threshold in (("found", look_up, 0.9), ("no table", look_up, 1.1), ("failed", fails, 0.9)):
        trace, got = T.structured(tables, relations, rows, ["ALL"], QUESTION, v, how, None, threshold, 20)
        out.append((name, trace.verdict, trace.rows[0]["n"] if trace.rows else None, got.count()))
    return spark.createDataFrame(out, "asked string, verdict string, n long, n_rows long")


def q9_facade(spark: SparkSession, sf: str) -> DataFrame:
    """The tools of the facade: search by type, documents of a category (all, if it has none), a
    document's chunks by its id or its unique name, sources, and nodes near others."""
    catalog, v = bind.catalog(spark, sf), bind.query_vector(spark, sf)
    e = S.Engine(spark, catalog, _text_chunks(spark, sf), lambda q: v, edges=bind.edges(spark, sf))
    some = catalog.filter(F.array_contains("acl_groups", "g1")).agg(F.min(F.nullif(F.col("category"), F.lit("")))).first()[0]
    named = catalog.filter("doc_id % 5 = 1").select("filename").orderBy("doc_id").first()[0]
    got = [
        ("found of a type", e.search_documents(QUESTION, ["ALL"], "pdf", 10).filter("doc_type != 'pdf'").count()),
        ("category", e.list_documents(some, ["g1"]).count()), ("unknown category", e.list_documents("nothing", ["g1"]).count()),
        ("by id", e.lookup_document("4", ["ALL"]).count()), ("by name", e.lookup_document(named, ["ALL"]).count()),
        ("sources", e.list_sources(["ALL"]).count()), ("near nodes", e.search_graph(["r1"], 1).count()), ("answers", int(e.ask("onre with", ["ALL"]).count() > 0)),
    ]
    return spark.createDataFrame(got, "what string, n long")


def _family_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' manuals in editions that supersede each other, and titles that only differ by a letter.

    Each supplier has ten documents: a, b, 1.0 and 2.0 of one manual; c, a manual that supersedes it under another number; d, a
    copy of a; e and f, without a number, whose titles differ by a letter; g and h, of one title and one set of sections that
    name no product; i and j, the same of a product. Titles hold letters that are a supplier's own; the sections are everybody's.
    """
    s = bind.table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey").cast("string")
    own = lambda kind: F.translate(F.md5(F.concat(F.lit(kind), k).cast("binary")), "0123456789", "ghijklmnop")
    sections = F.lit("## Setup\n## Safety\n## Cabling\n## Faults\n")
    head = lambda title, lines: F.concat(F.lit("# "), title, F.lit("\n"), *[F.lit(x) if isinstance(x, str) else x for x in lines])
    number = lambda letter: F.concat(F.lit(f"Document ID: {letter}-"), k, F.lit("\n"))
    manual, network, switch = F.concat(F.lit("Manual "), own("m")), F.concat(F.lit("Network "), own("n")), F.concat(F.lit("Switch "), own("s"))
    product = F.concat(F.lit("Product: P"), k, F.lit("\n"))
    one = head(manual, [number("M"), "Revision: 1.0\nEffective date: 2020-01-01\n"])
    texts = {
        "a": one, "b": head(manual, [number("M"), "Revision: 2.0\nEffective date: 2021-01-01\n"]),
        "c": head(F.concat(F.lit("Handbook "), k), [number("H"), "Revision: 1.0\n", F.concat(F.lit("Supersedes: M-"), k, F.lit(" and others\n"))]),
        "d": one,
        "e": head(F.concat(F.lit("Router guide "), own("r")), [sections]), "f": head(F.concat(F.lit("Router guides "), own("r")), [sections]),
        "g": head(network, ["Revision: 1.0\n", sections]), "h": head(network, ["Revision: 2.0\n", sections]),
        "i": head(switch, [product, "Revision: 1.0\n", sections]), "j": head(switch, [product, "Revision: 2.0\n", sections]),
    }
    every = s.select("s_suppkey", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), t.alias("text")) for n, t in texts.items()])).alias("x")).select("s_suppkey", "x.*")
    docs = every.select(F.concat(F.lpad(k, 6, "0"), F.col("part")).alias("doc_id"), F.concat(F.lit("f"), k, F.col("part"), F.lit(".txt")).alias("filename"), F.lit("txt").alias("doc_type"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return L.identity(docs)


def l1_relations(spark: SparkSession, sf: str) -> DataFrame:
    """How sure pairs of documents are to be editions of one, and why: by number, by supersession, by title, product
    and sections. Copies stand behind the first of them. Every pair that is found."""
    return L.pairs(L._profiles(_family_docs(spark, sf))[0])


def l4_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that may be editions of one, by titles that resemble each other and shared sections. Every pair."""
    return L.candidates(_family_docs(spark, sf)).select("a", "b", "confidence")


def l3_families(spark: SparkSession, sf: str) -> DataFrame:
    """L3: families by complete linkage: a manual of the number and its copy; the manual that supersedes them is linked with each."""
    return L.families(_family_docs(spark, sf))


def l2_newer(spark: SparkSession, sf: str) -> DataFrame:
    """L2: of two revisions the newer one, by number and date; by supersession; unknown where neither says."""
    d = _family_docs(spark, sf).select("doc_id", "identity", F.substring("doc_id", 1, 6).alias("s"), F.substring("doc_id", 7, 1).alias("part"))
    x, y = d.select("s", F.col("part").alias("p"), F.col("identity").alias("x")), d.select("s", F.col("part").alias("q"), F.col("identity").alias("y"))
    met = x.join(y, "s").filter("(p = 'a' and q = 'b') or (p = 'b' and q = 'a') or (p = 'c' and q = 'a') or (p = 'e' and q = 'f')")
    return met.select("s", "p", "q", L.newer(F.col("x"), F.col("y")).alias("sign"))


def l5_asked_editions(spark: SparkSession, sf: str) -> DataFrame:
    """Editions chosen for a question about a revision, as of a date, and in general."""
    d = _family_docs(spark, sf).filter("substring(doc_id, 7, 1) in ('a', 'b', 'd', 'g', 'h', 'i', 'j')")
    asked = {"plain": "how is it set up?", "revision": "what does revision 1.0 say?", "date": "the state as of 2020-06-01", "compare": "compare the editions"}
    known = L.known_families(d)
    parts = [L.select_editions(d, q, known=known).filter("selected").groupBy(F.substring("doc_id", 7, 1).alias("part"), "reason").agg(F.count("*").alias("n")).withColumn("asked", F.lit(k)) for k, q in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def j27_applicable(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that cover the asked version: by a span, a least version, an exact one; null if they don't say."""
    p = bind.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.array(F.concat(F.lit("1.0 to "), "p_size", F.lit(".0")))).when(F.col("p_partkey") % 4 == 1, F.array(F.concat(F.lit("at least "), "p_size"))).when(F.col("p_partkey") % 4 == 2, F.array(F.concat("p_size", F.lit(".1")))).otherwise(F.array(F.lit("all"))).alias("applicability"))
    facts = F.struct(F.lit(None).cast("string").alias("product_normalized"), F.lit(None).cast("string").alias("environment"), F.col("applicability"))
    return p.select("p_partkey", L.applicable(facts, {"software_version": "20.1.3"}).alias("fits"))


def l7_diagram_links(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose references name a drawing by file name or number, of the revision that they name, if any."""
    s = bind.table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey").cast("string")
    drawings = s.select(F.concat(F.lit("v"), k).alias("doc_id"), F.concat(F.lit("net-"), k, F.lit(".vsdx")).alias("filename"), F.lit("vsdx").alias("doc_type"), F.concat(F.lit("Document ID: V-"), k, F.lit("\nRevision: 2\n")).alias("text"))
    said = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("References: net-"), k, F.lit(".vsdx"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("References: V-"), k, F.lit(" rev 2"))).otherwise(F.concat(F.lit("References: V-"), k, F.lit(" rev 3")))
    docs = s.select(F.concat(F.lit("d"), k).alias("doc_id"), F.concat(F.lit("d"), k, F.lit(".txt")).alias("filename"), F.lit("txt").alias("doc_type"), said.alias("text"))
    return L.diagram_links(L.identity(drawings.unionByName(docs))).select("doc_id", "target")


def l8_identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """What documents state about themselves; a field with two values is a conflict."""
    p = bind.table(spark, sf, "part")
    text = F.concat(F.lit("Title: "), "p_name", F.lit("\nProduct: "), "p_brand", F.lit("\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Product: "), "p_type", F.lit("\n"))).otherwise(F.lit("")), F.lit("Published: 1/2/2020\nSupersedes: a\nSupersedes: b\n"))
    d = L.identity(p.select(F.col("p_partkey").alias("doc_id"), F.lit("x.txt").alias("filename"), text.alias("text")))
    return d.select("doc_id", "identity.title", "identity.product", F.size("identity.supersedes").alias("n_superseded"), F.concat_ws(",", "identity.conflicts").alias("conflicts"))


FAMILY = "s as (select lpad(s_suppkey::varchar, 6, '0') as k from supplier)"
ORACLE_SQL = {
    "c23_guarded": "select p_partkey, p_partkey % 13 in (0, 1, 5, 6, 8, 9) as ours, p_partkey % 13 in (0, 4, 5, 6, 8, 9, 12) as theirs from part",
    "c25_references": """select p_partkey, case p_partkey % 13 when 0 then 'part' when 1 then 'nation,x' when 4 then 'orders' when 5 then 'nation,part' when 6 then '' when 7 then 'read_csv' when 8 then 'part' when 9 then 'part' when 10 then 'parquet,parquet.' when 12 then 'other,other.' else '' end as tables,
        case when p_partkey % 13 = 1 then 'x' else '' end as defined, case when p_partkey % 13 in (0, 8, 9) then 'd1' when p_partkey % 13 = 1 then 'd2' when p_partkey % 13 = 5 then 'd1,d2' else '' end as documents from part""",
    "f2_extracted_sql": """select p_partkey, case p_partkey % 13 when 0 then 'select * from part where p_name = ' || chr(39) || p_name || chr(39) || ';' when 1 then 'with x as (select ' || chr(39) || p_name || chr(39) || ' as n) select * from x, nation' when 3 then 'select 1; select 2'
        when 4 then 'select ' || chr(39) || p_name || chr(39) || ' from orders' when 5 then 'select * from part p, nation' when 6 then 'select ' || chr(39) || p_name || chr(39) when 7 then 'select * from read_csv(' || chr(39) || 'x' || chr(39) || ')'
        when 8 then 'select * from (select * from part) q' when 9 then 'select ' || chr(39) || 'drop' || chr(39) || ' from part' when 10 then 'select * from parquet.`/etc' when 12 then 'select * from other.part' else '' end as statement from part""",
    "a30_catalog_views": f"with {bind.CATALOG} select category as name, count(*) as n_files from catalog group by 1 having count(*) > 1 union select dataset_id::varchar, count(*) from catalog group by dataset_id",
    "q6_categorised": "select doc_id, case when doc_id % 3 = 0 and (doc_id % 10) % 2 = 0 then 'src' || (doc_id % 10) end as category from documents",
    "h8_runs": "select r_name as doc_id, 's' as sheet, 1::int as header_row, (2 + count(*))::int as end_row from nation join region on n_regionkey = r_regionkey group by r_name",
    "j9_planted_furniture": "select p_partkey, p_name || ' stays here.' as text from part",
    "j1_planted_patterns": "select p_partkey, '[ORG] pay ' || p_name || ' on [DATE]: [AMOUNT], order [ID]' as pattern from part",
    "d19_lookup": f"""with {CHUNKS}, r as (select * from t where chunk_size_tier = 'medium'), {BM25.format(question=QUESTION, k=10, vec=7)}, m as (select hy.id, {SHARE} as m from hy join r using (id)), b as (select min(m) as lo, max(m) as hi from m),
        s as (select id, 0.01 + case when hi > lo then (m - lo) / (hi - lo) else 0.5 end as score from m, b), c as (select r.id, doc_id, chunk_index, score from s join r using (id) where score >= 0.3 * (select max(score) from s))
        select id, doc_id, chunk_index, round(score, 4) as score from c union all select distinct r.id, r.doc_id, r.chunk_index, 0.4 from r join c on r.doc_id = c.doc_id and abs(r.chunk_index - c.chunk_index) <= 1 where r.id not in (select id from c)""",
    "d20_cross_reference": f"""with {CHUNKS}, r as (select * from t), x as (with {BM25.format(question=QUESTION, k=8, vec=7).strip()} select * from hy), y as (with {BM25.format(question="onre", k=8, vec=11).strip()} select * from hy),
        u as (select id, 0 as branch, score from x union all select id, 1, score from y where id not in (select id from x)) select id, branch, round(score / (select max(score) from u), 4) as relevance from u""",
    "a25_links": """with p as (select url, regexp_extract(url, '^(https?://[^/?#]+)', 1) as host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') as base, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"''>]+)["'']', 1)) as h from pages),
        w as (select url, host, case when regexp_matches(trim(h), '^https?://') then trim(h) when trim(h) like '//%' then regexp_extract(url, '^(https?:)', 1) || trim(h) when trim(h) like '/%' then host || trim(h) when regexp_matches(trim(h), '^(#|[a-z]+:)') then null else base || trim(h) end as t from p),
        c as (select url, host, regexp_replace(regexp_extract(regexp_replace(t, '#.*$', ''), '^([^?]*)', 1), '/+$', '') || regexp_extract(regexp_replace(t, '#.*$', ''), '([?].*)$', 1) as target from w)
        select distinct url, target from c where regexp_extract(target, '^(https?://[^/?#]+)', 1) = host""",
    "f6_repaired": """select * from (values ('at once', 'satisfactory', 1::bigint, 'satisfactory', 25::bigint), ('second', 'satisfactory', 2, 'empty,satisfactory', 25), ('third', 'satisfactory', 3, 'error,no_sql,satisfactory', 25),
        ('never', 'error', 3, 'error,error,error', null), ('empty', 'empty', 3, 'empty,empty,empty', null), ('no sql', 'skipped', 3, 'no_sql,no_sql,no_sql', null)) t(asked, verdict, attempts, states, n)""",
    "f9_schema_prompts": "select * from (values (0::bigint, 2::bigint, true, true), (1, 2, false, true), (2, 2, false, false)) t(place, n_lines, has_values, has_columns)",
    "f10_schema_context": """with v as (select r_name, string_agg(lpad(n_nationkey::varchar, 2, '0') || ' = ' || n_name, ', ' order by n_nationkey) as c from nation join region on n_regionkey = r_regionkey where r_name != 'ASIA' group by 1)
        select region.r_name as table_name, 'Table ' || region.r_name || ' — nations' || chr(10) || 'Columns:' || chr(10) || '  - code (int): its number' || chr(10) || '  - name (string)' || case when c is not null then chr(10) || 'Value meanings:' || chr(10) || '  - code: ' || c else '' end as context
        from region left join v using (r_name)""",
    "f12_available_tables": """with n as (select r_name, min(n_nationkey) as p, case when n_nationkey % 2 = 0 then 'a common note' else 'a long note about ' || repeat(n_name, 5) end as note from nation join region on n_regionkey = r_regionkey where r_name != 'ASIA' group by 1, 3),
        v as (select r_name, string_agg(note, '; ' order by p) as t from n group by 1) select r_name as table_name, '- ' || r_name || ': nations' || coalesce(' — ' || substr(t, 1, 200), '') as line from region left join v using (r_name)""",
    "f17_json_safe": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as at, strftime(o_orderdate, '%Y-%m-%d') as day from orders",
    "f13_snapshot": f"with {bind.CATALOG}, k as (select doc_type || '=' || count(*) as x from catalog group by doc_type) select (select count(*) from catalog) as n, (select string_agg(x, ',' order by x) from k) as kinds, (select string_agg(filename, ',' order by doc_id) from (select * from catalog order by doc_id limit 5)) as names",
    "d3_reranked": f"""with {CHUNKS}, r as (select * from t), {BM25.format(question=QUESTION, k=12, vec=7)}, m as (select hy.id, {SHARE} as m from hy join r using (id)), b as (select min(m) as lo, max(m) as hi from m)
        select id, round(0.01 + case when hi > lo then (m - lo) / (hi - lo) else 0.5 end, 4) as score from m, b""",
    "d24_figures": f"""with {bind.CATALOG}, {CHUNKS}, r as (select * from t where chunk_size_tier = 'medium' and content_type = 'figure' and figure_kind = 'diagram' and doc_id in (select doc_id from catalog where list_contains(acl_groups, 'g2'))),
        {BM25.format(question=QUESTION, k=8, vec=7)} select id, round(score, 6) as score from hy""",
    "d21_technical": "select unnest(['prerequisites', 'steps', 'warnings', 'verification', 'rollback']) as role, true as agrees",
    "f15_structured": "select * from (values ('found', 'satisfactory', 25::bigint, 20::bigint), ('no table', 'skipped', null, 20), ('failed', 'error', null, 20)) t(asked, verdict, n, n_rows)",
    "q9_facade": f"""with {bind.CATALOG}, {CHUNKS}, {bind.EDGES}, one as (select doc_id from catalog where doc_id % 5 = 1 order by doc_id limit 1)
        select 'found of a type' as what, 0::bigint as n union all select 'category', count(*) from catalog where category = (select min(nullif(category, '')) from catalog where list_contains(acl_groups, 'g1')) and list_contains(acl_groups, 'g1') union all select 'unknown category', count(*) from catalog where list_contains(acl_groups, 'g1')
        union all select 'by id', count(*) from t where doc_id = 4 and chunk_size_tier = 'medium' union all select 'by name', count(*) from t where doc_id in (from one) and chunk_size_tier = 'medium'
        union all select 'sources', count(distinct coalesce(nullif(category, ''), 'uncategorized')) from catalog union all select 'near nodes', 1 + count(distinct source) from edges where target = 'r1' union all select 'answers', 1""",
    "l1_relations": f"""with {FAMILY} select k || p as a, k || q as b, c::double as confidence, why as reason from s, (values ('a', 'b', 0.99, 'same identifier'), ('a', 'c', 0.98, 'supersession'), ('b', 'c', 0.98, 'supersession'),
        ('e', 'f', 0.65, 'possible'), ('g', 'h', 0.65, 'possible'), ('i', 'j', 0.93, 'same title, product and sections')) t(p, q, c, why)""",
    "l4_candidates": f"with {FAMILY} select k || p as a, k || q as b, 0.65::double as confidence from s, (values ('e', 'f'), ('g', 'h')) t(p, q)",
    "l3_families": f"with {FAMILY} select k || p as doc_id, k || q as family from s, (values ('a', 'a'), ('b', 'a'), ('c', 'a'), ('d', 'a'), ('e', 'e'), ('f', 'f'), ('g', 'g'), ('h', 'h'), ('i', 'i'), ('j', 'i')) t(p, q)",
    "l2_newer": f"with {FAMILY} select k as s, p, q, case when p = 'a' then -1 when p = 'b' then 1 when p = 'c' then 1 end::int as sign from s, (values ('a', 'b'), ('b', 'a'), ('c', 'a'), ('e', 'f')) t(p, q)",
    "l5_asked_editions": """select asked, part, 'selected' as reason, n from (select count(*) as n from supplier), (select 'plain' as asked, unnest(['b', 'g', 'h', 'j']) as part union all select 'revision', unnest(['a', 'd', 'g', 'i'])
        union all select 'date', unnest(['a', 'g', 'h', 'j']) union all select 'compare', unnest(['a', 'b', 'd', 'g', 'h', 'i', 'j']))""",
    "j27_applicable": "select p_partkey, case p_partkey % 4 when 0 then p_size >= 21 when 1 then p_size <= 20 when 2 then p_size = 20 end as fits from part",
    "l7_diagram_links": "select 'd' || s_suppkey as doc_id, 'v' || s_suppkey as target from supplier where s_suppkey % 3 != 2",
    "l8_identity_conflicts": "select p_partkey as doc_id, p_name as title, case when p_partkey % 2 = 1 then p_brand end as product, 2::int as n_superseded, case when p_partkey % 2 = 0 then 'product,publication_date' else 'publication_date' end as conflicts from part",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
