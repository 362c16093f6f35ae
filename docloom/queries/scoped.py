"""Scope and routing, figures and layout, strategies and stores over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import figures as U, routing as C
from docloom.operators import retrieval as R
from docloom.plans import strategies as S
from docloom.queries import bind
from docloom.sources import stores

QUESTION = "the thing and onre with"


def c4_query_scope(spark: SparkSession, sf: str) -> DataFrame:
    cat = bind.catalog(spark, sf).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    scope, _ = C.query_scope(cat, ["g1", "h2"], 3, bind.table(spark, sf, "labels"))
    return scope.select("doc_id")


def c4_revisions_differ(spark: SparkSession, sf: str) -> DataFrame:
    cat = bind.catalog(spark, sf).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    one, two, three = (C.query_scope(c, ["ALL"])[1].first()[0] for c in (cat, cat.repartition(5), cat.filter("doc_id != 1")))
    return spark.createDataFrame([(one == two, one != three)], "same boolean, other boolean")


def c5_scoped_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """C5, E13."""
    reg = bind.catalog(spark, sf).filter("doc_id % 3 = 0").select(F.concat(F.lit("doc_"), "doc_id").alias("table_name"), "doc_id", "acl_groups")
    reg = reg.unionByName(spark.createDataFrame([("sales", None, ["g2"]), ("hr", None, ["x"])], "table_name string, doc_id long, acl_groups array<string>"))
    return C.scoped_schemas(reg, ["g2"], bind.catalog(spark, sf).filter("dataset_id = 1"), False).select("table_name")


def c11_type_after_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 30).withColumn("doc_type", F.when(F.col("id") % 2 == 0, "pdf").otherwise("docx"))
    return C.type_filter(top, "pdf").select("id")


def c12_speaker(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.when(F.rtrim("text").endswith("?"), "question").otherwise("statement").alias("utterance_type"))
    return C.speaker_filter(t, "ASSIST", "statement").select("conv_id", "turn")


def c17_suggested(spark: SparkSession, sf: str) -> DataFrame:
    cats = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.split("p_name", " ").alias("routing_keywords"))
    return C.suggested_categories(cats, "A red bolt, or a COLD gear?").select("name", "keyword")


def c18_all_sources(spark: SparkSession, sf: str) -> DataFrame:
    cats = bind.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("d").alias("description"))
    return C.all_sources(cats, bind.table(spark, sf, "nation").select(F.col("n_name").alias("table_name"), F.lit("n").alias("description")))


def c19_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with given values, in order."""
    return C.listed(bind.catalog(spark, sf), ["filename", "doc_id"], dataset_id=2, lang=None, doc_type="pdf").select("doc_id", "filename")


def c27_graph_skips(spark: SparkSession, sf: str) -> DataFrame:
    f = bind.catalog(spark, sf).select("doc_id", F.concat(F.lit("f."), F.get(F.array(F.lit("XLSX"), F.lit("txt"), F.lit("csv")), (F.col("doc_id") % 3).cast("int"))).alias("f"))
    return f.filter(C.skips_graph(F.col("f"))).select("doc_id")


def c28_intents(spark: SparkSession, sf: str) -> DataFrame:
    """What questions are after, whether they are about pictures, and how many."""
    asked = ["compare the two revisions of", "tunnel is down at", "command for bgp of", "command steps: how to set", "explain the core network of", "phone list of", "show the topology diagram of"]
    p = bind.table(spark, sf, "orders").select("o_orderkey", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, asked)), (F.col("o_orderkey") % 7 + 1).cast("int")), F.concat(F.lit("no "), F.col("o_orderkey").cast("string"))).alias("q"))
    return p.select("o_orderkey", C.intent(F.col("q")).alias("intent"), C.visual(F.col("q")).alias("visual"), C.image_limit(F.col("q"), "requested", 3).alias("images"))

def d8_routed_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("table_name"), F.col("embedding").alias("vector"))
    return C.route_tables(t, bind.query_vector(spark, sf), 0.1, 8).select("table_name")


def d9_chosen_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("table_name"), F.col("embedding").alias("vector"))
    return C.route_tables(t, bind.query_vector(spark, sf), -1.0, 8, lambda names: ["nowhere", names[3], names[0]]).select("table_name")


def d23_graph_sources(spark: SparkSession, sf: str) -> DataFrame:
    """D23, E17."""
    hints = bind.catalog(spark, sf).select(F.col("doc_id").alias("hint_id"), "text", "filename")
    return C.graph_sources(hints, "that with then there onre", bind.catalog(spark, sf))


def x28_activity(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events")
    s = C.activity_strategy(F.when(F.col("event_id") % 9 == 0, "error").otherwise("ok"), F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return e.groupBy(s.alias("strategy")).agg(F.count("*").alias("n"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    l = bind.table(spark, sf, "lineitem")
    return l.select(F.floor(F.col("l_orderkey") / 20).alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"), F.monotonically_increasing_id().alias("line_id"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_suppkey") * 7 % 700).cast("double").alias("top")).withColumns({"x1": F.col("x0") + 60, "bottom": F.col("top") + 10})


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    o = bind.table(spark, sf, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 20).alias("doc_id"), (F.col("o_orderkey") % 3).cast("int").alias("page"), (F.col("o_custkey") % 400).cast("double").alias("x0"), (F.col("o_custkey") * 3 % 600).cast("double").alias("top")).withColumns({"x1": F.col("x0") + 150, "bottom": F.col("top") + 120})


def e24_outside_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose centre lies in no box of their page."""
    return U.outside_boxes(_lines(spark, sf), _boxes(spark, sf)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def a10_split_words(spark: SparkSession, sf: str) -> DataFrame:
    cuts = _boxes(spark, sf).select("doc_id", "page", F.col("x0").alias("x"))
    return U.splits_words(_lines(spark, sf).select("doc_id", "page", "x0", "x1"), cuts)


def a21_large_images(spark: SparkSession, sf: str) -> DataFrame:
    p = bind.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10).alias("width"), (F.col("p_partkey") % 300).alias("height"))
    return U.worth_looking_at(p).select("p_partkey")


def a22_image_budget(spark: SparkSession, sf: str) -> DataFrame:
    l = bind.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_partkey") % 40).alias("image_hash"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place"), "l_suppkey")
    return U.within_budget(l, 5).groupBy("doc_id").agg(F.countDistinct("image_hash").alias("n_images"), F.count("*").alias("n"))


def x8_index_entries(spark: SparkSession, sf: str) -> DataFrame:
    f = bind.catalog(spark, sf).select("doc_id", F.lit(1).alias("figure_id"), "text")
    return U.index_entries(f).select("doc_id", "start", F.length("entry").alias("n"))


def x10_answer_images(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events").select((F.col("user_id") % 20).alias("doc_id"), F.when(F.col("event_type") == "view", F.col("event_id") % 3).alias("figure_id"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 4).alias("evidence_id"))
    return U.answer_images(e, 12).select("doc_id", "figure_id", "ordinal", F.concat_ws(",", "evidence_ids").alias("evidence_ids"))


def o6_page_order(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events").select((F.col("user_id") % 20).alias("doc_id"), (F.col("event_id") % 3).alias("page"), (F.col("event_id") * 31 % 97).alias("top"), (F.col("event_id") * 17 % 89).alias("x0"), F.when(F.col("event_type") == "view", "figure").otherwise("text").alias("kind"), "event_id")
    return U.page_order(e).select("event_id", "place")


def _text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind.catalog(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return bind.chunks(spark, sf).join(docs, "id").withColumns({"start_char": F.lit(0)})


def d19_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return S.lookup(_text_chunks(spark, sf), ["g0", "g1", "g2", "g3"], QUESTION, bind.query_vector(spark, sf), 10).select("id", "doc_id", "chunk_index", F.round("score", 4).alias("score"))


def d17_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """D17."""
    c = _text_chunks(spark, sf)
    summaries = c.filter("chunk_index = 0").withColumn("chunk_size_tier", F.lit("summary"))
    return S.sweep(c.unionByName(summaries), ["ALL"], QUESTION, bind.query_vector(spark, sf), 20, per_doc=5).select("id", "doc_id", "chunk_index")


def d18_candidates(spark: SparkSession, sf: str) -> DataFrame:
    a = R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 40).groupBy("doc_id").agg(F.max("score").alias("score"))
    b = bind.catalog(spark, sf).select("doc_id", (F.col("n_chars") % 1009).cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)
    return S.map_reduce_candidates(a, b).select("doc_id", F.round("score", 6).alias("score"))


def d20_cross_reference(spark: SparkSession, sf: str) -> DataFrame:
    """D20, D22."""
    c = _text_chunks(spark, sf).withColumn("chunk_size_tier", F.lit("small"))
    return S.cross_reference(c, ["ALL"], [(QUESTION, bind.query_vector(spark, sf)), ("onre", bind.query_vector(spark, sf, 11))], 8).select("id", "branch", F.round("relevance", 4).alias("relevance"))


def b1_store(spark: SparkSession, sf: str) -> DataFrame:
    """Append twice, the second time with a new column, delete, compact; the rows that are left."""
    store = stores.Store(spark, bind.folder(spark, "store"))
    n = bind.table(spark, sf, "nation")
    store.append(n.filter("n_nationkey < 10").withColumn("id", stores.row_id("n_nationkey")))
    store.append(n.filter("n_nationkey >= 10").withColumn("kind", F.lit("late")), {"kind": "early"})
    store.delete(n.filter("n_regionkey = 2"), "n_nationkey")
    store.optimise(1)
    return store.read().select("n_nationkey", "kind", F.col("id").isNotNull().alias("has_id"))


ALLOWED = "select doc_id from labels"
BOXES = """
l as (select l_orderkey // 20 as doc_id, (l_linenumber % 3)::int as page, (l_partkey % 500)::double as x0, ((l_suppkey * 7) % 700)::double as top, row_number() over () as line_id from lineitem),
b as (select o_orderkey // 20 as doc_id, (o_orderkey % 3)::int as page, (o_custkey % 400)::double as x0, ((o_custkey * 3) % 600)::double as top from orders)"""
NEAR = """
 near as (select c.*, list_sum(list_transform(range(1, len(c.vector) + 1), lambda i: power(c.vector[i]::double - q.v[i]::double, 2))) as distance
          from chunks c, (select embedding as v from embeddings where vec_id = 7) q)"""

ORACLE_SQL = {
    "c28_intents": "select o_orderkey, ['version_comparison', 'troubleshooting', 'command_reference', 'procedure', 'architecture', '', 'architecture'][o_orderkey % 7 + 1] as intent, o_orderkey % 7 = 6 as visual, case when o_orderkey % 7 = 6 then 3 else 0 end::int as images from orders",
    "c4_query_scope": f"with {bind.CATALOG} select doc_id from catalog where list_has_any(acl_groups, ['g1', 'h2']) and dataset_id = 3 and doc_id in ({ALLOWED})",
    "c4_revisions_differ": "select true as same, true as other",
    "c5_scoped_schemas": f"with {bind.CATALOG} select 'doc_' || doc_id as table_name from catalog where doc_id % 3 = 0 and dataset_id = 1 and list_contains(acl_groups, 'g2') union all select 'sales'",
    "c11_type_after_topk": f"with {bind.CHUNKS}, {NEAR}, t as (select id from near order by distance, id limit 30) select id from t where id % 2 = 0",
    "c12_speaker": "select conv_id, turn from conversations where role ilike '%assist%' and not rtrim(text) like '%?'",
    "c17_suggested": "with k as (select p_partkey as name, generate_subscripts(w, 1) as i, unnest(w) as keyword from (select p_partkey, string_split(p_name, ' ') as w from part)), h as (select *, row_number() over (partition by name order by i) as p from k where contains('a red bolt, or a cold gear?', lower(keyword))) select name, keyword from h where p = 1",
    "c18_all_sources": "select 'category' as kind, r_name as name, 'd' as description from region union all select 'schema', n_name, 'n' from nation",
    "c19_listed": f"with {bind.CATALOG} select doc_id, filename from catalog where dataset_id = 2 and doc_type = 'pdf'",
    "c27_graph_skips": "select doc_id from documents where doc_id % 3 != 1",
    "d8_routed_tables": """with s as (select 't' || e.vec_id as table_name, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * q.v[i]::double)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double)))
        / sqrt(list_sum(list_transform(q.v, lambda x: x::double * x::double))) as sim from embeddings e, (select embedding as v from embeddings where vec_id = 7) q) select table_name from s where sim >= 0.1 order by sim desc, table_name limit 8""",
    "d9_chosen_tables": """with s as (select 't' || e.vec_id as table_name, list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * q.v[i]::double)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::double * x::double)))
        / sqrt(list_sum(list_transform(q.v, lambda x: x::double * x::double))) as sim from embeddings e, (select embedding as v from embeddings where vec_id = 7) q), t as (select table_name, row_number() over (order by sim desc, table_name) as p from s) select table_name from t where p in (1, 4)""",
    "d23_graph_sources": f"""with {bind.CATALOG}, h as (select doc_id as hint_id, lower(text) as t, filename from catalog),
        s as (select *, (contains(t, 'that')::int + contains(t, 'with')::int + contains(t, 'then')::int + contains(t, 'there')::int + contains(t, 'onre')::int) as shared from h), b as (select * from s where shared > 0 order by shared desc, hint_id limit 3),
        f as (select filename, min(doc_id) as doc_id from catalog group by 1 having count(*) = 1) select hint_id, doc_id, shared from b join f using (filename)""",
    "x28_activity": "select case when event_id % 9 = 0 then 'error' when event_id % 4 = 0 then 'cache' when event_id % 7 != 0 then event_type else 'unknown' end as strategy, count(*) as n from events group by 1",
    "e24_outside_boxes": f"with {BOXES} select doc_id, page, count(*) as n from l where not exists (select 1 from b where b.doc_id = l.doc_id and b.page = l.page and l.x0 + 30 between b.x0 and b.x0 + 150 and l.top + 5 between b.top and b.top + 120) group by all",
    "a10_split_words": f"""with {BOXES}, c as (select distinct doc_id, page, x0 as x from b), w as (select l.doc_id, l.page, l.line_id, bool_or(c.x > l.x0 and c.x < l.x0 + 60) as cut from l join c using (doc_id, page) group by all)
        select doc_id, page, count(*) as n, count(case when cut then 1 end) as n_cut from w group by all having count(case when cut then 1 end) >= 2 and count(case when cut then 1 end) >= 0.1 * count(*)""",
    "a21_large_images": "select p_partkey from part where p_size * 10 >= 80 and p_partkey % 300 >= 80 and p_size * 10 * (p_partkey % 300) >= 12000",
    "a22_image_budget": """with p as (select l_orderkey % 100 as doc_id, l_partkey % 40 as h, l_orderkey as page, l_linenumber as place from lineitem), f as (select doc_id, h, min((page, place)) as o from p group by all),
        r as (select *, row_number() over (partition by doc_id order by o, h) as n from f) select p.doc_id, count(distinct p.h) as n_images, count(*) as n from p join r on r.doc_id = p.doc_id and r.h = p.h and r.n <= 5 group by 1""",
    "x8_index_entries": """with s as (select doc_id, text, unnest(case when length(text) <= 1400 then [1] else range(1, greatest(1, length(text) - 150) + 1, 1250) end) as start from documents)
        select doc_id, start::int as start, (length(substr(text, start, 1400)) + 10)::int as n from s""",
    "x10_answer_images": """with e as (select user_id % 20 as doc_id, event_id % 3 as figure_id, event_id, event_id % 4 as ev from events where event_type = 'view')
        select doc_id, figure_id, min(event_id) as ordinal, string_agg(distinct ev::varchar, ',' order by ev::varchar) as evidence_ids from e group by 1, 2 order by ordinal, doc_id, figure_id limit 12""",
    "o6_page_order": "select event_id, row_number() over (partition by user_id % 20, event_id % 3 order by event_id * 31 % 97, event_id * 17 % 89, event_type != 'view', event_id)::int as place from events",
    "d17_sweep": f"""with {bind.CHUNKS}, {NEAR}, k as (select c.* from chunks c join documents d on d.doc_id = c.id), s as (select doc_id, 1 / (1 + distance) as score from near where chunk_index = 0 and id in (select id from k) order by distance, id limit 20),
        d as (select doc_id from (select doc_id, max(score) as m from s group by 1) where m >= 0.3 * (select max(score) from s)) select id, doc_id, chunk_index from k where doc_id in (select doc_id from d) and chunk_index < 5""",
    "d18_candidates": f"""with {bind.CHUNKS}, {NEAR}, a as (select doc_id, max(1 / (1 + distance)) as score from (select * from near order by distance, id limit 40) group by 1), b as (select doc_id, (n_chars % 1009)::double as score from documents order by score desc, doc_id limit 40),
        r as (select doc_id, row_number() over (order by score desc, doc_id) as k from a union all select doc_id, row_number() over (order by score desc, doc_id) from b), f as (select doc_id, sum(1.0 / (60 + k)) as score from r group by 1)
        select doc_id, round(score, 6) as score from f where score >= 0.3 * (select max(score) from f)""",
    "b1_store": "select n_nationkey, case when n_nationkey < 10 then 'early' else 'late' end as kind, n_nationkey < 10 as has_id from nation where n_regionkey != 2",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
