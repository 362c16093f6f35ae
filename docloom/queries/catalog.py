"""Catalog, aggregates, set operations, de-duplication, joins and graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import aggregates as G
from docloom.operators import graph as M
from docloom.operators import sets as S
from docloom.queries import bind


def g1_category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.category_summary(bind.catalog(spark, sf))


def g2_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.type_counts(bind.catalog(spark, sf))


def g3_group_usage(spark: SparkSession, sf: str) -> DataFrame:
    return G.group_usage(bind.catalog(spark, sf))


def g4_orphan_groups(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("g0",), ("g1",), ("h1",)], "acl_group string")
    return G.orphan_groups(bind.catalog(spark, sf), known)


def g5_strategy_stats(spark: SparkSession, sf: str) -> DataFrame:
    """G5, H5."""
    s = G.strategy_stats(bind.memory(spark, sf))
    return s.select("pattern", "strategy", "n", *[F.round(c, 4).alias(c) for c in ("avg_cited", "avg_relevant", "composite", "margin")])


def g6_metrics_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events")
    m = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_type") == "view").alias("cache_hit"), F.col("value").alias("seconds"), (F.col("user_id") % 9).alias("n_docs"))
    return G.metrics_dashboard(m)


def g7_feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.feedback_stats(bind.feedback(spark, sf))


def g8_memory_stats(spark: SparkSession, sf: str) -> DataFrame:
    return G.memory_stats(bind.memory(spark, sf))


def g9_precision(spark: SparkSession, sf: str) -> DataFrame:
    f = bind.feedback(spark, sf).groupBy("doc_id").agg(F.count_if("was_relevant").alias("rel"), F.count_if(F.col("id") % 2 == 0).alias("read"))
    return f.select("doc_id", G.precision(F.col("rel"), F.col("read")).alias("map_precision"))


def g10_dominant_tier(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events").select((F.col("user_id") % 30).alias("k"), "event_type", "event_id")
    return G.dominant(e, ["k"], "event_type", "event_id")


def g15_merged_lists(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("roles"), F.col("text").alias("summary"))
    out = G.merged_lists(t, ["conv_id"], ["roles"], "turn")
    return out.select("conv_id", F.concat_ws(",", "roles").alias("roles"), F.length("summary").alias("n"))


def g18_line_statistics(spark: SparkSession, sf: str) -> DataFrame:
    d = bind.table(spark, sf, "documents").select("doc_id", G.line_statistics(F.col("text")).alias("s"))
    return d.select("doc_id", "s.n", F.round("s.mean_length", 3).alias("mean_length"), "s.n_short", "s.n_long", "s.n_chars")


def g19_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))  # an order's lines
    return e.select("l_orderkey", G.upper_median(F.col("v")).alias("med"))


def g22_evidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations").select(F.monotonically_increasing_id().alias("id"), F.concat_ws(",", "role", F.when(F.col("turn") % 2 == 0, "steps")).alias("evidence_role"))
    return G.evidence_coverage(t, ["steps", "user", "warnings"])


def i3_union_first_order(spark: SparkSession, sf: str) -> DataFrame:
    d = bind.catalog(spark, sf)
    a = d.filter("doc_id % 3 = 0").select("doc_id", F.col("doc_id").alias("pos"))
    b = d.filter("doc_id % 2 = 0").select("doc_id", (F.lit(100000) - F.col("doc_id")).alias("pos"))
    return S.ordered_union([a, b], "doc_id", "pos")


def i4_extra_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = bind.catalog(spark, sf).select("doc_id")
    return d.join(bind.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(20)


def i5_intersection(spark: SparkSession, sf: str) -> DataFrame:
    d = bind.catalog(spark, sf)
    return d.filter("dataset_id = 2").select("doc_id").intersect(d.filter(F.array_contains("acl_groups", "g1")).select("doc_id"))


def i6_duplicate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Copies by content hash, and the first of them."""
    d = bind.catalog(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return S.first_by_hash(d, "content_hash", "doc_id")


def i8_edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.edges(spark, sf)
    return e.unionByName(e.filter("relation_type = 'part_of'")).dropDuplicates(["source", "target", "relation_type"]).groupBy("relation_type").agg(F.count("*").alias("n"))


def i10_unique_text(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations")
    return S.keep_first(t, ["text"], ["conv_id", "turn"]).select("conv_id", "turn")


def i12_sorted_key_dedup(spark: SparkSession, sf: str) -> DataFrame:
    p = bind.table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.split(F.lower("p_name"), " ")), " ").alias("k"))
    return p.groupBy("k").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey")


def e1_active_keys(spark: SparkSession, sf: str) -> DataFrame:
    c, o = bind.table(spark, sf, "customer"), bind.table(spark, sf, "orders")
    live = o.filter("o_orderstatus = 'O'").join(c.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return live.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def e2_orphan_entities(spark: SparkSession, sf: str) -> DataFrame:
    """E2, M11."""
    return M.orphans(bind.entities(spark, sf), bind.edges(spark, sf).filter("relation_type = 'lives_in'").select(F.col("target").alias("node")))


def e4_orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct documents of chunks that the catalog lacks."""
    c = bind.chunks(spark, sf).select("doc_id").distinct()
    return c.join(bind.catalog(spark, sf).filter("doc_id % 4 = 1").select("doc_id"), "doc_id", "left_anti")


def b13_purge_plan(spark: SparkSession, sf: str) -> DataFrame:
    meta, chunk = bind.catalog(spark, sf).filter("doc_id % 4 = 1").select("doc_id"), bind.chunks(spark, sf).select("doc_id")
    return S.purge_plan(meta, chunk, False)


def e6_described_edges(spark: SparkSession, sf: str) -> DataFrame:
    return M.described(bind.edges(spark, sf), bind.entities(spark, sf))


def e7_entity_details(spark: SparkSession, sf: str) -> DataFrame:
    """E7, M4."""
    return M.entity_details(bind.edges(spark, sf), bind.entities(spark, sf), "n3")


def m3_k_hop(spark: SparkSession, sf: str) -> DataFrame:
    """M3, E8."""
    seeds = spark.createDataFrame([("s1",), ("s2",)], "node string")
    return M.k_hop(bind.edges(spark, sf), seeds, 3).groupBy("hop").agg(F.count("*").alias("n"))


def m3_k_hop_types(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("r0",)], "node string")
    return M.k_hop(bind.edges(spark, sf), seeds, 2, ["part_of", "based_in"])


def m5_merged(spark: SparkSession, sf: str) -> DataFrame:
    """M5, I8."""
    mapping = bind.entities(spark, sf).filter("entity_type = 'nation'").select(F.col("node").alias("remove"), F.lit("n0").alias("keep")).filter("remove in ('n1', 'n2', 'n3')")
    return M.merged(bind.edges(spark, sf).filter("relation_type != 'placed_by'"), mapping)


def m9_view(spark: SparkSession, sf: str) -> DataFrame:
    return M.view(bind.entities(spark, sf), bind.edges(spark, sf).select(F.col("target").alias("node")).unionByName(bind.edges(spark, sf).select(F.col("source").alias("node"))))


def m2_c22_induced(spark: SparkSession, sf: str) -> DataFrame:
    """M2, C22."""
    return M.induced(bind.edges(spark, sf), bind.entities(spark, sf).filter("entity_type in ('nation', 'region')").select("node"))


def _spelled(brand: Column) -> Column:
    """A brand in one of four spellings, by its part's number."""
    loose = lambda sign: F.replace(brand, F.lit("#"), F.lit(sign))
    k = F.col("p_partkey") % 4
    return F.when(k == 0, loose("-")).when(k == 1, loose(" ")).when(k == 2, F.upper(loose(" "))).otherwise(F.lower(loose(".")))


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entities that bear a spelling of their brand."""
    return bind.table(spark, sf, "part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("node"), _spelled(F.col("p_brand")).alias("name"), F.col("p_type").alias("entity_type"))


def m6_merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of a type's spellings within the limit of length, each by its least node: merged at once, or for a judge."""
    return M.merge_candidates(_brands(spark, sf), blocked=False).select("keep", "remove", "outcome")


def m6_name_classes(spark: SparkSession, sf: str) -> DataFrame:
    """M6: which of these least nodes stands for a node."""
    return M.name_classes(_brands(spark, sf)).select("node", "keep")


def _firms(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as firms in five spellings: short, long, an acronym's words, the acronym, and one with blanks around it."""
    k = F.translate(F.md5(F.col("s_suppkey").cast("string").cast("binary")), "0123456789", "ghijklmnop")
    own = lambda i, n=7: F.substring(k, i, n)
    words = F.concat_ws(" ", *[F.initcap(own(1 + 5 * i, 2)) for i in range(4)])
    spelled = F.array(F.concat(F.lit("s"), own(1, 9)), F.concat(F.lit("S"), own(1, 9), F.lit(" Ltd")), words, F.upper(F.concat(*[own(1 + 5 * i, 1) for i in range(4)])), F.concat(F.lit("  S"), own(1, 9), F.lit(" ltd ")))
    s = bind.table(spark, sf, "supplier").select("s_suppkey", F.posexplode(spelled).alias("form", "name"))
    return s.select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("-"), F.col("form").cast("string")).alias("node"), "name", (F.col("s_suppkey") % 5).cast("string").alias("entity_type"))


def _judge(a: str, b: str, kind: str) -> dict:
    """A judge that SQL can follow: a name that goes on is most likely the same, an acronym perhaps."""
    x, y = sorted((a.strip().lower(), b.strip().lower()), key=len)
    if y.startswith(x + " "):
        return {"is_same": True, "confidence": 0.95, "reason": "goes on"}
    if x == "".join(w[0] for w in y.split()):
        return {"is_same": True, "confidence": 0.8, "reason": "initials"}
    return {"is_same": False, "confidence": 0.99}


def m6_judged(spark: SparkSession, sf: str) -> DataFrame:
    """M6: proposals for firms' spellings: the same but for case, judged to be the same, and left for review."""
    return M.reconciled(_firms(spark, sf), _judge).select("keep", "remove", "confidence", "status")


def c16_entity_search(spark: SparkSession, sf: str) -> DataFrame:
    return M.search(bind.entities(spark, sf), "tIoN_1", "nation")


def i9_resolved_entities(spark: SparkSession, sf: str) -> DataFrame:
    """I9, M1."""
    m = bind.table(spark, sf, "part").select(F.col("p_brand").alias("b"), "p_partkey", F.col("p_type").alias("entity_type"))
    m = m.select(F.when(F.col("p_partkey") % 3 == 0, F.lower("b")).when(F.col("p_partkey") % 3 == 1, F.replace("b", F.lit("#"), F.lit("-"))).otherwise(F.col("b")).alias("name"), "entity_type", F.col("p_partkey").alias("doc_id"))
    return M.resolve_entities(m)


def x16_documents_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    sets = spark.createDataFrame([(i, f"set {i}") for i in range(8)], "dataset_id long, name string")
    counts = bind.catalog(spark, sf).groupBy("dataset_id").agg(F.count("*").alias("n"))
    return sets.join(counts, "dataset_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_docs"))


def x15_add_groups(spark: SparkSession, sf: str) -> DataFrame:
    return bind.catalog(spark, sf).select("doc_id", F.concat_ws(",", F.array_union("acl_groups", F.array(F.lit("g1"), F.lit("new")))).alias("acl_groups"))


def b4_acl_sync(spark: SparkSession, sf: str) -> DataFrame:
    chunk = bind.chunks(spark, sf).select("id", "doc_id", "acl_groups")
    return S.synchronise_acl(chunk, bind.catalog(spark, sf).select("doc_id", "acl_groups")).select("id", F.concat_ws(",", "acl_groups").alias("acl_groups"), "changed")


def b6_merge_replace(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.chunks(spark, sf).select("id", "doc_id", "label")
    staged = t.filter("doc_id = 3 and chunk_index < 5").withColumn("label", F.col("label") + 100)
    return S.replace_document(t, staged, "doc_id", 3)


def b9_cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = bind.catalog(spark, sf).filter("doc_id % 10 = 3").select("doc_id")
    kept = S.cascade_delete({"documents": bind.catalog(spark, sf).select("doc_id"), "labels": bind.table(spark, sf, "labels").select("doc_id")}, gone)
    return kept["documents"].withColumn("t", F.lit("documents")).unionByName(kept["labels"].withColumn("t", F.lit("labels"))).groupBy("t").agg(F.count("*").alias("n"))


def b11_upsert(spark: SparkSession, sf: str) -> DataFrame:
    n = bind.table(spark, sf, "nation").select("n_nationkey", "n_name")
    new = n.filter("n_nationkey < 3").withColumn("n_name", F.lower("n_name"))
    return S.upsert(n, new, ["n_nationkey"])


def c13_category_listing(spark: SparkSession, sf: str) -> DataFrame:
    c = bind.catalog(spark, sf)
    return c.filter(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("uncategorized")) == "uncategorized").select("doc_id", "filename", "doc_type")


def c14_unique_filename(spark: SparkSession, sf: str) -> DataFrame:
    return S.unique_by(bind.catalog(spark, sf), "filename").select("doc_id", "filename")


def e3_left_right_full(spark: SparkSession, sf: str) -> DataFrame:
    d, l = bind.catalog(spark, sf).filter("doc_id % 2 = 0").select("doc_id", "lang"), bind.table(spark, sf, "labels")
    return d.join(l, "doc_id", "full").groupBy(F.col("lang").isNull().alias("no_doc"), F.col("quality").isNull().alias("no_label")).agg(F.count("*").alias("n"))


def e27_as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    """E27."""
    e = bind.table(spark, sf, "events").select("user_id", "ts", "event_type", "event_id")
    return S.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "ts", "event_id").select("event_id", "right_event_id")


def g20_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    """G20."""
    scores = bind.table(spark, sf, "events").select(M.verdict((F.col("event_id") % 100) / 100.0).alias("outcome"))
    return scores.groupBy("outcome").agg(F.count("*").alias("n"))


def h14_step_times(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events")
    return S.deltas(e, ["user_id"], "ts", "event_id").select("event_id", "seconds")


def d27_recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    """D27."""
    return bind.table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


REACH = "select distinct x.v from r join both_ways x on x.u = r.n"
ORACLE_SQL = {
    "g1_category_summary": f"with {bind.CATALOG} select coalesce(nullif(category, ''), 'uncategorized') as category, count(*) as n_docs, case when count(distinct doc_type) = 1 then min(doc_type) else 'mixed' end as kind from catalog group by 1",
    "g2_type_counts": f"with {bind.CATALOG} select doc_type, count(*) as n_docs from catalog group by 1",
    "g3_group_usage": f"with {bind.CATALOG} select acl_group, count(*) as n_docs from (select unnest(acl_groups) as acl_group from catalog) group by 1",
    "g4_orphan_groups": f"with {bind.CATALOG} select distinct acl_group from (select unnest(acl_groups) as acl_group from catalog) where acl_group not in ('ALL', 'g0', 'g1', 'h1')",
    "g5_strategy_stats": f"""with {bind.MEMORY}, s as (select pattern, strategy, count(*) as n, avg(cited) as c, avg(relevant) as r, avg(cited) + 0.001 * avg(relevant) as k from memory group by all),
        o as (select *, row_number() over w as p, lead(k) over w as nx from s window w as (partition by pattern order by k desc, strategy))
        select pattern, strategy, n, round(c, 4) as avg_cited, round(r, 4) as avg_relevant, round(k, 4) as composite, round(k - coalesce(nx, 0), 4) as margin from o where p = 1""",
    "g6_metrics_dashboard": """with m as (select event_type = 'view' as hit, value, user_id % 9 as d from events order by ts desc, event_id desc limit 50)
        select count(*) as n, count(case when hit then 1 end) as cache_hits, round(avg(case when not hit then value end), 4) as avg_seconds, round(avg(case when not hit then d end), 4) as avg_docs from m""",
    "g7_feedback_stats": f"""with {bind.FEEDBACK} select count(*) as n, count(case when was_cited then 1 end) as n_cited, count(case when was_relevant and not was_cited then 1 end) as n_relevant,
        count(case when not was_relevant and not was_cited then 1 end) as n_irrelevant, count(distinct query_hash) as n_queries, count(distinct doc_id) as n_docs from feedback""",
    "g8_memory_stats": f"with {bind.MEMORY} select (select count(distinct pattern) from memory) as n_patterns, (select strategy from memory group by strategy order by count(*) desc, strategy limit 1) as top_strategy",
    "g9_precision": f"with {bind.FEEDBACK} select doc_id, coalesce(round(count(case when was_relevant then 1 end) / nullif(count(case when id % 2 = 0 then 1 end), 0), 3), 0.0) as map_precision from feedback group by doc_id",
    "g10_dominant_tier": "with c as (select user_id % 30 as k, event_type, count(*) as n, min(event_id) as f from events group by all), r as (select *, row_number() over (partition by k order by n desc, f) as p from c) select k, event_type from r where p = 1",
    "g15_merged_lists": """with f as (select conv_id, role, min(turn) as t from conversations group by all), l as (select conv_id, max(length(text)) as n from conversations group by all)
        select conv_id, string_agg(role, ',' order by t) as roles, any_value(n) as n from f join l using (conv_id) group by conv_id""",
    "g18_line_statistics": """with s as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != '') as l from documents),
        z as (select doc_id, list_transform(l, lambda x: length(x)) as z from s)
        select doc_id, len(z)::int as n, round(coalesce(list_avg(z), 0), 3) as mean_length, len(list_filter(z, lambda x: x < 40))::int as n_short, len(list_filter(z, lambda x: x >= 55))::int as n_long, coalesce(list_sum(z), 0)::int as n_chars from z""",
    "g19_upper_median": "select l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as med from lineitem group by 1",
    "g22_evidence_coverage": """with r as (select role from conversations union all select 'steps' from conversations where turn % 2 = 0), w as (select * from (values ('steps', 0), ('user', 1), ('warnings', 2)) t(role, place))
        select role, place, count(r.role) as n_chunks, count(r.role) = 0 as missing from w left join r using (role) group by role, place""",
    "i3_union_first_order": "select doc_id, case when doc_id % 3 = 0 then 0 else 1 end as list_no, case when doc_id % 3 = 0 then doc_id else 100000 - doc_id end as pos from documents where doc_id % 3 = 0 or doc_id % 2 = 0",
    "i4_extra_documents": "select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 20",
    "i5_intersection": f"with {bind.CATALOG} select doc_id from catalog where dataset_id = 2 intersect select doc_id from catalog where list_contains(acl_groups, 'g1')",
    "i6_duplicate_documents": "with d as (select doc_id, sha256(text) as content_hash from documents) select d.doc_id, m.first_id from d join (select content_hash, min(doc_id) as first_id from d group by 1) m using (content_hash) where d.doc_id != m.first_id",
    "i8_edge_dedup": f"with {bind.EDGES} select relation_type, count(*) as n from (select distinct * from edges) group by 1",
    "i10_unique_text": "select conv_id, turn from (select *, row_number() over (partition by text order by conv_id, turn) as p from conversations) where p = 1",
    "i12_sorted_key_dedup": "select min(p_partkey) as p_partkey from part group by array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ')",
    "e1_active_keys": "select c_mktsegment, count(*) as n from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' and c_acctbal > 0 group by 1",
    "e2_orphan_entities": f"with {bind.EDGES}, {bind.ENTITIES} select * from entities where node not in (select target from edges where relation_type = 'lives_in')",
    "e4_orphan_chunks": f"with {bind.CHUNKS} select distinct doc_id from chunks where doc_id not in (select doc_id from documents where doc_id % 4 = 1)",
    "b13_purge_plan": f"with {bind.CHUNKS} select 'ok' as status, count(distinct doc_id) as n_orphans from chunks where doc_id not in (select doc_id from documents where doc_id % 4 = 1)",
    "e6_described_edges": f"with {bind.EDGES}, {bind.ENTITIES} select e.*, s.name as source_name, t.name as target_name from edges e join entities s on s.node = e.source join entities t on t.node = e.target",
    "e7_entity_details": f"""with {bind.EDGES}, {bind.ENTITIES}, l as (select target as other, relation_type, 'outgoing' as direction from edges where source = 'n3' union all select source, relation_type, 'incoming' from edges where target = 'n3')
        select other, relation_type, direction, coalesce(name, 'unknown') as name from l left join entities on node = other""",
    "m3_k_hop": f"""with {bind.EDGES}, b as (select source as u, target as v from edges union select target, source from edges),
        h0 as (select unnest(['s1', 's2']) as n), h1 as (select distinct v as n from b join h0 on u = n where v not in (select n from h0)),
        h2 as (select distinct v as n from b join h1 on u = n where v not in (select n from h0 union all select n from h1)),
        h3 as (select distinct v as n from b join h2 on u = n where v not in (select n from h0 union all select n from h1 union all select n from h2))
        select 0 as hop, count(*) as n from h0 union all select 1, count(*) from h1 union all select 2, count(*) from h2 union all select 3, count(*) from h3""",
    "m3_k_hop_types": f"""with {bind.EDGES}, b as (select source as u, target as v from edges where relation_type in ('part_of', 'based_in') union select target, source from edges where relation_type in ('part_of', 'based_in')),
        h1 as (select distinct v as n from b where u = 'r0'), h2 as (select distinct v as n from b join h1 on u = n where v != 'r0' and v not in (select n from h1))
        select 'r0' as node, 0 as hop union all select n, 1 from h1 union all select n, 2 from h2""",
    "m5_merged": f"with {bind.EDGES}, k as (select case when source in ('n1', 'n2', 'n3') then 'n0' else source end as source, case when target in ('n1', 'n2', 'n3') then 'n0' else target end as target, relation_type from edges where relation_type != 'placed_by') select distinct * from k where source != target",
    "m9_view": f"with {bind.EDGES}, {bind.ENTITIES}, c as (select node, count(*) as n from (select target as node from edges union all select source from edges) group by 1) select e.*, coalesce(n, 0) as n_mentions, least(60, greatest(20, 20 + 5 * coalesce(n, 0)))::bigint as size from entities e left join c using (node)",
    "m2_c22_induced": f"with {bind.EDGES} select source, target, relation_type from edges where relation_type = 'part_of'",
    "m6_merge_candidates": r"""with p as (select 'p' || lpad(p_partkey::varchar, 8, '0') as node, case p_partkey % 4 when 0 then replace(p_brand, '#', '-') when 1 then replace(p_brand, '#', ' ') when 2 then upper(replace(p_brand, '#', ' ')) else lower(replace(p_brand, '#', '.')) end as name, p_type as t from part), c as (select min(node) as node, name, t from p group by name, t),
        b as (select *, length(name) as l, lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) as k from c)
        select x.node as keep, y.node as remove, case when x.k = y.k then 'auto' else 'judge' end as outcome from b x join b y on x.t = y.t and x.node < y.node and abs(x.l - y.l) <= 0.7::double * greatest(x.l, y.l)""",
    "m6_name_classes": """with p as (select 'p' || lpad(p_partkey::varchar, 8, '0') as node, case p_partkey % 4 when 0 then replace(p_brand, '#', '-') when 1 then replace(p_brand, '#', ' ') when 2 then upper(replace(p_brand, '#', ' ')) else lower(replace(p_brand, '#', '.')) end as name, p_type as t from part)
        select node, min(node) over (partition by name, t) as keep from p where name is not null and t is not null""",
    "m6_judged": r"""with m as (select lpad(s_suppkey::varchar, 6, '0') as s, (s_suppkey % 5)::varchar as t, translate(md5(s_suppkey::varchar), '0123456789', 'ghijklmnop') as k from supplier),
        f as (select s, t, form, case form when 0 then 's' || k[1:9] when 1 then 'S' || k[1:9] || ' Ltd' when 3 then upper(k[1] || k[6] || k[11] || k[16]) when 4 then '  S' || k[1:9] || ' ltd '
            else list_aggregate(list_transform(range(4), lambda i: upper(k[5 * i + 1]) || k[5 * i + 2]), 'string_agg', ' ') end as name, s || '-' || form as node from m, (select unnest(range(5)) as form)),
        c as (select min(node) as node, name, t from f group by name, t),
        p as (select a.node as keep, b.node as remove, lower(trim(a.name)) as x, lower(trim(b.name)) as y, length(a.name) as la, length(b.name) as lb from c a join c b on a.t = b.t and a.node < b.node),
        o as (select *, case when length(x) <= length(y) then x else y end as u, case when length(x) <= length(y) then y else x end as v from p where abs(la - lb) <= 0.7 * greatest(la, lb)),
        j as (select keep, remove, case when x = y then 1.0::double when starts_with(v, u || ' ') then 0.95::double when u = array_to_string(list_transform(string_split(v, ' '), lambda w: w[1]), '') then 0.8::double end as confidence from o)
        select keep, remove, confidence, case when confidence >= 0.9 then 'auto_merged' else 'pending' end as status from j where confidence is not null""",
    "c16_entity_search": f"with {bind.ENTITIES} select * from entities where contains(lower(name), 'tion_1') and entity_type = 'nation'",
    "i9_resolved_entities": """with m as (select case p_partkey % 3 when 0 then lower(p_brand) when 1 then replace(p_brand, '#', '-') else p_brand end as name, p_type as entity_type, p_partkey as d from part),
        k as (select *, trim(regexp_replace(lower(name), '[.\\-\\s]+', ' ', 'g')) as canonical from m)
        select canonical, entity_type, arg_max(name, (length(name), length(regexp_replace(name, '[^A-Z]', '', 'g')), name)) as name, min(d) as first_doc, count(*) as n_mentions, count(distinct name) as n_names from k group by 1, 2""",
    "x16_documents_per_dataset": "select 'set ' || i as name, (select count(*) from documents where doc_id % 5 = i) as n_docs from range(8) t(i)",
    "x15_add_groups": f"with {bind.CATALOG} select doc_id, array_to_string(list_filter(acl_groups, lambda x: true) || list_filter(['g1', 'new'], lambda x: not list_contains(acl_groups, x)), ',') as acl_groups from catalog",
    "b4_acl_sync": f"with {bind.CATALOG}, {bind.CHUNKS} select id, array_to_string(coalesce(k.acl_groups, c.acl_groups), ',') as acl_groups, k.acl_groups is not null and list_sort(list_distinct(k.acl_groups)) != list_sort(list_distinct(c.acl_groups)) as changed from chunks c left join catalog k using (doc_id)",
    "b6_merge_replace": f"with {bind.CHUNKS} select id, doc_id, label from chunks where doc_id != 3 union all select id, doc_id, label + 100 from chunks where doc_id = 3 and chunk_index < 5",
    "b9_cascade_delete": "select 'documents' as t, count(*) as n from documents where doc_id % 10 != 3 union all select 'labels', count(*) from labels where doc_id % 10 != 3",
    "b11_upsert": "select n_nationkey, case when n_nationkey < 3 then lower(n_name) else n_name end as n_name from nation",
    "c13_category_listing": f"with {bind.CATALOG} select doc_id, filename, doc_type from catalog where category = ''",
    "c14_unique_filename": f"with {bind.CATALOG} select min(doc_id) as doc_id, filename from catalog group by filename having count(*) = 1",
    "e3_left_right_full": "select d.doc_id is null as no_doc, l.quality is null as no_label, count(*) as n from (select doc_id from documents where doc_id % 2 = 0) d full join labels l using (doc_id) group by all",
    "e27_as_of_join": """with p as (select * from events where event_type = 'purchase'), v as (select * from events where event_type = 'view'),
        m as (select p.event_id, v.event_id as r, row_number() over (partition by p.event_id order by v.ts desc, v.event_id desc) as k from p left join v on v.user_id = p.user_id and v.ts <= p.ts)
        select event_id, r as right_event_id from m where k = 1""",
    "g20_outcome_counts": "select case when event_id % 100 >= 90 then 'auto' when event_id % 100 >= 70 then 'propose' else 'reject' end as outcome, count(*) as n from events group by 1",
    "h14_step_times": "select event_id, round(epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)), 3) as seconds from events",
    "d27_recent_activity": "select event_id, event_type from events order by ts desc, event_id desc limit 10",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
