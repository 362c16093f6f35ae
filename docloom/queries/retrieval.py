"""Access, ranking, fusion, cut-offs, boosts and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import access, retrieval as R
from docloom.queries import bind

QUESTION = "the thing and onre with ouand tion"
GROUPS = ["g1", "g2"]
TERMS = ["the", "tion", "onre", "worthless", "enlich"]


def c1_acl_filter(spark: SparkSession, sf: str) -> DataFrame:
    return access.acl_filter(bind.catalog(spark, sf), GROUPS).select("doc_id", "filename")


def c1_acl_all(spark: SparkSession, sf: str) -> DataFrame:
    return access.acl_filter(bind.catalog(spark, sf), ["ALL"]).groupBy("doc_type").agg(F.count("*").alias("n"))


def c1_acl_none(spark: SparkSession, sf: str) -> DataFrame:
    return access.acl_filter(bind.catalog(spark, sf), []).select("doc_id")


def c3_catalog_literal_all(spark: SparkSession, sf: str) -> DataFrame:
    return access.acl_filter(bind.catalog(spark, sf), ["ALL"], literal_all=True).select("doc_id")


def x12_strict_original(spark: SparkSession, sf: str) -> DataFrame:
    return access.acl_filter(bind.catalog(spark, sf), ["ALL", "h3"], strict=True).select("doc_id")


def c2_scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    """C2, E9."""
    return access.scope_filter(bind.chunks(spark, sf), ["g1", "g3"], "medium", [2, 4, 6, 13, 30]).select("id", "doc_id", "chunk_index")


def c21_graph_paths(spark: SparkSession, sf: str) -> DataFrame:
    c = bind.catalog(spark, sf).select("doc_id", F.concat_ws("<SEP>", "filename", F.concat(F.lit("doc-"), (F.col("doc_id") * 3) % 400, F.lit(".txt"))).alias("path"))
    allowed = [f"doc-{i}.txt" for i in range(0, 400, 2)]
    return c.filter(access.graph_paths_allowed(F.col("path"), allowed)).select("doc_id")


def c21_allowed_filenames(spark: SparkSession, sf: str) -> DataFrame:
    return access.allowed_filenames(bind.catalog(spark, sf), ["g0", "g1", "h2"])


def d1_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = access.scope_filter(bind.chunks(spark, sf), ["g0", "g1"], "medium")
    return R.vector_topk(rows, bind.query_vector(spark, sf), 10).select("id", F.round("distance", 4).alias("distance"), F.round("score", 4).alias("score"))


def d4_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents by BM25, from the term index."""
    return bind.index(spark, sf).search(QUESTION, 20).select("doc_id", F.round("score", 4).alias("score"))


def d4_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings: how many documents have a term, and how often."""
    return R.postings(bind.catalog(spark, sf), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).filter("df >= 5")


def d5_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists, fused."""
    c = bind.chunks(spark, sf)
    near = R.ranked(R.vector_topk(c, bind.query_vector(spark, sf), 20), [F.col("distance"), F.col("id")])
    other = R.ranked(R.vector_topk(c, bind.query_vector(spark, sf, 11), 20), [F.col("distance"), F.col("id")])
    return R.rrf([near, other]).select("id", F.round("score", 6).alias("score"))


def d2_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind.catalog(spark, sf).select(F.col("doc_id").alias("id"), "text", "acl_groups")
    rows = bind.chunks(spark, sf).select("id", "vector").join(access.acl_filter(docs, GROUPS), "id")
    return R.hybrid(rows, bind.query_vector(spark, sf), QUESTION, 10).select("id", F.round("score", 6).alias("score"))


def d7_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 30)
    return R.rerank(rows, (F.col("id") % 13).cast("double"), 10).select("id", F.round("score", 4).alias("score"))


def d10_cosine(spark: SparkSession, sf: str) -> DataFrame:
    c = bind.chunks(spark, sf)
    return c.select("id", F.round(V.cosine(F.col("vector"), V.literal(bind.query_vector(spark, sf))), 4).alias("sim"))


def d6_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return R.normalised(R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 30)).select("id", F.round("relevance", 4).alias("relevance"))


def c7_relative_cut(spark: SparkSession, sf: str) -> DataFrame:
    return R.relative_cut(R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 100), 0.05).select("id")


def c8_evidence_cut(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 60).withColumn("fake", F.col("id") % 9 == 0)
    return R.evidence_cut(rows, "fake").select("id")


def d11_feedback_boosts(spark: SparkSession, sf: str) -> DataFrame:
    """D11, G14, P5."""
    return _boosts(spark, sf).select("doc_id", F.round("boost", 4).alias("boost"))


def _boosts(spark: SparkSession, sf: str) -> DataFrame:
    vectors = bind.table(spark, sf, "embeddings").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    log = bind.feedback(spark, sf).join(vectors, "q")
    return R.feedback_boosts(log, bind.query_vector(spark, sf), F.lit("2024-12-31 00:00:00").cast("timestamp"), least=0.05)


def c9_d12_boosted(spark: SparkSession, sf: str) -> DataFrame:
    boosts = _boosts(spark, sf)
    rows = R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 100)
    return R.apply_boosts(R.drop_negative(rows, boosts), boosts).select("id", F.round("score", 3).alias("score"))


def d14_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = bind.table(spark, sf, "conversations")
    return c.filter("role = 'user'").select("conv_id", "turn", F.explode(X.query_terms(F.col("text"))).alias("term"))


def d15_term_idf(spark: SparkSession, sf: str) -> DataFrame:
    """D15, G13."""
    blobs = bind.catalog(spark, sf).select(F.lower("text").alias("blob"))
    return R.term_idf(TERMS, blobs).select("term", "df", F.round("idf", 6).alias("idf"))


def d16_match_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind.catalog(spark, sf).select("doc_id", F.lower("text").alias("blob"))
    idf = {r["term"]: r["idf"] for r in R.term_idf(TERMS, docs).collect()}  # a row for each term of the question
    return docs.select("doc_id", F.round(R.match_score(idf, F.col("blob")), 4).alias("score")).filter("score > 0")


def d13_prf_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind.catalog(spark, sf).filter("doc_id < 5").select(F.col("doc_id").alias("pos"), R.tokens(F.col("text")).alias("topics"))
    return R.prf_terms(docs, ["topics"], "the and with")


def h1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """H1, E10."""
    c = bind.chunks(spark, sf)
    seeds = R.vector_topk(c, bind.query_vector(spark, sf), 8).drop("distance")
    return R.neighbours(seeds, c, 2).select("id", "doc_id", "chunk_index", F.round("score", 4).alias("score"))


def e12_figure_pages(spark: SparkSession, sf: str) -> DataFrame:
    """E12, H3."""
    c = bind.chunks(spark, sf).select("id", "doc_id", (F.col("chunk_index") + 1).alias("page"))
    anchors = c.filter("id % 23 = 0").select("doc_id", "page")
    return R.figure_pages(anchors, c)


def h2_greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a section that fit a budget, in order; one that does not is skipped."""
    d = bind.catalog(spark, sf).select(F.floor(F.col("doc_id") / 20).alias("section"), "doc_id", F.length("text").alias("n_chars_"))
    return R.greedy_budget(d, ["section"], ["doc_id"], "n_chars_", 8000)


def i1_keyed_union(spark: SparkSession, sf: str) -> DataFrame:
    c = bind.chunks(spark, sf).select("id", "doc_id", "chunk_index")
    return R.keyed_union(c.filter("id % 3 = 0"), c.filter("id % 2 = 0"), ["doc_id", "chunk_index"], ["id"])


def o4_per_document(spark: SparkSession, sf: str) -> DataFrame:
    return R.per_document(bind.chunks(spark, sf), 3, order=["chunk_index"]).select("id")


def o7_tier_fallback(spark: SparkSession, sf: str) -> DataFrame:
    c = bind.chunks(spark, sf).filter("doc_id % 3 != 0 or chunk_size_tier = 'medium'")
    return R.tier_fallback(c, ["large"]).select("id")


def o2_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page_of(bind.chunks(spark, sf).filter("chunk_size_tier = 'medium'"), ["doc_id", "chunk_index"], 20, 15).select("id", "has_more")


def c6_min_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.min_score(R.vector_topk(bind.chunks(spark, sf), bind.query_vector(spark, sf), 200), 0.012).select("id")


def d25_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Of the five nearest cached questions of this revision, the first that is near enough, for the same groups, and fresh."""
    cache = bind.chunks(spark, sf).withColumn("revision", F.col("id") % 2).withColumn("acl_key", F.to_json(F.array_sort(F.array_distinct("acl_groups")))).withColumn("age", F.col("id") * 10)
    near = R.vector_topk(cache.filter("revision = 1"), bind.query_vector(spark, sf), 5)
    fit = near.filter((F.col("score") >= 0.92) & (F.col("acl_key") == '["g0"]') & F.col("age").between(0, 3600))
    return fit.orderBy("distance", "id").limit(1).select("id", F.round("score", 4).alias("score"))


NEAR = """
 near as (select c.*, list_sum(list_transform(range(1, len(c.vector) + 1), lambda i: power(c.vector[i]::double - q.v[i]::double, 2))) as distance
          from chunks c, (select embedding as v from embeddings where vec_id = 7) q)"""


def _near(k: int, where: str = "true", more: str = "") -> str:
    return f"with {bind.CHUNKS}, {NEAR}, top as (select *, 1 / (1 + distance) as score from near where {where} order by distance, id limit {k}){more} "


BM25 = """
 tok as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x != '') as w from documents),
 terms as (select distinct unnest(regexp_split_to_array('the thing and onre with ouand tion', ' ')) as t),
 f as (select count(*) as n, avg(len(w)) as a from tok),
 tf as (select doc_id, t, len(w) as l, len(list_filter(w, lambda x: x = t)) as tf from tok, terms),
 df as (select t, count(*) as df from tf where tf > 0 group by t),
 bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) as score
        from tf join df using (t), f where tf > 0 group by doc_id)"""

BOOSTS = f"""with {bind.CHUNKS}, {bind.FEEDBACK},
 v as (select vec_id as q, embedding as x from embeddings),
 s as (select v.q, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: v.x[i]::double * z.x[i]::double))
        / sqrt(list_sum(list_transform(v.x, lambda y: y::double * y::double))) / sqrt(list_sum(list_transform(z.x, lambda y: y::double * y::double))) as sim
       from v, v z where z.q = 7),
 boosts as (select doc_id, sum(case when was_cited then 0.3 when was_relevant then 0.2 else -0.1 end
          * power(0.5, greatest(0, epoch(timestamp '2024-12-31' - date_trunc('second', created_at)) / 86400.0) / 90)) as boost
       from feedback join s using (q) where sim >= 0.05 group by doc_id)"""

ORACLE_SQL = {
    "c1_acl_filter": f"with {bind.CATALOG} select doc_id, filename from catalog where list_has_any(acl_groups, ['g1', 'g2'])",
    "c1_acl_all": f"with {bind.CATALOG} select doc_type, count(*) as n from catalog group by doc_type",
    "c1_acl_none": "select doc_id from documents where 1 = 0",
    "c3_catalog_literal_all": f"with {bind.CATALOG} select doc_id from catalog where list_has_any(acl_groups, ['ALL'])",
    "x12_strict_original": f"with {bind.CATALOG} select doc_id from catalog where list_has_any(acl_groups, ['h3'])",
    "c2_scope_filter": f"with {bind.CHUNKS} select id, doc_id, chunk_index from chunks where list_has_any(acl_groups, ['g1', 'g3']) and chunk_size_tier = 'medium' and doc_id in (2, 4, 6, 13, 30)",
    "c21_graph_paths": "select doc_id from documents where (doc_id % 5 = 0 or doc_id < 400) and doc_id % 2 = 0 and ((doc_id * 3) % 400) % 2 = 0",
    "c21_allowed_filenames": f"with {bind.CATALOG} select filename from catalog group by filename having bool_and(list_has_any(acl_groups, ['g0', 'g1', 'h2']))",
    "d1_vector_topk": _near(10, "list_has_any(acl_groups, ['g0', 'g1']) and chunk_size_tier = 'medium'") + "select id, round(distance, 4) as distance, round(score, 4) as score from top",
    "d4_bm25": f"with {BM25} select doc_id, round(score, 4) as score from bm order by bm.score desc, doc_id limit 20",
    "d4_postings": "with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x != '')) as term from documents) select term, count(distinct doc_id) as df, count(*) as n from t group by term having count(distinct doc_id) >= 5",
    "d5_rrf": f"""with {bind.CHUNKS}, n as (
        select q.vec_id as q, c.id, row_number() over (partition by q.vec_id order by list_sum(list_transform(range(1, len(c.vector) + 1), lambda i: power(c.vector[i]::double - q.embedding[i]::double, 2))), c.id) as r
        from chunks c, embeddings q where q.vec_id in (7, 11))
        select id, round(sum(1.0 / (60 + r)), 6) as score from n where r <= 20 group by id""",
    "d7_rerank": _near(30, more=""", head as (select *, (id % 13)::double as m from top order by score desc, id limit 10),
        b as (select min(m) as lo, max(m) as hi from head), rest as (select * from top where id not in (select id from head)), t as (select max(score) as x from rest)""")
    + "select id, round(x + 0.01 + (m - lo) / (hi - lo), 4) as score from head, b, t union all select id, round(score, 4) from rest",
    "d10_cosine": f"""with {bind.CHUNKS} select id, round(list_sum(list_transform(range(1, len(c.vector) + 1), lambda i: c.vector[i]::double * q.v[i]::double))
        / sqrt(list_sum(list_transform(c.vector, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(q.v, lambda x: x::double * x::double))), 4) as sim
        from chunks c, (select embedding as v from embeddings where vec_id = 7) q""",
    "d6_normalised": _near(30) + "select id, round(score / max(score) over (), 4) as relevance from top",
    "c7_relative_cut": _near(100) + "select id from (select id, score, max(score) over () as m from top) where score >= 0.05 * m",
    "c8_evidence_cut": _near(60) + "select id from (select id, score, id % 9 = 0 as fake, max(case when id % 9 != 0 then score end) over () as m, count(case when id % 9 != 0 then 1 end) over () as n from top) where fake or n <= 10 or score >= greatest(0.01, 0.1 * m) or score = 0",
    "d11_feedback_boosts": BOOSTS + " select doc_id, round(boost, 4) as boost from boosts",
    "c9_d12_boosted": BOOSTS + f""", {NEAR}, top as (select *, 1 / (1 + distance) as score from near order by distance, id limit 100)
        select id, round(score + coalesce(boost, 0), 3) as score from top left join boosts using (doc_id) where coalesce(boost, 0) >= 0""",
    "d14_query_terms": """with w as (select conv_id, turn, unnest(regexp_split_to_array(text, '\\s+')) as w from conversations where role = 'user'),
        b as (select conv_id, turn, lower(trim(w, '.,?!:;"''()')) as term from w)
        select distinct conv_id, turn, term from b where length(term) > 3 and term not in ('what','which','when','where','who','whom','whose','did','does','the','and','for','all','any','list','show','give','find','about','contract','contracts','award','awarded','awards')""",
    "d15_term_idf": """with t as (select unnest(['the', 'tion', 'onre', 'worthless', 'enlich']) as term), d as (select lower(text) as b from documents)
        select term, count(case when contains(b, term) then 1 end) as df, round(ln((count(*) + 1) / (count(case when contains(b, term) then 1 end) + 1)), 6) as idf from t, d group by term""",
    "d16_match_score": """with t as (select unnest(['the', 'tion', 'onre', 'worthless', 'enlich']) as term), d as (select doc_id, lower(text) as b from documents),
        i as (select term, ln((count(*) + 1) / (count(case when contains(b, term) then 1 end) + 1)) as idf from t, d group by term)
        select doc_id, round(sum(idf), 4) as score from d join i on contains(b, term) group by doc_id having round(sum(idf), 4) > 0""",
    "d13_prf_terms": """with w as (select doc_id as pos, generate_subscripts(x, 1) as ix, unnest(x) as term from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda y: y != '') as x from documents where doc_id < 5)),
        c as (select term, count(*) as n, min(pos * 1000000 + ix) as f1 from w where length(term) > 2 group by term order by n desc, f1 limit 20)
        select term, n from c where not contains('the and with', term) order by n desc, f1 limit 10""",
    "h1_neighbours": _near(8) + """select id, doc_id, chunk_index, round(score, 4) as score from top
        union all select distinct c.id, c.doc_id, c.chunk_index, 0.4 from chunks c join top t on c.doc_id = t.doc_id and c.chunk_size_tier = t.chunk_size_tier and abs(c.chunk_index - t.chunk_index) <= 2
        where c.id not in (select id from top)""",
    "e12_figure_pages": f"""with {bind.CHUNKS}, p as (select id, doc_id, chunk_index + 1 as page from chunks), a as (select doc_id, page from p where id % 23 = 0),
        m as (select p.id, p.doc_id, p.page, abs(p.page - a.page) as away, p.page < a.page as ahead from p join a on p.doc_id = a.doc_id and p.page between greatest(1, a.page - 1) and a.page + 2),
        r as (select *, row_number() over (partition by id order by away, ahead) as k from m) select id, doc_id, page, away, ahead from r where k = 1""",
    "h2_greedy_budget": """with s as (select doc_id // 20 as section, list(length(text) order by doc_id) as ns, list(doc_id order by doc_id) as ids from documents group by 1),
        e as (select section, ns, unnest(ids) as doc_id, generate_subscripts(ids, 1) as i from s),
        u as (select section, doc_id, ns[i] as n_chars_, list_reduce(list_prepend(0, ns[1:i - 1]), lambda a, x: case when a + x <= 8000 then a + x else a end) as used from e)
        select section, doc_id, n_chars_::int as n_chars_ from u where used + n_chars_ <= 8000""",
    "i1_keyed_union": f"with {bind.CHUNKS} select id, doc_id, chunk_index from chunks where id % 3 = 0 or id % 2 = 0",
    "o4_per_document": f"with {bind.CHUNKS} select id from chunks where chunk_index < 3",
    "o7_tier_fallback": f"with {bind.CHUNKS}, c as (select * from chunks where doc_id % 3 != 0 or chunk_size_tier = 'medium') select id from c",
    "o2_page": f"with {bind.CHUNKS} select id, (select count(*) > 35 from chunks where chunk_size_tier = 'medium') as has_more from chunks where chunk_size_tier = 'medium' order by doc_id, chunk_index limit 15 offset 20",
    "c6_min_score": _near(200) + "select id from top where score >= 0.012",
    "d25_cache_lookup": _near(5, "id % 2 = 1") + "select id, round(score, 4) as score from top where score >= 0.92 and acl_groups = ['g0'] and id * 10 between 0 and 3600 order by distance, id limit 1",
    "d2_hybrid": f"""with {bind.CATALOG}, {bind.CHUNKS}, r as (select c.id, c.vector, k.text from chunks c join catalog k on k.doc_id = c.id where list_has_any(k.acl_groups, ['g1', 'g2'])),
        nr as (select id, row_number() over (order by list_sum(list_transform(range(1, len(r.vector) + 1), lambda i: power(r.vector[i]::double - q.v[i]::double, 2))), id) as rk from r, (select embedding as v from embeddings where vec_id = 7) q),
        {BM25.replace("from documents", "from r").replace("doc_id", "id")},
        ft as (select id, row_number() over (order by score desc, id) as rk from bm)
        select id, round(sum(1.0 / (60 + rk)), 6) as score from (select * from nr where rk <= 50 union all select * from ft where rk <= 50) group by id order by sum(1.0 / (60 + rk)) desc, id limit 10""",
}

QUERIES = {
    f.__name__: f
    for f in (
        d2_hybrid, c1_acl_filter, c1_acl_all, c1_acl_none, c3_catalog_literal_all, x12_strict_original, c2_scope_filter, c21_graph_paths, c21_allowed_filenames,
        d1_vector_topk, d4_bm25, d4_postings, d5_rrf, d7_rerank, d10_cosine, d6_normalised, c7_relative_cut, c8_evidence_cut, d11_feedback_boosts,
        c9_d12_boosted, d14_query_terms, d15_term_idf, d16_match_score, d13_prf_terms, h1_neighbours, e12_figure_pages, h2_greedy_budget, i1_keyed_union,
        o4_per_document, o7_tier_fallback, o2_page, c6_min_score, d25_cache_lookup,
    )
}
