"""Catalog upkeep, caches, links, listings, jobs and stores over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import access, aggregates, evidence as V, figures as U, graph as M, lifecycle as L, retrieval as R, routing as C, sets as S
from docloom.queries import bind
from docloom.sources import stores
from docloom.streaming import jobs as P

NOW = "2024-12-31 00:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def b8_catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended to a store with hashes, then a new column with a default for older rows, then purged."""
    store = stores.Store(spark, bind.folder(spark, "catalog"))
    n = bind.table(spark, sf, "nation")
    for part in range(3):
        store.append(n.filter(F.col("n_regionkey") == part).select("n_nationkey", F.sha2(F.col("n_name").cast("binary"), 256).alias("content_hash")))
    store.append(n.filter("n_regionkey > 2").select("n_nationkey", F.lit("late").alias("origin")), {"origin": "early"})
    kept = store.read()
    store.replace(kept.limit(0))
    return kept.select("n_nationkey", "origin", F.col("content_hash").isNotNull().alias("hashed"), F.lit(store.read().count()).alias("left_after_purge"))


def b10_field_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of some documents set, the others as they were."""
    d = bind.catalog(spark, sf).select("doc_id", "category", "lang")
    return S.upsert(d, d.filter("doc_id % 9 = 2").withColumn("category", F.lit("moved")), ["doc_id"])


def b12_cleaned_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables, figures and rows of documents that are gone, or whose ingest failed, leave every relation."""
    gone = bind.catalog(spark, sf).filter("doc_id % 6 = 5").select("doc_id")
    d = bind.catalog(spark, sf)
    relations = {"figures": d.filter("doc_id % 2 = 1").select("doc_id"), "schemas": d.filter("doc_id % 3 = 2").select("doc_id"), "chunks": bind.chunks(spark, sf).select("doc_id")}
    left = S.cascade_delete(relations, gone)
    parts = [t.withColumn("relation", F.lit(name)) for name, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("relation").agg(F.count("*").alias("n"))


def b18_backup(spark: SparkSession, sf: str) -> DataFrame:
    """A copy of a store elsewhere stays as it was, whatever happens to the store."""
    store, copy = stores.Store(spark, bind.folder(spark, "source")), bind.folder(spark, "copy")
    r = bind.table(spark, sf, "region")
    store.append(r)
    store.append(r.withColumn("r_regionkey", F.col("r_regionkey") + 100))
    store.back_up(copy)
    store.delete(r, "r_regionkey")
    return stores.Store(spark, copy).read().withColumn("kept", F.col("r_regionkey") >= 100).select("r_regionkey", "r_name", "kept")


def b20_usable_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links in their time whose document has the groups, the content and the asset that they were made for."""
    d = bind.catalog(spark, sf).select("doc_id", "acl_groups", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"), F.col("n_chars").cast("string").alias("asset_hash"))
    key = L.acl_key(F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("old"))).otherwise(F.reverse("acl_groups")))
    links = d.select("doc_id", key.alias("acl_key"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("revision"), F.col("asset_hash").alias("asset"), F.col("doc_id").alias("iat"), (F.col("doc_id") + 100).alias("exp"))
    return L.usable_links(links, d, 150).select("doc_id")


def c15_cited_passage(spark: SparkSession, sf: str) -> DataFrame:
    """The passage that a citation names, if the caller may see it and its text is still the cited one."""
    c = bind.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("medium").alias("chunk_size_tier"), F.col("turn").alias("chunk_index"), F.lit(0).alias("start_char"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("figure_id"), "text", F.array(F.concat(F.lit("g"), F.col("conv_id") % 2)).alias("acl_groups"))
    first = c.orderBy("doc_id", "chunk_index").select("doc_id", "chunk_index", "text").first()
    wanted = V.evidence_id((first["doc_id"], "medium", first["chunk_index"], 0, "text", None), first["text"])
    seen = [V.cited_passage(c, first["doc_id"], first["chunk_index"], e, access.acl_condition([g])).count() for e, g in ((wanted, f"g{first['doc_id'] % 2}"), ("E000000000000", f"g{first['doc_id'] % 2}"), (wanted, f"g{(first['doc_id'] + 1) % 2}"))]
    return spark.createDataFrame([tuple(seen)], "mine long, changed long, hidden long")


def c29_permissions(spark: SparkSession, sf: str) -> DataFrame:
    """Agents that a caller may use: ALL or one of the caller's groups."""
    c = bind.catalog(spark, sf).filter(access.may_use(["h3", "g2"], F.col("acl_groups")))
    return c.groupBy("dataset_id").agg(F.count("*").alias("n"))


def c30_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures of documents that the caller may see, whatever their own rows say; entities' documents that the catalog lacks."""
    d = bind.catalog(spark, sf)
    figures = bind.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc_id"), F.col("l_linenumber").alias("figure_id")).distinct()
    seen = U.authorised(figures, access.acl_filter(d, ["g1"]))
    lost = figures.select("doc_id").distinct().join(d.select("doc_id"), "doc_id", "left_anti")
    return seen.agg(F.count("*").alias("n_figures")).crossJoin(lost.agg(F.count("*").alias("n_lost")))


def d26_judged_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Miss, rejected or hit, by what is in the cache and by how sure a judge is; whatever fails is a miss."""
    cache = bind.chunks(spark, sf).select("id", "vector", F.lit("r").alias("scope_revision"), F.lit('["g"]').alias("acl_key"), F.lit(0.0).alias("created_at"), F.array(F.lit("s")).alias("sources"), F.concat(F.lit("q"), "id").alias("question"))
    v = bind.query_vector(spark, sf)

    def ask(revision: str, sure: float, embed=lambda q: v) -> tuple:
        state, row = L.judged_lookup("q", embed, lambda x: L.cache_lookup(cache, x, revision, '["g"]', 10.0, 60.0), lambda a, b: sure)
        return state, row["id"] if row else None

    got = [("sure", *ask("r", 0.97)), ("doubtful", *ask("r", 0.9)), ("other revision", *ask("x", 1.0)), ("no model", *ask("r", 1.0, lambda q: 1 / 0))]
    return spark.createDataFrame(got, "asked string, state string, id long")


def d28_quote_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Of two cited documents the passages that hold a quotation, and the best others."""
    c = bind.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    two = [r["doc_id"] for r in c.select("doc_id").distinct().orderBy("doc_id").limit(2).collect()]
    got = L.quote_support(c, two, ["the"], F.length("text").cast("double"), hits=8, best=2)
    return got.select("doc_id", "chunk_index", "protected")


def e22_analysed_once(spark: SparkSession, sf: str) -> DataFrame:
    """Placements with the analysis of their content, made once for each content."""
    l = bind.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).cast("string").alias("image_hash"))
    done = L.analysed_once(l, lambda d: d.select("image_hash", F.concat(F.lit("seen "), "image_hash").alias("said")))
    return done.groupBy("said").agg(F.count("*").alias("n"))


def g17_graph_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes and links of the graph."""
    return M.sizes(bind.edges(spark, sf))


def g17_hubs(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes with the most links."""
    return M.hubs(bind.edges(spark, sf), 10)


def g21_active_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs, those that ended, and whether any is still going."""
    e = _events(spark, sf).select((F.col("user_id") % 40).alias("job_id"), "ts", F.get(F.array(*[F.lit(s) for s in P.STATES]), (F.col("event_id") % 10).cast("int")).alias("state"))
    return P.active(P.latest_state(e))


def p3_evicted_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs within their time, whatever their state, the latest few."""
    e = _events(spark, sf).select(F.col("user_id").alias("job_id"), "ts", F.lit("queued").alias("state"))
    return P.evicted(P.latest_state(e), F.lit(NOW).cast("timestamp"), 400 * 86400, 10, terminal_only=False).select("job_id")


def p4_fresh_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries not older than their time and not from the future."""
    return P.fresh(_events(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp"), 7 * 86400, "ts").select("event_id")


def p5_decayed(spark: SparkSession, sf: str) -> DataFrame:
    """P5: weights halved every ninety days."""
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("ts")) / 86400.0
    return _events(spark, sf).select("event_id", F.round(P.decayed(F.lit(0.3), age), 6).alias("weight"))


def p9_hourly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Queries and seconds by hour and strategy."""
    e = _events(spark, sf).select(F.col("ts").alias("created_at"), F.col("event_type").alias("strategy"), F.col("value").alias("seconds"))
    return L.metrics_by_hour(e).select(F.unix_timestamp("hour").alias("hour"), "strategy", "n", F.round("avg_seconds", 4).alias("avg_seconds"))


def j32_activity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Activity as it is shown: three groups and how many more, 80 characters, month, day and minute."""
    e = _events(spark, sf).select(F.col("event_id").alias("id"), F.transform(F.sequence(F.lit(1), (F.col("event_id") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("g"), i)).alias("groups"), F.repeat(F.lit("ab"), (F.col("event_id") % 50 + 1).cast("int")).alias("query"), F.col("ts").alias("created_at"))
    return L.activity_rows(e).select("id", "groups", F.length("query").alias("n"), "at")


def o1_evidence_order(spark: SparkSession, sf: str) -> DataFrame:
    """O1, O3: originals first, protected ones by their place, then by score."""
    e = bind.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 2 == 0).alias("derived"), F.when(F.col("event_id") % 7 == 0, F.col("user_id")).alias("protected"), F.col("value").alias("score"))
    return L.evidence_order(e).limit(25).select("id")


def o5_latest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs by age, the latest first."""
    e = _events(spark, sf).groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").alias("created_at"))
    return L.jobs_by_age(e).limit(20).select("job_id")


def q12_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: documents of a category, a document by its id, columns of a table."""
    d = bind.catalog(spark, sf)
    tables = spark.createDataFrame([("part",), ("part",), ("other",)], "table_name string")
    count = lambda kind, name: L.resource(kind, name, d.withColumn("category", F.col("lang")), tables).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("category", "en").unionByName(count("document", "3")).unionByName(count("schema", "part"))


def q14_component_view(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: labels of a document's largest saved group."""
    n = bind.table(spark, sf, "nation").select(F.col("n_regionkey").alias("group"), F.when(F.col("n_nationkey") == 3, F.repeat(F.lit("x"), 120)).otherwise(F.col("n_name")).alias("label"))
    return L.component_view(n).select("label")


def x5_original_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The best citations of documents with an excerpt, protected ones first; cited figures."""
    d = bind.catalog(spark, sf).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "derived").otherwise("document").alias("kind"), F.when(F.col("doc_id") % 50 == 7, F.col("doc_id")).alias("protected"), (F.col("n_chars") % 103).alias("relevance"), "text")
    return V.original_fallback(d, 3, 50).select("doc_id", F.length("excerpt").alias("n"))


def x6_diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """Cited figures with captions cut to 180 characters."""
    e = bind.table(spark, sf, "events").select((F.col("user_id") % 20).alias("doc_id"), F.when(F.col("event_type") == "view", F.col("event_id") % 3).alias("figure_id"), F.repeat(F.lit("cap"), 70).alias("caption"))
    return L.diagrams(e).select("doc_id", "figure_id", F.length("caption").alias("n"))


def x7_verified_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figure passages whose body their stored source has."""
    p = bind.table(spark, sf, "part")
    chunks = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("figure_id"), F.when(F.col("p_partkey") % 3 == 0, "nothing of it").otherwise(F.col("p_brand")).alias("text"))
    sources = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("figure_id"), F.concat("p_name", F.lit(" / "), "p_brand").alias("source_text"))
    return L.verified_figures(chunks, sources).select("doc_id")


def x13_narrowed_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of an access change: rows keep only the groups that both states have."""
    c = bind.chunks(spark, sf).select("id", "doc_id", "acl_groups")
    new = bind.catalog(spark, sf).filter("doc_id % 2 = 0").select("doc_id", F.array(F.concat(F.lit("g"), F.col("doc_id") % 3)).alias("acl_groups"))
    return L.narrowed_acl(c, new).select("id", F.concat_ws(",", "acl_groups").alias("acl_groups"))


def x17_recategorised(spark: SparkSession, sf: str) -> DataFrame:
    """An approved proposal becomes a category, and documents without one get it where the guess is sure."""
    proposals = spark.createDataFrame([(1, "src2", "pending"), (2, "src3", "pending")], "id long, name string, status string")
    _, categories = L.approve(proposals, spark.createDataFrame([("src0",)], "name string"), 1)
    d = bind.catalog(spark, sf).select("doc_id", "category")
    guesses = d.select("doc_id", F.concat(F.lit("src"), F.col("doc_id") % 4).alias("guess"), ((F.col("doc_id") % 10) / 10).alias("confidence"))
    return L.recategorised(d, guesses, categories).select("doc_id", "category")


def x18_unprepared(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that lack tags or a summary."""
    d = bind.catalog(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array("lang")).alias("tags"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("s").alias("summary"))
    return L.unprepared(d).select("doc_id")


def x20_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is there stays; an empty one gets the defaults."""
    r = bind.table(spark, sf, "region").select("r_name")
    defaults = spark.createDataFrame([("default",)], "r_name string")
    return L.seeded(r, defaults).unionByName(L.seeded(r.limit(0), defaults))


def x22_new_names(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with names that neither the table nor an earlier row has."""
    n = bind.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    r = bind.table(spark, sf, "region").select(F.col("r_name").alias("name"))
    return S.append_unique(r, n.unionByName(n).unionByName(r), "name")


def x23_hint_order(spark: SparkSession, sf: str) -> DataFrame:
    """Hints of JSON lines, malformed ones left out."""
    e = bind.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.lit("table").alias("scope_type"), F.col("user_id").cast("string").alias("scope_value"), F.when(F.col("event_id") % 2 == 0, "column_note").otherwise("value_glossary").alias("hint_type"), F.col("event_type").alias("target_column"))))
    return L.parsed_hints(e.select(line.alias("value"))).groupBy("scope_value", "hint_type").agg(F.count("*").alias("n"))


def x24_invalidated(spark: SparkSession, sf: str) -> DataFrame:
    """A graph cache without answers to queries."""
    e = bind.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "query").otherwise("extract").alias("cache_type"))
    return L.invalidated(e).groupBy("cache_type").agg(F.count("*").alias("n"))


def x27_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Groups as a cache key: sorted, each once."""
    return bind.catalog(spark, sf).select("doc_id", L.acl_key(F.concat("acl_groups", F.array(F.lit("a")), "acl_groups")).alias("key"))


def x30_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images that an answer may show, and how much each depth looks for."""
    t = bind.table(spark, sf, "conversations")
    asked = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" show the diagram"))).otherwise(F.lit("plain"))
    return t.select("conv_id", "turn", C.image_limit(asked, "requested", C.depth_limit("focused", "subtask")).alias("requested"), C.image_limit(asked, "auto", C.depth_limit("unknown", "window")).alias("auto"), C.image_limit(asked, "never", 9).alias("never"))


def i2_merged_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of two branches, each where it came first, with relevance by the best real score."""
    c = bind.chunks(spark, sf).select("id", "doc_id", "chunk_index", (F.col("id") % 17).cast("double").alias("score"), (F.col("id") % 11 == 0).alias("synthetic"))
    return C.merged_branches([c.filter("id % 3 = 0"), c.filter("id % 2 = 0").withColumn("score", F.col("score") * 2)], ["doc_id", "chunk_index"]).select("id", "branch", F.round("relevance", 4).alias("relevance"))


def h2_section_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the best seeds' sections, within a budget, with the score of their document's best seed."""
    c = bind.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(F.col("l_orderkey") / 4).alias("doc_id"), F.col("l_orderkey").cast("string").alias("section_id"), F.lit("small").alias("chunk_size_tier"), F.col("l_linenumber").alias("chunk_index"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"), F.col("l_extendedprice").alias("score"))
    c = c.groupBy("id", "doc_id", "section_id", "chunk_size_tier", "chunk_index").agg(F.min("text").alias("text"), F.min("score").alias("score"))
    seeds = c.orderBy(F.desc("score"), "id").limit(5)
    return R.section_expansion(seeds, c, 200).select("id", F.round("score", 2).alias("score"))


def h5_margins(spark: SparkSession, sf: str) -> DataFrame:
    """H5: per pattern the best strategy's lead over the next."""
    return aggregates.strategy_stats(bind.memory(spark, sf)).select("pattern", "strategy", F.round("margin", 4).alias("margin"))


ORACLE_SQL = {
    "b8_catalog_rows": "select n_nationkey, case when n_regionkey > 2 then 'late' else 'early' end as origin, n_regionkey <= 2 as hashed, 0::int as left_after_purge from nation",
    "b10_field_updates": f"with {bind.CATALOG} select doc_id, case when doc_id % 9 = 2 then 'moved' else category end as category, lang from catalog",
    "b12_cleaned_tables": f"""with {bind.CHUNKS}, g as (select doc_id from documents where doc_id % 6 = 5) select 'figures' as relation, count(*) as n from documents where doc_id % 2 = 1 and doc_id not in (from g)
        union all select 'schemas', count(*) from documents where doc_id % 3 = 2 and doc_id not in (from g) union all select 'chunks', count(*) from chunks where doc_id not in (from g)""",
    "b18_backup": "select r_regionkey, r_name, false as kept from region union all select r_regionkey + 100, r_name, true from region",
    "b20_usable_links": "select doc_id from documents where doc_id % 4 != 0 and doc_id % 5 != 0 and doc_id <= 150 and doc_id + 100 > 150",
    "c15_cited_passage": "select 1::bigint as mine, 0::bigint as changed, 0::bigint as hidden",
    "c29_permissions": f"with {bind.CATALOG} select dataset_id, count(*) as n from catalog where list_has_any(acl_groups, ['ALL', 'h3', 'g2']) group by 1",
    "c30_figures": f"""with {bind.CATALOG}, f as (select distinct l_orderkey % 1000 as doc_id, l_linenumber from lineitem) select (select count(*) from f where doc_id in (select doc_id from catalog where list_contains(acl_groups, 'g1'))) as n_figures,
        (select count(distinct doc_id) from f where doc_id not in (select doc_id from documents)) as n_lost""",
    "d26_judged_cache": "select * from (values ('sure', 'hit', 7::bigint), ('doubtful', 'rejected', null), ('other revision', 'miss', null), ('no model', 'miss', null)) t(asked, state, id)",
    "d28_quote_passages": """with d as (select distinct conv_id from conversations order by 1 limit 2), c as (select conv_id as doc_id, turn as chunk_index, text, contains(lower(text), 'the') as q from conversations where conv_id in (from d))
        select doc_id, chunk_index, 0::int as protected from (select * from c where q order by doc_id, chunk_index limit 8) union all select doc_id, chunk_index, 1 from (select * from c where not q order by length(text) desc, doc_id, chunk_index limit 2)""",
    "e22_analysed_once": "select 'seen ' || (l_partkey % 50) as said, count(*) as n from lineitem group by 1",
    "g17_graph_sizes": f"with {bind.EDGES} select (select count(distinct x) from (select source as x from edges union all select target from edges)) as n_nodes, (select count(*) from (select distinct source, target from edges)) as n_edges",
    "g17_hubs": f"with {bind.EDGES} select node, count(*) as degree from (select source as node from edges union all select target from edges) group by 1 order by degree desc, node limit 10",
    "g21_active_jobs": """with e as (select user_id % 40 as j, ts, event_id % 10 as p from events), o as (select *, row_number() over (partition by j order by ts desc, p desc) as k from e)
        select count(*) as n, count(case when p >= 8 then 1 end) as n_done, bool_or(p < 8) as active from o where k = 1""",
    "p3_evicted_jobs": "select user_id as job_id from events group by 1 having epoch(timestamp '2024-12-31') - floor(epoch(max(ts))) <= 400 * 86400 order by max(ts) desc, user_id limit 10",
    "p4_fresh_entries": "select event_id from events where floor(epoch(ts)) between epoch(timestamp '2024-01-20') - 7 * 86400 and epoch(timestamp '2024-01-20')",
    "p5_decayed": "select event_id, round(0.3 * power(0.5, (epoch(timestamp '2024-12-31') - floor(epoch(ts))) / 86400.0 / 90), 6) as weight from events",
    "p9_hourly_metrics": "select epoch(date_trunc('hour', ts))::bigint as hour, event_type as strategy, count(*) as n, round(avg(value), 4) as avg_seconds from events group by all",
    "j32_activity_rows": """select event_id as id, array_to_string(list_transform(range(1, least(3, event_id % 5 + 1) + 1), lambda i: 'g' || i), ', ') || case when event_id % 5 + 1 > 3 then ' +' || (event_id % 5 - 2) else '' end as groups,
        (case when 2 * (event_id % 50 + 1) > 80 then 80 else 2 * (event_id % 50 + 1) end)::int as n, month(ts) || '-' || day(ts) || strftime(ts, ' %H:%M') as at from events""",
    "o1_evidence_order": "select event_id as id from events order by event_id % 2 = 0, coalesce(case when event_id % 7 = 0 then user_id end, 1000000000), value desc, event_id limit 25",
    "o5_latest_jobs": "select user_id as job_id from events group by 1 order by min(ts) desc, user_id limit 20",
    "q12_resources": f"with {bind.CATALOG} select 'category' as kind, count(*) as n from catalog where lang = 'en' union all select 'document', count(*) from catalog where doc_id = 3 union all select 'schema', 2",
    "q14_component_view": """with l as (select distinct n_regionkey as g, n_name as label from nation where n_nationkey != 3), s as (select g from l group by 1 having count(*) >= 4 order by count(*) desc, g limit 1) select label from l where g in (from s) order by label limit 40""",
    "x5_original_evidence": "select doc_id, least(50, length(text))::int as n from documents where doc_id % 4 != 0 order by coalesce(case when doc_id % 50 = 7 then doc_id end, 1000000000), n_chars % 103 desc, doc_id limit 3",
    "x6_diagrams": "select distinct user_id % 20 as doc_id, event_id % 3 as figure_id, 180::int as n from events where event_type = 'view'",
    "x7_verified_figures": "select p_partkey as doc_id from part where p_partkey % 3 != 0",
    "x13_narrowed_groups": f"with {bind.CHUNKS} select id, case when doc_id % 2 = 0 and doc_id in (select doc_id from documents) and 'g' || (doc_id % 3) != acl_groups[1] then '' else acl_groups[1] end as acl_groups from chunks",
    "x17_recategorised": f"with {bind.CATALOG} select doc_id, coalesce(nullif(category, ''), case when doc_id % 4 in (0, 2) and doc_id % 10 >= 5 then 'src' || (doc_id % 4) end) as category from catalog",
    "x18_unprepared": "select doc_id from documents where doc_id % 3 != 1 or doc_id % 4 = 0",
    "x20_seeded": "select r_name from region union all select 'default'",
    "x22_new_names": "select r_name as name from region union select n_name from nation",
    "x23_hint_order": "select user_id::varchar as scope_value, case when event_id % 2 = 0 then 'column_note' else 'value_glossary' end as hint_type, count(*) as n from events where event_id % 5 != 0 group by all",
    "x24_invalidated": "select 'extract' as cache_type, count(*) as n from events where event_type != 'click'",
    "x27_cache_keys": f"with {bind.CATALOG} select doc_id, '[\"' || array_to_string(list_sort(list_distinct(list_append(acl_groups, 'a'))), '\",\"') || '\"]' as key from catalog",
    "x30_images": "select conv_id, turn, case when turn % 2 = 0 then 5 else 0 end as requested, 2 as auto, 0 as never from conversations",
    "i2_merged_branches": f"""with {bind.CHUNKS}, b as (select id, 0 as branch, (id % 17)::double as s from chunks where id % 3 = 0 union all select id, 1, 2.0 * (id % 17) from chunks where id % 2 = 0 and id % 3 != 0),
        t as (select max(case when id % 11 != 0 then s end) as m from b) select id, branch, round(case when id % 11 != 0 and m > 0 then s / m end, 4) as relevance from b, t""",
    "h5_margins": f"""with {bind.MEMORY}, s as (select pattern, strategy, avg(cited) + 0.001 * avg(relevant) as k from memory group by all), o as (select *, row_number() over w as p, lead(k) over w as nx from s window w as (partition by pattern order by k desc, strategy))
        select pattern, strategy, round(k - coalesce(nx, 0), 4) as margin from o where p = 1""",
    "h2_section_expansion": """with c as (select l_orderkey * 10 + l_linenumber as id, l_orderkey // 4 as doc_id, l_orderkey as s, l_linenumber as i, min(l_quantity::int) as n, min(l_extendedprice) as score from lineitem group by all),
        seeds as (select * from c order by score desc, id limit 5), d as (select doc_id, max(score) as best from seeds group by 1),
        r as (select c.id, best, n, row_number() over (order by c.doc_id, c.s::varchar, c.i) as p from c join d using (doc_id) where (c.doc_id, c.s) in (select doc_id, s from seeds)),
        u as (select id, best, n, list_reduce(list_prepend(0, list(n) over (order by p rows between unbounded preceding and 1 preceding)), lambda a, x: case when a + x <= 200 then a + x else a end) as used from r)
        select id, round(best, 2) as score from u where coalesce(used, 0) + n <= 200""",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
