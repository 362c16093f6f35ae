"""Sheets, chunking, web pages, editions, transcripts, hints and temporal state over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import chunking, text as X
from docloom.operators import editions as L
from docloom.operators import evidence as V
from docloom.operators import models as Q
from docloom.operators import tabular as K
from docloom.queries import bind
from docloom.sources import readers as A
from docloom.streaming import jobs as P


def h9_header_rows(spark: SparkSession, sf: str) -> DataFrame:
    return K.header_rows(bind.grid(spark, sf)).select("doc_id", "sheet", "header_row")


def g11_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    """G11, G12."""
    g = bind.grid(spark, sf)
    return K.column_stats(g, K.header_rows(g)).select("doc_id", "col", "numbers", "texts", "dtype", F.round("share", 4).alias("share"))


def k1_classify(spark: SparkSession, sf: str) -> DataFrame:
    return K.classify(bind.grid(spark, sf)).select("doc_id", "route", "header_row", F.concat_ws(",", "dtypes").alias("dtypes"), "reason")


def b7_typed_table(spark: SparkSession, sf: str) -> DataFrame:
    """B7, K7, J5."""
    g = bind.grid(spark, sf).filter("doc_id = 'part'")
    head = g.filter("row_idx = 0").first()["cells"]
    return K.typed_table(g, 0, head, ["text", "text", "number", "number"])


def j17_narratives(spark: SparkSession, sf: str) -> DataFrame:
    t = b7_typed_table(spark, sf)
    return t.select(K.narrative(t, ["part_name", "brand"], ["size_cm"], context="parts").alias("said"))


def k5_regions(spark: SparkSession, sf: str) -> DataFrame:
    """K5, H8."""
    return K.regions(bind.grid(spark, sf))


def a6_normalised_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = bind.grid(spark, sf).withColumn("cells", F.concat(F.array(F.lit("")), "cells", F.array(F.lit("  "))))
    return K.normalise_grid(g).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi"))


def a7_stitched(spark: SparkSession, sf: str) -> DataFrame:
    """A7, H6."""
    n = bind.table(spark, sf, "nation").select(F.lit("d").alias("doc_id"), F.lit("s").alias("sheet"), F.floor(F.col("n_nationkey") / 5).cast("int").alias("grid_no"), (F.col("n_nationkey") % 5).alias("r"), "n_name")
    head = F.when(F.col("grid_no") < 3, F.array(F.lit("Nation"))).otherwise(F.array(F.lit("Country")))
    grids = n.select("doc_id", "sheet", "grid_no", (F.col("r") + 1).alias("row_idx"), F.array("n_name").alias("cells")).unionByName(n.select("doc_id", "sheet", "grid_no", F.lit(0).alias("row_idx"), head.alias("cells")).distinct())
    return K.stitch(grids).groupBy("island").agg(F.count("*").alias("n"))


def k6_hints(spark: SparkSession, sf: str) -> DataFrame:
    """K6, E14."""
    return K.resolve_hints(_hints(spark, sf)).select("scope_value", "target_column", "payload")


def _hints(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 6).cast("string").alias("scope_value"), F.lit("note").alias("hint_type"), F.col("event_type").alias("target_column"), F.col("event_id").cast("string").alias("payload"),
        F.when(F.col("event_id") % 5 == 0, "human").when(F.col("event_id") % 5 == 1, "document").otherwise("model").alias("provenance"), ((F.col("event_id") * 7) % 10).alias("confidence"), F.col("event_id").alias("created_at"),
    )


def e15_glossary(spark: SparkSession, sf: str) -> DataFrame:
    values = bind.table(spark, sf, "part").select(F.col("p_brand").alias("value")).distinct()
    entries = spark.createDataFrame([("Brand#11", "exact", 0), ("Brand#1*", "ones", 1), ("Brand#*", "any", 2), ("Brand#2*", "twos", 3)], "key string, meaning string, place int")
    return K.glossary(values, entries)


def j3_cell_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """J3, J4."""
    g = bind.grid(spark, sf).select("doc_id", F.explode("cells").alias("c"))
    return g.groupBy("doc_id", X.cell_kind(F.col("c")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(X.to_number(F.col("c"))), 2).alias("total"))


def j13_paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """J13, H13."""
    return chunking.paragraph_chunks(bind.table(spark, sf, "documents"), *chunking.TIERS["small"])


def j14_technical_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """J14, H7."""
    return chunking.technical_chunks(bind.table(spark, sf, "documents"), 2048).select("doc_id", "chunk_index", "start_char", "section_id", "evidence_role")


def j15_roles(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.concat_ws(",", X.evidence_roles(F.col("text"))).alias("roles"))


def j9_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return A.pages_to_markdown(bind.table(spark, sf, "pages")).select("page_id", F.length(X.strip_furniture(F.col("markdown"))).alias("n"))


def a24_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return A.pages_to_markdown(bind.table(spark, sf, "pages")).select("page_id", "markdown")


def a24_planted_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages about parts: headings, emphasis, links and lists as Markdown; scripts, styles, navigation, headers, asides and footers
    go; where a page has a main part, it alone counts."""
    p, odd = bind.table(spark, sf, "part"), F.col("p_partkey") % 2 == 1
    head = F.lit("<html><head><title>T</title><style>a{}</style><script>var x=1;</script></head><body><nav><a href='/m'>menu</a></nav><header>top</header><aside>ad</aside>")
    body = F.concat(F.lit("<h1>"), "p_brand", F.lit(" &amp; more</h1><p>All about <b>"), "p_name", F.lit('</b> and <a href="http://h/'), F.col("p_partkey").cast("string"), F.lit('">it</a>.</p><h2>Parts</h2><ul><li>one</li><li>'), "p_type", F.lit("</li></ul>"))
    page = F.concat(head, F.when(odd, F.concat(F.lit("<p>outside</p><main>"), body, F.lit("</main>"))).otherwise(body), F.lit("<footer>foot</footer></body></html>"))
    return A.pages_to_markdown(p.select(F.col("p_partkey").alias("page_id"), page.alias("html"))).select("page_id", "markdown")


def a25_links(spark: SparkSession, sf: str) -> DataFrame:
    return A.links(bind.table(spark, sf, "pages"))


def a23_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as pages that link to the next one and to the one of twice their number: reached from the first, breadth first."""
    k = F.col("n_nationkey")
    link = lambda to: F.concat(F.lit('<a href="/n/'), to % 25, F.lit('#x">go</a>'))
    pages = bind.table(spark, sf, "nation").select(F.concat(F.lit("https://x.org/n/"), k).alias("url"), F.concat(F.lit("<html>"), link(k + 1), link(2 * k), F.lit('<a href="https://y.org/n/24">off</a></html>')).alias("html"))
    return A.crawl(pages, "https://x.org/n/1", 4, 100)


def a26_clean_urls(spark: SparkSession, sf: str) -> DataFrame:
    """A26, A27."""
    u = bind.table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("/?a=1#part")).alias("u"))
    return u.select("page_id", A.clean_url(F.col("u")).alias("url"), A.is_file_url(F.concat("u", F.lit("x.pdf"))).alias("is_file"))


def a18_transcript(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations")
    docs = t.select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.concat(F.lit("Meeting: weekly\n---\n"), "role", F.lit(": "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))
    return A.transcript(docs).groupBy("kind").agg(F.count("*").alias("n"))


def g16_speakers(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers"))


def c12_meeting_questions(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations")
    return t.filter("role = 'user'").withColumn("kind", F.when(F.rtrim("text").endswith("?"), "question").otherwise("statement")).groupBy("kind").agg(F.count("*").alias("n"))


def a34_indexed_text(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.lit(0).alias("start_char"), F.concat(F.lit("Section: x\n\n"), "text").alias("text"))
    return A.indexed_text(t).select("doc_id", F.length("text").alias("n"))


def j1_query_patterns(spark: SparkSession, sf: str) -> DataFrame:
    t = bind.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", X.query_pattern(F.col("text")).alias("pattern"))


def j2_query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "conversations").select("conv_id", "turn", X.query_hash(F.col("text")).alias("h"))


def j6_table_names(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "part").select("p_partkey", X.table_name(F.col("p_name"), F.col("p_brand")).alias("name"))


def j10_versions(spark: SparkSession, sf: str) -> DataFrame:
    p = bind.table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 12, F.when(F.col("p_partkey") % 3 == 0, "b").otherwise("")).alias("v"))
    return p.select("p_partkey", "v", X.version_key(F.col("v")).alias("k")).select("p_partkey", "v", F.col("k.n1").alias("n1"), F.col("k.n2").alias("n2"), F.col("k.n3").alias("n3"), F.col("k.suffix").alias("suffix"))


def j10_titles(spark: SparkSession, sf: str) -> DataFrame:
    p = bind.table(spark, sf, "part")
    return p.select("p_partkey", X.normalise_title(F.concat("p_name", F.lit(" Rev 2.1b ("), "p_brand", F.lit(")"))).alias("title"))


def j10_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = bind.table(spark, sf, "orders")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "d MMM yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return o.select("o_orderkey", X.source_date(said).alias("d"))


def j35_capped(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "documents").select("doc_id", F.length(X.cap(F.col("text"), 500)).alias("n"))


def j8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "part").select("p_partkey", X.url_decode(F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+a%2Bb"))).alias("name"))


def j33_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "documents").select("doc_id", X.graph_timeout(F.length("text") * 100).alias("seconds"))


def _editions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' manuals: three editions each, the date of the second unknown for every fifth."""
    s = bind.table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e"))
    head = F.concat(F.lit("# Manual\nDocument ID: M-"), "s_suppkey", F.lit("\nProduct: P"), "s_suppkey", F.lit("\nRevision: "), "e", F.lit(".0\n"))
    date = F.when((F.col("e") == 2) & (F.col("s_suppkey") % 5 == 0), F.lit("Effective date: 1/2/2020\n")).otherwise(F.concat(F.lit("Effective date: 202"), "e", F.lit("-01-01\n")))
    docs = s.select(F.concat_ws("-", F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), "e").alias("doc_id"), F.concat(F.lit("m"), "s_suppkey", F.lit("."), "e", F.lit(".txt")).alias("filename"), F.lit("txt").alias("doc_type"), F.concat(head, date).alias("text"))
    return L.identity(docs.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)))


def j11_identity(spark: SparkSession, sf: str) -> DataFrame:
    """J11, L8."""
    d = _editions(spark, sf)
    return d.select("doc_id", "identity.identifier", "identity.revision", "identity.effective_date", "identity.title", F.concat_ws(",", "identity.conflicts").alias("conflicts"))


def l3_select_editions(spark: SparkSession, sf: str) -> DataFrame:
    """The newest edition of each manual; undated ones stay side by side."""
    return L.select_editions(_editions(spark, sf)).select("doc_id", "family", "selected", "reason")


def p1_latest_states(spark: SparkSession, sf: str) -> DataFrame:
    """P1, X25."""
    return P.latest_state(_events(spark, sf)).select("job_id", "state", "n_events")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = bind.table(spark, sf, "events")
    return e.select((F.col("user_id") % 40).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.get(F.array(*[F.lit(s) for s in P.STATES]), (F.col("event_id") % 10).cast("int")).alias("state"))


def p2_evicted(spark: SparkSession, sf: str) -> DataFrame:
    """P2."""
    states = P.latest_state(_events(spark, sf))
    now = states.agg(F.max("ts")).first()[0]
    return P.evicted(states, F.lit(now), 3600, 5).select("job_id")


def p_tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = P.windowed(bind.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return w.select(F.unix_timestamp("starts").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"))


def p_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = P.windowed(bind.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "2 days", "1 day")
    return w.select(F.unix_timestamp("starts").alias("starts"), "event_type", "n", F.round("total", 4).alias("total"))


def p_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = P.sessions(bind.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


def q5_classified(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "conversations").groupBy(Q.classify(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def q2_embedded(spark: SparkSession, sf: str) -> DataFrame:
    e = Q.embed(bind.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.size("vector").alias("dim"))


def e26_citations(spark: SparkSession, sf: str) -> DataFrame:
    d = bind.table(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("E"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12)).alias("e"))
    answers = d.select("answer_id", F.concat(F.lit("so ["), "e", F.lit("] and [E000000000000] ["), "e", F.lit("]")).alias("answer"))
    return V.checked_citations(answers, d.filter("answer_id % 3 = 0").select("answer_id", F.col("e").alias("evidence_id")))


def x1_basic_answer(spark: SparkSession, sf: str) -> DataFrame:
    """X1."""
    d = bind.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("n_chars") % 97).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    return V.basic_answer(d)


GRID = """
grid as (
  select 'part' as doc_id, p_partkey as row_idx, [p_name, p_brand, case when p_partkey % 17 = 0 then 'n/a' else p_size::varchar end, '$' || printf('%.2f', p_retailprice)] as cells from part
  union all select 'supplier', s_suppkey, [s_name, case when s_suppkey % 2 = 0 then 'n/a' else s_nationkey::varchar end, printf('%.2f', s_acctbal)] from supplier),
cells as (select doc_id, generate_subscripts(cells, 1) - 1 as col, unnest(cells) as c from grid),
kinds as (select *, case when trim(c) = '' then 'empty' when try_cast(regexp_replace(c, '[$,%]', '', 'g') as double) is not null then 'number' else 'text' end as kind from cells),
stats as (select doc_id, col, count(case when kind = 'number' then 1 end) as numbers, count(case when kind = 'text' then 1 end) as texts from kinds group by all)"""

ORACLE_SQL = {
    "a24_planted_pages": "select p_partkey as page_id, '# ' || p_brand || ' & more' || repeat(chr(10), 3) || 'All about **' || p_name || '** and [it](http://h/' || p_partkey || ').' || repeat(chr(10), 3) || '## Parts' || repeat(chr(10), 3) || '* one' || chr(10) || '* ' || p_type as markdown from part",
    "h9_header_rows": "select 'part' as doc_id, 'parts' as sheet, 0 as header_row union all select 'supplier', 'suppliers', 0",
    "g11_column_stats": f"with {GRID} select doc_id, col, numbers, texts, case when numbers > texts then 'number' else 'text' end as dtype, round(greatest(numbers, texts) / (numbers + texts), 4) as share from stats",
    "k1_classify": f"""with {GRID}, j as (select doc_id, string_agg(case when numbers > texts then 'number' else 'text' end, ',' order by col) as dtypes, min(case when greatest(numbers, texts) / (numbers + texts) < 0.8 then col end) as odd from stats group by doc_id)
        select doc_id, case when odd is null then 'clean' else 'messy' end as route, 0 as header_row, dtypes, case when odd is null then 'clean table' else 'column ' || odd || ' not type-consistent' end as reason from j""",
    "b7_typed_table": "select p_name as part_name, p_brand as brand, case when p_partkey % 17 = 0 then null else p_size::double end as size_cm, round(p_retailprice, 2) as retail_price from part",
    "j17_narratives": "select 'parts: part_name=' || p_name || ', brand=' || p_brand || '; size_cm is ' || case when p_partkey % 17 = 0 then '(not specified)' else p_size || '.0' end as said from part",
    "a6_normalised_grid": f"with {GRID} select doc_id, count(*) + 1 as n, min(len(cells))::int as lo, max(len(cells))::int as hi from grid group by doc_id",
    "a7_stitched": "select case when n_nationkey < 15 then 1 else 2 end as island, count(*) + 1 as n from nation group by 1",
    "k6_hints": """with h as (select (user_id % 6)::varchar as scope_value, event_type as target_column, event_id::varchar as payload, case event_id % 5 when 0 then 3 when 1 then 2 else 1 end as r, (event_id * 7) % 10 as c, event_id from events),
        o as (select *, row_number() over (partition by scope_value, target_column order by r desc, c desc, event_id desc) as p from h) select scope_value, target_column, payload from o where p = 1""",
    "e15_glossary": "select distinct p_brand as value, case when p_brand = 'Brand#11' then 'exact' when p_brand like 'Brand#1%' then 'ones' else 'any' end as meaning from part",
    "j3_cell_kinds": f"""with {GRID}, h as (select 'part' as doc_id, unnest(['Part Name', 'Brand', 'Size (cm)', 'Retail Price']) as c union all select 'supplier', unnest(['Supplier', 'Nation', 'Balance'])),
        k as (select doc_id, kind, try_cast(regexp_replace(c, '[$,%]', '', 'g') as double) as v from kinds union all select doc_id, 'text', null from h) select doc_id, kind, count(*) as n, round(sum(v), 2) as total from k group by all""",
    "a23_crawl": """with recursive r(k, hop) as (select 1, 0 union select unnest([(k + 1) % 25, (2 * k) % 25]), hop + 1 from r where hop < 4) select 'https://x.org/n/' || k as url, min(hop)::int as hop from r group by k""",
    "j15_roles": "select conv_id, turn, concat_ws(',', " + ", ".join(f"case when regexp_matches(text, '(?im){p}') then '{n}' end" for n, p in X.ROLES.items()) + ") as roles from conversations",
    "q5_classified": "select case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in Q.QUERY_TYPES) + " else 'lookup' end as kind, count(*) as n from conversations group by 1",
    "p2_evicted": """with e as (select user_id % 40 as j, ts, event_id % 10 as p from events), s as (select *, row_number() over (partition by j order by ts desc, p desc) as k from e), l as (select * from s where k = 1), m as (select max(ts) as now from l)
        select j as job_id from l where p < 8 union all select j from (select j from l, m where p >= 8 and floor(epoch(now)) - floor(epoch(ts)) <= 3600 order by ts desc, j limit 5)""",
    "a26_clean_urls": "with u as (select page_id, regexp_replace(url || '/?a=1#part', '#.*$', '') as u from pages) select page_id, regexp_replace(regexp_extract(u, '^([^?]*)', 1), '/+$', '') || regexp_extract(u, '([?].*)$', 1) as url, false as is_file from u",
    "a18_transcript": "select 'header' as kind, count(*) as n from conversations union all select case when rtrim(text, ' \t\n') like '%?' then 'question' else 'statement' end, count(*) from conversations group by 1",
    "g16_speakers": "select conv_id, string_agg(distinct role, ',' order by role) as speakers from conversations group by 1",
    "c12_meeting_questions": "select case when rtrim(text) like '%?' then 'question' else 'statement' end as kind, count(*) as n from conversations where role = 'user' group by 1",
    "a34_indexed_text": "with d as (select conv_id, text from conversations group by all) select conv_id as doc_id, (sum(length(text)) + 2 * (count(*) - 1))::int as n from d group by 1",
    "j2_query_hash": "select conv_id, turn, sha256(array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x != ''), ' ')) as h from conversations",
    "j6_table_names": "select p_partkey, 'doc_' || trim(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(p_brand), '[^0-9a-z]+', '_', 'g'), '_') as name from part",
    "j10_versions": "select p_partkey, p_size || '.' || (p_partkey % 12) || case when p_partkey % 3 = 0 then 'b' else '' end as v, p_size::bigint as n1, p_partkey % 12 as n2, 0::bigint as n3, case when p_partkey % 3 = 0 then 'b' else '' end as suffix from part",
    "j10_titles": "select p_partkey, array_to_string(regexp_extract_all(lower(p_name || ' (' || p_brand || ')'), '[a-z0-9]+'), ' ') as title from part",
    "j10_dates": "select o_orderkey, case when o_orderkey % 4 != 3 then strftime(o_orderdate, '%Y-%m-%d') end as d from orders",
    "j35_capped": "select doc_id, (case when length(text) > 500 then 500 + 16 else length(text) end)::int as n from documents",
    "j8_decoded": "select p_partkey, p_name || '+a+b' as name from part",
    "j33_timeouts": "select doc_id, least(3600, greatest(900, ceil(greatest(1, ceil(length(text) * 100 / 4800)) * 22 / 4)))::bigint as seconds from documents",
    "j11_identity": """select lpad(s_suppkey::varchar, 5, '0') || '-' || e as doc_id, 'M-' || s_suppkey as identifier, e || '.0' as revision, case when e = 2 and s_suppkey % 5 = 0 then null else '202' || e || '-01-01' end as effective_date,
        'Manual' as title, case when e = 2 and s_suppkey % 5 = 0 then 'effective_date' else '' end as conflicts from supplier, (select unnest([1, 2, 3]) as e)""",
    "l3_select_editions": """select lpad(s_suppkey::varchar, 5, '0') || '-' || e as doc_id, lpad(s_suppkey::varchar, 5, '0') || '-1' as family, e = 3 or (e = 2 and s_suppkey % 5 = 0) as selected,
        case when e = 3 or (e = 2 and s_suppkey % 5 = 0) then case when s_suppkey % 5 = 0 then 'ambiguous' else 'selected' end else 'superseded' end as reason from supplier, (select unnest([1, 2, 3]) as e)""",
    "p1_latest_states": """with e as (select user_id % 40 as job_id, ts, event_id % 10 as p, ['queued','parsing','categorizing','extracting','chunking','embedding','storing','graph','complete','failed'][(event_id % 10) + 1] as state from events),
        o as (select *, row_number() over (partition by job_id order by ts desc, p desc) as k, count(*) over (partition by job_id) as n_events from e) select job_id, state, n_events from o where k = 1""",
    "p_tumbling_windows": "select epoch(date_trunc('day', ts))::bigint as starts, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "p_sliding_windows": "with d as (select date_trunc('day', ts) - to_days(k::int) as s, event_type, value from events, (select unnest([0, 1]) as k)) select epoch(s)::bigint as starts, event_type, count(*) as n, round(sum(value), 4) as total from d group by all",
    "p_sessions": """with o as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as b from events) select user_id, count(case when b is null or ts - b >= interval 6 hours then 1 end) as n_sessions, count(*) as n from o group by 1""",
    "q2_embedded": "select doc_id, 64 as dim from documents",
    "e26_citations": """with d as (select doc_id, 'E' || substr(md5(doc_id::varchar), 1, 12) as e from documents) select doc_id as answer_id, e as evidence_id, doc_id % 3 = 0 as valid from d union all select doc_id, 'E000000000000', false from d""",
    "x1_basic_answer": "select row_number() over (order by n_chars % 97 desc, doc_id)::int as ordinal, doc_id as id, substr(text, 1, 200) as snippet from documents order by n_chars % 97 desc, doc_id limit 10",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
