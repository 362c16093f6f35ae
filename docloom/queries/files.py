"""Readers over small files that are made of the test tables: every nation or region is a file, a sheet, a shape or a page."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import figures as U
from docloom.operators import ingest as I
from docloom.operators import tabular as K
from docloom.queries import bind
from docloom.sources import readers as A, stores
from docloom.streaming import jobs as P

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DRAW = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
VISIO = 'xmlns="http://schemas.microsoft.com/office/visio/2012/main"'
BOOK = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _nations(spark: SparkSession, sf: str) -> list[tuple[int, str, int, str]]:
    """Nations with their region: a table of 25 rows at every size."""
    n, r = bind.table(spark, sf, "nation"), bind.table(spark, sf, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_regionkey", "r_name").orderBy("n_nationkey").collect()
    return [tuple(x) for x in rows]


def _by_region(spark: SparkSession, sf: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for _, nation, _, region in _nations(spark, sf):
        out.setdefault(region, []).append(nation)
    return out


def _files(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    return A.read_binary(spark, bind.written(spark, files))


def a1_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What reads a file by its suffix, and whether its URL names a document."""
    suffix = F.get(F.array(*[F.lit(x) for x in ("pdf", "DOCX", "pptx", "xls", "tsv", "md", "txt", "vsdx", "emf", "vsd", "log")]), (F.col("o_orderkey") % 11).cast("int"))
    o = bind.table(spark, sf, "orders").select(F.concat(F.lit("https://x.org/a/"), "o_orderkey", F.lit("."), suffix).alias("path"))
    return o.groupBy(A.document_kind(F.col("path")).alias("kind"), A.is_file_url(F.concat("path", F.lit("?v=1"))).alias("is_file")).agg(F.count("*").alias("n"))


def a2_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3: text files as they are, Markdown without its furniture, and files with NUL bytes not at all."""
    made: dict[str, bytes] = {}
    for k, name, _, region in _nations(spark, sf):
        made |= {f"n{k}.txt": f"{name} lies in {region}.\n".encode(), f"m{k}.md": f"# {name}\n\nIt lies in {region}.\n\n![flag](a.png)\n".encode(), f"b{k}.txt": f"{name}\0".encode()}
    files = _files(spark, made)
    plain, marked = A.plain_text(files.filter("kind = 'transcript'")), A.markdown(files.filter("kind = 'markdown'"))
    return plain.unionByName(marked).select("filename", "doc_type", "text")


def a12_word_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs, headings and tables of a Word file for each region, in the order of the body, as text."""
    made = {}
    for region, names in _by_region(spark, sf).items():
        para = lambda t, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{escape(t)}</w:t></w:r></w:p>'
        rows = "".join(f"<w:tr><w:tc>{para(n)}</w:tc><w:tc>{para(str(len(n)))}</w:tc></w:tr>" for n in names)
        made[f"{region}.docx"] = _zip({"word/document.xml": f"<w:document {WORD}><w:body>{para(region, 'Heading1')}{para('Its nations:')}<w:tbl>{rows}</w:tbl></w:body></w:document>"})
    made["broken.docx"] = b"no zip"
    parts = A.blocks(_files(spark, made))
    return A.rendered(parts).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "text")


def a13_slides(spark: SparkSession, sf: str) -> DataFrame:
    """A slide for each nation: shapes from the top, then notes."""
    made = {}
    for region, names in _by_region(spark, sf).items():
        parts = {}
        for i, n in enumerate(names, 1):
            shape = lambda y, t: f'<p:sp><a:xfrm><a:off x="0" y="{y}"/></a:xfrm><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:sp>'
            parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {DRAW}>{shape(200, 'in ' + region)}{shape(100, n)}</p:sld>"
            parts[f"ppt/notesSlides/notesSlide{i}.xml"] = f"<p:notes {DRAW}><a:t>{escape(n.lower())}</a:t></p:notes>"
        made[f"{region}.pptx"] = _zip(parts)
    return A.blocks(_files(spark, made)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "body_index", "block_type", "page", "text")


def a19_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A drawing for each region: shapes, and connectors by the shapes that they join, unknown where one is missing."""
    made = {}
    for region, names in _by_region(spark, sf).items():
        shapes = "".join(f'<Shape ID="{i}"><Text>{escape(n)}</Text></Shape>' for i, n in enumerate([region, *names]))
        ties = "".join(f'<Connect FromSheet="c{i}" FromCell="BeginX" ToSheet="0"/><Connect FromSheet="c{i}" FromCell="EndX" ToSheet="{i if i > 1 else 99}"/>' for i in range(1, len(names) + 1))
        made[f"{region}.vsdx"] = _zip({"visio/pages/page1.xml": f"<PageContents {VISIO}><Shapes>{shapes}</Shapes><Connects>{ties}</Connects></PageContents>"})
    return A.blocks(_files(spark, made)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "block_type", "text")


def _sheet_files(spark: SparkSession, sf: str) -> DataFrame:
    made = {}
    for i, (region, names) in enumerate(_by_region(spark, sf).items()):
        if i % 3 == 0:
            made[f"{region}.csv"] = "\n".join(["Nation,Letters", *(f"{n},{len(n)}" for n in names)]).encode()
        elif i % 3 == 1:
            made[f"{region}.tsv"] = "\n".join(["Nation\tLetters", *(f"{n}\t{len(n)}" for n in names)]).encode()
        else:
            cell = lambda c, r, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{r}"><v>{v}</v></c>'
            rows = "".join(f'<row r="{r}">{cell("A", r, a)}{cell("B", r, b)}</row>' for r, (a, b) in enumerate([("Nation", "Letters"), *((n, len(n)) for n in names)], 1))
            made[f"{region}.xlsx"] = _zip({"xl/workbook.xml": f'<workbook {BOOK}><sheets><sheet name="{region}" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>', "xl/worksheets/s1.xml": f"<worksheet {BOOK}><sheetData>{rows}</sheetData></worksheet>"})
    return _files(spark, made)


def a15_workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks by their first bytes, and their sheets as text."""
    files = _sheet_files(spark, sf)
    flat = A.flat_sheets(A.sheets(files))
    return files.select("path", "filename", "format").join(flat, "path").select("filename", "format", "text")


def a8_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all rows of a sheet are as wide as its header, and how consistent its columns are."""
    grid = A.sheets(_sheet_files(spark, sf)).withColumnRenamed("path", "doc_id")
    head = grid.filter("row_idx = 0").select("doc_id", "sheet", F.size("cells").alias("width"))
    fits = grid.join(head, ["doc_id", "sheet"]).groupBy("doc_id", "sheet").agg(F.bool_and(U.consistent_width(F.col("cells"), F.col("width"))).alias("fits"))
    stats = K.column_stats(grid, K.header_rows(grid)).groupBy("doc_id", "sheet").agg(F.min("share").alias("least_share"))
    return fits.join(stats, ["doc_id", "sheet"]).select("sheet", "fits", "least_share")


def a11_html_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the tables that a recogniser gives as HTML: order lines of an order."""
    l = bind.table(spark, sf, "lineitem")
    row = F.concat(F.lit("<TR><td> "), "l_linenumber", F.lit("</td><td class='x'><b>"), "l_returnflag", F.lit("</b> &amp; "), "l_linestatus", F.lit("</td><td>&nbsp;</td></TR>"))
    per = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    tables = per.select(F.col("l_orderkey").alias("doc_id"), F.lit("t").alias("sheet"), F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html"))
    return I.html_grid(tables).select("doc_id", F.array_join("cells", "|").alias("cells"))


def a32_graphml(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a GraphML text for each nation, with the first part of their labels."""
    edge = F.concat(F.lit('<edge source="c'), "c_custkey", F.lit('" target="n'), "c_nationkey", F.lit('"><data key="d1">'), "c_mktsegment", F.lit("&lt;SEP&gt;more</data></edge>"))
    docs = bind.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat(F.lit('<graphml><node id="n'), F.col("c_nationkey"), F.lit('"/>'), F.array_join(F.sort_array(F.collect_list(edge)), "\n"), F.lit("</graphml>")).alias("text"))
    return A.graphml(docs)[1]


def a33_audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """The last hundred well-formed entries of a JSON log, newest first."""
    e = bind.table(spark, sf, "events").select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct("user_id", "event_type"))).alias("value"))
    return A.audit_log(e, "user_id long, event_type string")


def a35_matched_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose bytes a catalogued document has, and the least such document."""
    docs = bind.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    files = bind.table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    more = bind.table(spark, sf, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("path"), F.col("n_name").cast("binary").alias("content"))
    return A.matched_files(files.unionByName(more), docs).select("path", "doc_id")


def _pages(data: bytes):
    if data[:1] == b"\0":
        raise ValueError("no pages")
    return data.decode().split("\f")


def a4_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A4, A5: documents of pages (a nation's name, a blank page, a long one) by a pluggable reader: text, and how they were read."""
    made = {f"n{k}.pdf": f"{name}\f \f{(name + ' ') * 5}".encode() if k % 2 else (name * 10).encode() for k, name, *_ in _nations(spark, sf)} | {"empty.pdf": b"\0"}
    read = I.pages(_files(spark, made), _pages)
    _, docs = I.triaged(read.filter("error is null"))
    return docs.join(I.flat_pages(read), "path").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "method", "n_pages", "text")


def x26_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all kinds by their branches: those that can't be read, refused ones and pictures leave a warning."""
    made: dict[str, bytes] = {"old.vsd": b"x", "pic.emf": b"\0\1", "broken.docx": b"no zip", "data.xlsx": b"PK\3\4no zip", "log.txt": b"plain", "bad.pdf": b"\0"}
    for k, name, _, region in _nations(spark, sf):
        made |= {f"n{k}.md": f"# {name}".encode(), f"n{k}.csv": f"a,b\n{name},{k}".encode(), f"n{k}.pdf": name.encode()}
    got = I.prepared(_files(spark, made), _pages)
    return got.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "doc_type", F.col("warning").isNotNull().alias("warned"), F.length("text").alias("n"))


def p6_new_content(spark: SparkSession, sf: str) -> DataFrame:
    """Of a batch of files the contents that aren't known yet, each once."""
    docs = bind.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))
    fresh = P.new_content(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"))
    return fresh.select("content_hash")


def p8_crawl_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Connectors after a crawl that was run again: pages found and pages with new content."""
    pages = bind.table(spark, sf, "pages").select((F.col("page_id") % 4).alias("connector_id"), "url", F.md5(F.col("html").cast("binary")).alias("content_hash"), "page_id")
    connectors = spark.createDataFrame([(i, f"site {i}") for i in range(5)], "connector_id long, name string")
    got = I.crawl_run(connectors, pages, pages.filter("page_id % 3 = 0"), F.lit("2024-12-31 00:00:00").cast("timestamp"))
    return got.select("name", "pages_found", "pages_ingested", F.col("last_crawl").isNotNull().alias("crawled"))


def a28_registered(spark: SparkSession, sf: str) -> DataFrame:
    """Databases of a setting: name=url, separated by commas."""
    names = [r["r_name"] for r in bind.table(spark, sf, "region").collect()]
    got = stores.registered(", ".join([f"{n}=jdbc:db:{n}?a=b" for n in names] + ["malformed"]))
    return spark.createDataFrame(sorted(got.items()), "name string, url string")


def a31_inferred_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Inferred tables that the session lists."""
    made = [f"doc_{r['r_regionkey']}_sheet" for r in bind.table(spark, sf, "region").collect()]
    for name in made:
        bind.table(spark, sf, "region").createOrReplaceTempView(name)
    try:
        return spark.createDataFrame([(n,) for n in stores.tables_of(spark)], "table_name string")
    finally:
        for name in made:
            spark.catalog.dropTempView(name)


def k3_ingested_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """K3, K4, K2: parts as many small sheets, every seventh messy: rows in words by route, and sheets that gave none."""
    p = bind.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("s"), (F.col("p_partkey") % 40 + 1).cast("int").alias("row_idx"), "p_partkey", "p_name", "p_size")
    cells = F.array("p_name", F.when(F.col("s") % 7 == 3, F.lit("n/a")).otherwise(F.col("p_size").cast("string")), F.when((F.col("s") % 7 == 3) & (F.col("row_idx") % 2 == 0), "12").otherwise(F.when(F.col("s") % 7 == 3, "x").otherwise(F.col("p_partkey").cast("string"))))
    rows = p.select((F.floor(F.col("s") / 5)).cast("string").alias("doc_id"), F.lpad(F.col("s").cast("string"), 6, "0").alias("sheet"), "row_idx", cells.alias("cells"))
    heads = p.filter("row_idx = 1").select((F.floor(F.col("s") / 5)).cast("string").alias("doc_id"), F.lpad(F.col("s").cast("string"), 6, "0").alias("sheet"), F.lit(0).alias("row_idx"), F.array(F.lit("Name"), F.lit("Size"), F.lit("Key")).alias("cells"))
    grid = heads.unionByName(rows)
    got = I.ingested(grid)
    done = got.groupBy("doc_id", "sheet", "route").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"), F.min("text").alias("least"))
    none = I.needs_text(grid, got).select("doc_id", "sheet", F.lit("text").alias("route"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("string").alias("least"))
    return done.unionByName(none)


BY_REGION = "n as (select n_nationkey, n_name, r_name, row_number() over (partition by r_name order by n_nationkey) as i from nation join region on n_regionkey = r_regionkey)"
KEPT = "r as (select r_name, row_number() over (order by f) - 1 as k from (select r_name, min(n_nationkey) as f from nation join region on n_regionkey = r_regionkey group by 1))"
ORACLE_SQL = {
    "a1_kinds": """select case o_orderkey % 11 when 0 then 'pdf' when 1 then 'docx' when 2 then 'pptx' when 3 then 'workbook' when 4 then 'delimited' when 5 then 'markdown' when 6 then 'transcript' when 7 then 'visio' when 8 then 'emf' when 9 then 'refused' else 'text' end as kind,
        o_orderkey % 11 in (0, 1, 2, 3) as is_file, count(*) as n from orders group by all""",
    "a2_plain_text": f"""with {BY_REGION} select 'n' || n_nationkey || '.txt' as filename, 'txt' as doc_type, n_name || ' lies in ' || r_name || '.' || chr(10) as text from n
        union all select 'm' || n_nationkey || '.md', 'markdown', '# ' || n_name || chr(10) || chr(10) || 'It lies in ' || r_name || '.' from n""",
    "a12_word_documents": f"with {BY_REGION} select r_name || '.docx' as filename, r_name || chr(10) || chr(10) || 'Its nations:' || chr(10) || chr(10) || string_agg(n_name || ' | ' || length(n_name), chr(10) order by i) as text from n group by r_name",
    "a13_slides": f"""with {BY_REGION} select r_name || '.pptx' as filename, (3 * (i - 1))::int as body_index, 'paragraph' as block_type, i::int as page, n_name as text from n
        union all select r_name || '.pptx', (3 * (i - 1) + 1)::int, 'paragraph', i::int, 'in ' || r_name from n union all select r_name || '.pptx', (3 * (i - 1) + 2)::int, 'notes', i::int, lower(n_name) from n""",
    "a19_shapes": f"""with {BY_REGION} select r_name || '.vsdx' as filename, 'shape' as block_type, n_name as text from n union all select distinct r_name || '.vsdx', 'shape', r_name from n
        union all select r_name || '.vsdx', 'connector', r_name || ' -> ' || case when i > 1 then n_name else 'unknown' end from n""",
    "a15_workbooks": f"""with {BY_REGION}, {KEPT} select r_name || case k % 3 when 0 then '.csv' when 1 then '.tsv' else '.xlsx' end as filename, case when k % 3 = 2 then 'ooxml' else 'delimited' end as format,
        'Sheet: ' || r_name || chr(10) || 'Nation | Letters' || chr(10) || string_agg(n_name || ' | ' || length(n_name), chr(10) order by i) as text from n join r using (r_name) group by r_name, k""",
    "a8_widths": "select r_name as sheet, true as fits, 1.0::double as least_share from region",
    "a11_html_grid": "select l_orderkey as doc_id, l_linenumber || '|' || l_returnflag || ' & ' || l_linestatus as cells from lineitem",
    "a32_graphml": "select 'c' || c_custkey as source, 'n' || c_nationkey as target, c_mktsegment as label from customer",
    "a33_audit_log": "select event_id as position, user_id, event_type from events where event_id % 10 != 3 order by event_id desc limit 100",
    "a35_matched_files": "with h as (select coalesce(text, '') as t, min(doc_id) as doc_id from documents group by 1) select 'f' || d.doc_id as path, h.doc_id from documents d join h on h.t = coalesce(d.text, '') where d.doc_id % 3 = 0",
    "a4_pages": """with n as (select n_nationkey as k, n_name as t, trim(repeat(n_name || ' ', 5)) as five from nation)
        select 'n' || k || '.pdf' as filename, case when k % 2 = 1 then 'mixed' else 'digital' end as method, (case when k % 2 = 1 then 3 else 1 end)::bigint as n_pages,
        case when k % 2 = 1 then t || chr(10) || chr(10) || five || ' ' else repeat(t, 10) end as text from n""",
    "x26_prepared": """select 'n' || n_nationkey || '.md' as filename, 'markdown' as doc_type, false as warned, (length(n_name) + 2)::int as n from nation union all select 'n' || n_nationkey || '.pdf', 'pdf', false, length(n_name)::int from nation
        union all select 'n' || n_nationkey || '.csv', 'sheet', false, (7 + length('n' || n_nationkey) + 1 + 5 + 1 + length(n_name) + 3 + length(n_nationkey::varchar))::int from nation
        union all select * from (values ('old.vsd', 'refused', true, 0), ('pic.emf', 'emf', true, 0), ('broken.docx', 'docx', true, 0), ('data.xlsx', 'workbook', true, 10), ('log.txt', 'text', false, 5), ('bad.pdf', 'pdf', true, 0)) t""",
    "p6_new_content": "select distinct sha256(coalesce(text, '')) as content_hash from documents where doc_id % 2 = 1 and coalesce(text, '') not in (select coalesce(text, '') from documents where doc_id % 2 = 0)",
    "p8_crawl_figures": """with f as (select page_id % 4 as c, count(distinct url) as pages_found, count(distinct case when html not in (select html from pages where page_id % 3 = 0) then html end) as pages_ingested from pages group by 1)
        select 'site ' || i as name, coalesce(pages_found, 0) as pages_found, coalesce(pages_ingested, 0) as pages_ingested, pages_found is not null as crawled from range(5) t(i) left join f on f.c = i""",
    "a28_registered": "select r_name as name, 'jdbc:db:' || r_name || '?a=b' as url from region",
    "a31_inferred_tables": "select 'doc_' || r_regionkey || '_sheet' as table_name from region",
    "k3_ingested_sheets": """with p as (select p_partkey // 40 as s, * from part), g as (select s, s // 5 as d, count(*) as n, min('Name=' || p_name || '; Size is ' || p_size || ', Key is ' || p_partkey) as least from p group by all),
        o as (select *, s % 7 = 3 as messy, coalesce(sum(case when s % 7 != 3 then n end) over (partition by d order by s rows between unbounded preceding and 1 preceding), 0)::bigint as first from g)
        select d::varchar as doc_id, lpad(s::varchar, 6, '0') as sheet, case when messy then 'text' else 'clean' end as route, case when messy then 0 else n end as n, case when not messy then first end as first, case when not messy then least end as least from o""",
}


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
