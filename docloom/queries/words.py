"""Scalar text functions, chunks, evidence and quotes over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import chunking, text as X
from docloom.operators import evidence as V, figures as U, graph as M, lifecycle as L, models as Q, tabular as K, views as W
from docloom.operators import access, editions, retrieval as R
from docloom.queries import bind
from docloom.session import ship


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return bind.table(spark, sf, "conversations")


def j4_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of cells with signs of money and thousands, and of cells that have none."""
    p = bind.table(spark, sf, "part")
    cell = F.when(F.col("p_partkey") % 5 == 0, "n/a").when(F.col("p_partkey") % 5 == 1, "-inf").otherwise(F.concat(F.lit(" $"), F.format_number("p_retailprice", 2), F.lit(" ")))
    return p.select("p_partkey", X.to_number(cell).alias("value"))


def j5_column_names(spark: SparkSession, sf: str) -> DataFrame:
    """Safe, distinct names of header rows."""
    ship(spark)
    p = bind.table(spark, sf, "part")
    heads = F.array("p_brand", F.lower("p_brand"), F.lit(""), F.lit(None).cast("string"), F.concat(F.col("p_size").cast("string"), F.lit(" x")), F.lit("Größe"))
    return p.select("p_partkey", F.concat_ws(",", X.safe_names(heads)).alias("names"))

def j7_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """All values of list fields as one lower-case text; missing lists count as empty."""
    p = bind.table(spark, sf, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags"), F.when(F.col("p_partkey") % 2 == 0, F.split("p_name", " ")).alias("more"))
    return p.select("p_partkey", X.metadata_blob([F.col("tags"), F.col("more")]).alias("blob"))


def j12_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence ids of chunks from their key and text, and ids of sections from their path."""
    c = _conversations(spark, sf).select(F.col("conv_id").alias("doc_id"), F.lit("medium").alias("chunk_size_tier"), F.col("turn").alias("chunk_index"), F.lit(0).alias("start_char"), F.lit("text").alias("content_type"), F.lit(None).cast("string").alias("figure_id"), "text")
    return V.with_evidence_id(c).select("doc_id", "chunk_index", "evidence_id")


def j14_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a heading for each region and nation: the path of headings is carried on to each section."""
    n, r = bind.table(spark, sf, "nation"), bind.table(spark, sf, "region")
    part = F.concat(F.lit("## "), "n_name", F.lit("\nCheck the port of "), "n_name", F.lit(".\n"))
    docs = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.concat(F.lit("# "), F.col("r_name"), F.lit("\n"), F.array_join(F.sort_array(F.collect_list(part)), "")).alias("text")).withColumnRenamed("r_name", "doc_id")
    return chunking.technical_chunks(docs, 2048).select("doc_id", "chunk_index", "start_char", "section_path", "section_id", "evidence_role")


def h13_chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of one paragraph are cut between words: where chunks start and how long they are add up."""
    docs = bind.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.repeat(F.lit("abcdefghi "), (F.col("p_size") * 10).cast("int")).alias("text"))
    got = chunking.paragraph_chunks(docs, 100, 0)
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start_char").alias("last"), F.max(F.length("chunk")).alias("longest"))


def j14_block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks over blocks of documents about parts: a heading, a paragraph, a figure, a table in two fragments, and a path that
    the reader gives."""
    p = bind.table(spark, sf, "part")
    none, path, cells = F.lit(None), F.array(F.lit("Annex"), "p_type"), F.array(*[F.array(F.lit(k), v) for k, v in (("K", F.lit("V")), ("a", F.col("p_size").cast("string")), ("b", F.lit("x")), ("c", F.col("p_name")))])
    block = lambda page, body, kind, text, section=none, rows=none: F.struct(F.lit(page).cast("int").alias("page"), F.lit(body).alias("body_index"), F.lit(kind).alias("kind"), text.alias("text"), section.cast("array<string>").alias("section_path"), rows.cast("array<array<string>>").alias("rows"))
    blocks = F.array(block(2, 4, "paragraph", F.concat(F.lit("kept "), "p_name"), path), block(1, 0, "heading", F.col("p_brand")), block(1, 1, "paragraph", F.concat("p_name", F.lit(" goes here."))), block(1, 2, "figure", F.lit("drawn")), block(1, 3, "table", none.cast("string"), none, cells))
    got = chunking.block_chunks(p.select(F.col("p_partkey").alias("doc_id"), F.explode(blocks).alias("b")).select("doc_id", "b.*"), 400)
    return got.select("doc_id", "chunk_index", "start_char", "section_id", "section_path", "page", "body_index", "locator", "chunk")


def j16_sheet_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of sheets, never cut, each chunk under the header row; here 5 rows fit."""
    p = bind.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).cast("string").alias("doc_id"), F.lit("s").alias("sheet"), (F.col("p_partkey") % 40 + 1).cast("int").alias("row_idx"), F.array(F.format_string("%08d", "p_partkey")).alias("cells"))
    heads = p.select("doc_id", "sheet").distinct().select("doc_id", "sheet", F.lit(0).alias("row_idx"), F.array(F.lit("Key")).alias("cells"))
    return chunking.chunked_sheets(p.unionByName(heads), 50).select("doc_id", "chunk_index", "chunk")

def j18_embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is embedded: a prefix, a section's or a document's heading, and the text, up to a length."""
    d = bind.table(spark, sf, "documents")
    section = F.when(F.col("doc_id") % 3 == 0, F.lit("A > B")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    whole = X.index_text(F.lit("Document: x"), section, F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.length(X.embed_text(whole, "passage: ", 300)).alias("n"), F.substring(X.embed_text(whole, "passage: ", 300), 1, 24).alias("head"))


def j19_repaired_records(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction records that lack a field get it."""
    p = bind.table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("<|#|>", F.lit("entity"), "p_name", "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat_ws("<|#|>", F.lit("relation"), "p_name", "p_brand", "p_type")).otherwise(F.concat_ws("<|#|>", F.lit("entity"), "p_name", "p_brand", "p_type"))
    return p.select("p_partkey", X.repair_extraction(line).alias("record"))


def j20_parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Objects in a model's answers, behind thoughts and in fences; null where there is none."""
    e = bind.table(spark, sf, "events")
    said = F.when(F.col("event_id") % 4 == 0, F.lit("I can't say")).otherwise(F.concat(F.lit('<think>{"user_id": 0}</think>```json\n{"user_id": '), "user_id", F.lit("}\n```")))
    return e.select("event_id", X.parse_model_json(said, "user_id long")["user_id"].alias("user_id"))


def _quotes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Answers that quote a supplier's passage: rightly, in the wrong case, from the preamble, from another's, or not at all."""
    s = bind.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Valve "), "s_suppkey", F.lit(" must NOT be open")).alias("own"))
    k = F.col("s_suppkey") % 5
    said = F.when(k == 0, F.col("own")).when(k == 1, F.lower("own")).when(k == 2, F.lit("A safe valve")).when(k == 3, F.lit("Valve 0 must NOT be shut")).otherwise(F.lit(None).cast("string"))
    cite = F.concat(F.lit(" [E"), "s_suppkey", F.lit("]."))
    answers = s.select(F.col("s_suppkey").alias("answer_id"), F.when(said.isNull(), F.concat(F.lit("It is open"), cite)).otherwise(F.concat(F.lit('It says "'), said, F.lit('"'), cite)).alias("answer"), F.lit("is it open?").alias("question"))
    evidence = s.select(F.col("s_suppkey").alias("answer_id"), F.concat(F.lit("E"), "s_suppkey").alias("evidence_id"), F.concat(F.lit("Document: a.pdf\nSummary: A safe valve.\n\n"), F.replace("own", F.lit(" must"), F.lit("\n must"))).alias("text"), F.lit("a.pdf").alias("filename"), F.lit("document").alias("kind"))
    return answers, evidence


def j21_quote_support(spark: SparkSession, sf: str) -> DataFrame:
    """Quotations that the cited passage doesn't have word for word: case counts, line breaks don't, a generated
    preamble supports nothing."""
    got = V.quote_checks(*_quotes(spark, sf))
    return got.select("answer_id", F.concat_ws("|", "unsupported").alias("unsupported"))


def j22_quoting_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that quote anything."""
    return V.quote_checks(*_quotes(spark, sf)).select("answer_id", "quoted")


def j23_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Citations by file, section and page, as far as they are known."""
    c = bind.catalog(spark, sf)
    return c.select("doc_id", V.citation_label(F.col("filename"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("label"))


def j24_reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """Answers without bullets in which a model thinks aloud; sentences that only begin alike stay, and so does a text of which
    over half would go."""
    p = bind.table(spark, sf, "part")
    plain = F.concat(F.lit("The user must log in first.\n* Constraint 1: short\nWait ten seconds.\n  * *Wait, no\n"), "p_name", F.lit("\n* Final check\n"))
    listed = F.concat(F.lit("* Question: \"what?\"\n* "), "p_name", F.lit("\n* Plan: none\nLet me say: "), "p_brand")
    far = F.concat(F.lit("* Task: "), F.repeat("p_name", 40), F.lit("\nyes"))
    text = F.when(F.col("p_partkey") % 3 == 0, plain).when(F.col("p_partkey") % 3 == 1, listed).otherwise(far)
    return p.select("p_partkey", V.without_reasoning(text).alias("answer"))


def j25_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """What answers' envelopes state: a status line with an answer, missing details or an abstention; JSON; plain text; and
    what is none of these."""
    name, n = F.col("p_name"), F.col("p_partkey") % 12
    forms = [
        F.concat(F.lit("<think>hm</think>STATUS: answer\n"), name), F.concat(F.lit("Answer: STATUS: answer\n"), name), F.concat(F.lit("STATUS: insufficient_evidence\nbut perhaps "), name),
        F.lit("STATUS: clarification\nsite, ,platform"), F.concat(F.lit("status: none\n"), name), F.concat(F.lit("Well, STATUS: answer\n"), name), F.lit("STATUS: answer\n \n"),
        F.concat(F.lit('```json\n{"status": "answer", "answer": "'), name, F.lit('"}\n```')), F.concat(F.lit('{"status": "answer", "answer": "'), name), F.lit('{"status": "insufficient_evidence"}'),
        F.concat(F.lit("[E1] says "), name), F.lit('["a", "b"]'),
    ]
    text = F.element_at(F.array(*forms), (n + 1).cast("int"))
    return bind.table(spark, sf, "part").select("p_partkey", V.envelope(text).alias("e")).select("p_partkey", "e.status", "e.answer", F.concat_ws(",", "e.missing_details").alias("missing"))


def j26_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Version, environment and product that users named last."""
    p, n = bind.table(spark, sf, "part"), F.col("p_partkey") % 3
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    question = F.when(n == 0, F.concat(F.lit("we run firmware v"), version, F.lit(" in prod"))).when(n == 1, "and now?").otherwise(F.concat(F.lit("hello "), "p_name"))
    turns = F.when(n == 1, F.array(F.concat(F.lit("Product: Core Router, release "), version), F.lit("in the lab")))
    return editions.request_contexts(p.select("p_partkey", question.alias("question"), turns.alias("turns"))).select("p_partkey", "context.*")

def j29_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about a drawing without the words that ask for it."""
    n = bind.table(spark, sf, "nation")
    q = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Please show me the ports of "), "n_name", F.lit(" as a Mermaid diagram?"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("draw "), "n_name", F.lit(" using mermaid"))).otherwise(F.concat(F.lit("show "), "n_name"))
    return n.select("n_nationkey", L.retrieval_subject(q).alias("subject"))


def j31_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of Markdown tables without their rule, and of comma-separated lines, in answers about parts."""
    p = bind.table(spark, sf, "part")
    marked = F.concat(F.lit("| Name | N |\n| --- | :-: |\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n"))
    text = F.when(F.col("p_partkey") % 2 == 0, marked).otherwise(F.concat("p_name", F.lit(", "), F.col("p_size").cast("string"), F.lit("\n\n"), "p_brand", F.lit(",x")))
    return L.table_rows(p.select("p_partkey", text.alias("text")), "text").select("p_partkey", "place", F.concat_ws("|", "cells").alias("cells"))

def j34_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a comma-separated text, and those of a new document: given, else its dataset's, else the caller's."""
    e = bind.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.concat(F.col("event_type"), F.lit(" , ALL"))).otherwise(F.concat(F.lit(" x, ,"), "event_type"))
    none = F.array().cast("array<string>")
    given = access.ingest_groups(F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(none), F.when(F.col("event_id") % 3 == 1, F.array(F.lit("set"))), F.array(F.lit("me")))
    return e.select("event_id", F.concat_ws(",", access.parse_groups(text)).alias("groups"), F.concat_ws(",", given).alias("document_groups"))


def j37_key_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests and visible prefixes of keys, and which failures are worth another try."""
    c = bind.table(spark, sf, "customer")
    return c.select("c_custkey", X.key_digest(F.col("c_name")).alias("k"), X.failure_kind(F.when(F.col("c_custkey") % 2 == 0, "connection").otherwise("schema")).alias("failure")).select("c_custkey", "k.key_hash", "k.key_prefix", "failure")


def j39_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines set larger than the page's median, or named as headings; captions."""
    l = bind.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("font"), F.when(F.col("l_linenumber") == 2, "Section 2").when(F.col("l_linenumber") == 3, " Fig. 3 a map").otherwise("prose").alias("text"))
    m = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("font")).alias("fonts")).select("l_orderkey", F.get("fonts", F.floor(F.size("fonts") / 2).cast("int")).alias("median"))
    return l.join(m, "l_orderkey").select("l_orderkey", "l_linenumber", U.is_heading(F.col("text"), F.col("font"), F.col("median")).alias("heading"), U.is_caption(F.col("text")).alias("caption"))


def k2_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """K2: numbers are measures, all else keys."""
    stats = K.classify(bind.grid(spark, sf)).select("doc_id", "dtypes").collect()  # a row for each sheet
    return spark.createDataFrame([(r["doc_id"], ",".join(K.profile(r["dtypes"]))) for r in stats], "doc_id string, profile string")


def x9_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each figure the last lines above and the first below it on its page."""
    l = bind.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") * 10).alias("top"), F.concat(F.lit("line "), "l_linenumber").alias("text"))
    figures = bind.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("f").alias("figure_id"), F.lit(35).alias("top"))
    return U.nearest_context(figures, l, 2, 1).select("doc_id", "context")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Streamed answers in pieces: markers in prose, in inline code, in links, behind a backslash, unknown ones, and inside a fence
    of four signs that holds one of three."""
    s = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("answer_id"))
    k = F.concat(F.lit("E"), F.col("answer_id").cast("string"))
    text = F.concat(F.lit("a `["), k, F.lit("]` [t]("), k, F.lit(") [Eq] \\["), k, F.lit("]\nfirst ["), k, F.lit("], here\n\n````\n["), k, F.lit("]\n```\n["), k, F.lit("]\n````\n\nlast [Ez] ["), k, F.lit("]\nend"))
    whole = s.select("answer_id", text.alias("a"), (F.col("answer_id") % 29 + 3).cast("int").alias("cut"))
    first, second = whole.select("answer_id", F.lit(0).alias("n"), F.expr("substring(a, 1, cut)").alias("text")), whole.select("answer_id", F.lit(1).alias("n"), F.expr("substring(a, cut + 1)").alias("text"))
    return first.unionByName(second)


def x11_placed_images(spark: SparkSession, sf: str) -> DataFrame:
    """Where figures of streamed answers are shown: after the paragraph that cites them first, by no marker in code, links
    or behind a backslash."""
    ids = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("answer_id"))
    images = ids.select("answer_id", F.explode(F.array(*[F.struct(e.alias("evidence_id"), F.lit("d").alias("doc_id"), F.lit(f).alias("figure_id")) for e, f in ((F.concat(F.lit("E"), F.col("answer_id").cast("string")), "1"), (F.lit("Ez"), "2"), (F.lit("Enone"), "3"))])).alias("i")).select("answer_id", "i.*")
    return W.placed_images(W.streamed_lines(_answers(spark, sf)), images).select("answer_id", "line_no", F.concat_ws(",", "images").alias("images"))


def p7_streamed_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of streamed answers with citations as numbers; code, links and unknown markers stay as they are."""
    ids = bind.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("answer_id"), F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("evidence_id"), (F.col("s_suppkey") % 7).alias("number"))
    return W.rendered_citations(W.streamed_lines(_answers(spark, sf)), ids).select("answer_id", "line_no", "line", "code")


def x29_clarifications(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that would tell which edition applies."""
    e = bind.table(spark, sf, "events")
    missing = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("site"), F.lit("colour"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("colour"))).otherwise(F.array(F.lit("platform"), F.lit("environment")))
    return e.select("event_id", F.length(W.clarification(missing, ("site", "platform"))).alias("n"))


def h10_packed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """An answer's best documents packed into a budget, rows halved until they fit, texts in bins and combined."""
    rows = bind.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("n_chars") % 101).cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(40).collect()  # a top-k
    packed = V.pack([{"doc_id": r["doc_id"], "text": r["text"], "score": r["score"]} for r in rows], 20_000)
    fitting = V.rows_that_fit([{"id": r["doc_id"]} for r in rows], 200)
    bins = V.batches(["x" * (1 + r["doc_id"] % 50) for r in rows], 100)
    joined = V.reduced(["x" * (1 + r["doc_id"] % 50) for r in rows], "".join, 100)
    return spark.createDataFrame([("within budget", int(sum(len(p["text"]) for p in packed) <= 20_000)), ("rows", len(fitting)), ("bins within budget", int(all(sum(map(len, b)) <= 100 or len(b) == 1 for b in bins))), ("combined", len(joined))], "what string, n long")


def q4_mapped_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A call for each document: what fails or has nothing to say is marked and stops nobody."""

    def call(text: str) -> str:
        if len(text) % 7 == 0:
            raise ValueError("no")
        return "NO_RELEVANT_DATA" if len(text) % 7 == 1 else text[:3]

    d = bind.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return Q.mapped(d, "text", call).select("doc_id", "status", F.when(F.col("status") == "ok", F.col("extract")).alias("extract"))


def q7_extracted_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: what a model says about documents, parsed; failed calls and answers without JSON give nulls."""
    from docloom.operators import ingest as I

    def call(text: str) -> str:
        if len(text) % 5 == 0:
            raise ConnectionError("gone")
        return "nothing" if len(text) % 5 == 1 else '{"summary": "%d characters", "topics": ["a", "b"]}' % len(text)

    d = bind.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return I.extracted_metadata(d, call, longest=1000).select("doc_id", "metadata.summary", F.concat_ws(",", "metadata.topics").alias("topics"))


def c10_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that name the month and day of a question."""
    o = bind.table(spark, sf, "orders").select("o_orderkey", F.array(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("dates"), F.concat(F.lit("order-"), F.date_format("o_orderdate", "MM-dd"), F.lit(".pdf")).alias("filename"))
    return o.filter(R.date_condition("what came on March 5th?", F.when(F.col("o_orderkey") % 2 == 0, F.col("dates")), F.col("filename"))).select("o_orderkey")


def c26_navigation(spark: SparkSession, sf: str) -> DataFrame:
    """Names found in passages that aren't navigation, junk left out."""
    n = bind.table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("chunk_index"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("Site map. Privacy policy. Alpha Beta")).otherwise(F.concat(F.lit("The port of "), F.initcap("n_name"), F.lit(" is open. Table"))).alias("text"))
    return M.extract(n, M.capitalised).select("doc_id", "name")


ORACLE_SQL = {
    "j14_block_chunks": """with c as (select p_partkey as doc_id, unnest([0, 1, 2, 3]) as k, unnest([p_brand, p_brand, p_brand, 'Annex > ' || p_type]) as path, unnest([1, 1, 1, 2]) as page, unnest([1, 3, 3, 4]) as body,
            unnest([p_name || ' goes here.', 'K | V' || chr(10) || 'a | ' || p_size || chr(10) || 'b | x', 'K | V' || chr(10) || 'c | ' || p_name, 'kept ' || p_name]) as chunk from part)
        select doc_id, k::int as chunk_index, coalesce(sum(length(chunk)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::int as start_char, substr(sha256(path), 1, 16) as section_id, path as section_path,
            page::int as page, body::int as body_index, 'page ' || page || ', body block ' || body || '; ' || path as locator, chunk from c""",
    "j5_column_names": "select p_partkey, concat_ws(',', regexp_replace(lower(p_brand), '[^0-9a-z]+', '_', 'g'), regexp_replace(lower(p_brand), '[^0-9a-z]+', '_', 'g') || '_1', 'col_2', 'col_3', 'c_' || p_size || '_x', 'gr_e') as names from part",
    "j16_sheet_chunks": """with r as (select p_partkey // 40 as d, p_partkey % 40 as i, p_partkey from part), n as (select *, row_number() over (partition by d order by i) - 1 as k from r)
        select d::varchar as doc_id, (k // 5)::int as chunk_index, 'Key' || chr(10) || string_agg(lpad(p_partkey::varchar, 8, '0'), chr(10) order by k) as chunk from n group by d, k // 5""",
    "j26_contexts": """select p_partkey, case when p_partkey % 3 < 2 then p_size || '.' || p_partkey % 10 else '' end as software_version, ['production', 'lab', ''][p_partkey % 3 + 1] as environment, case when p_partkey % 3 = 1 then 'core router' else '' end as product from part""",
    "j31_table_rows": """select p_partkey, place, cells from (select p_partkey, unnest([0, 1]) as place, unnest(case when p_partkey % 2 = 0 then ['Name|N', p_name || '|' || p_size] else [p_name || '|' || p_size, p_brand || '|x'] end) as cells from part)""",
    "j24_reasoning": """select p_partkey, case p_partkey % 3 when 0 then 'The user must log in first.' || chr(10) || 'Wait ten seconds.' || chr(10) || p_name when 1 then '* ' || p_name || chr(10) || 'Let me say: ' || p_brand
        else '* Task: ' || repeat(p_name, 40) || chr(10) || 'yes' end as answer from part""",
    "j25_envelopes": """select p_partkey, case p_partkey % 12 when 0 then 'answer' when 1 then 'answer' when 2 then 'insufficient_evidence' when 3 then 'clarification' when 4 then 'plain' when 7 then 'answer' when 9 then 'insufficient_evidence' when 10 then 'plain' else 'invalid' end as status,
        case p_partkey % 12 when 0 then p_name when 1 then p_name when 4 then 'status: none' || chr(10) || p_name when 7 then p_name when 10 then '[E1] says ' || p_name end as answer, case when p_partkey % 12 = 3 then 'site,platform' else '' end as missing from part""",
    "x11_placed_images": "select s_suppkey as answer_id, 1::int as line_no, 'd/1' as images from supplier union all select s_suppkey, 10, 'd/2' from supplier",
    "p7_streamed_citations": r"""with t as (select s_suppkey as answer_id, 'E' || s_suppkey as k, s_suppkey % 7 as n from supplier)
        select answer_id, line_no::int as line_no, line, line_no between 3 and 7 as code from (select answer_id, unnest(range(0, 11)) as line_no,
            unnest(['a `[' || k || ']` [t](' || k || ') [Eq] \[' || k || ']', 'first [' || n || '], here', '', '````', '[' || k || ']', '```', '[' || k || ']', '````', '', 'last [Ez] [' || n || ']', 'end']) as line from t)""",
    "j4_numbers": "select p_partkey, case when p_partkey % 5 > 1 then round(p_retailprice, 2) end as value from part",
    "j7_blobs": "select p_partkey, lower(p_brand || ' ' || p_type || case when p_partkey % 2 = 0 then ' ' || p_name else '' end) as blob from part",
    "j12_identifiers": "select conv_id as doc_id, turn as chunk_index, 'E' || substr(sha256('(' || conv_id || ', ''medium'', ' || turn || ', 0, ''text'', None)' || chr(0) || text), 1, 12) as evidence_id from conversations",
    "j14_sections": """with n as (select r_name as doc_id, n_name, row_number() over (partition by r_name order by '## ' || n_name) as i from nation join region on n_regionkey = r_regionkey),
        s as (select doc_id, i, n_name, '## ' || n_name || chr(10) || 'Check the port of ' || n_name || '.' || chr(10) as t from n), u as (select doc_id, 0 as i, doc_id as path, '# ' || doc_id || chr(10) as t, '' as roles from (select distinct doc_id from n) union all select doc_id, i, doc_id || ' > ' || n_name, t, 'diagnostics' from s)
        select doc_id, i::int as chunk_index, coalesce(sum(length(t)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::int as start_char, path as section_path, substr(sha256(path), 1, 16) as section_id, roles as evidence_role from u""",
    "h13_chunk_offsets": "select p_partkey as doc_id, p_size::bigint as n, (p_size - 1) * 100 as last, 99::int as longest from part",
    "j18_embedded_texts": """with w as (select doc_id, 'passage: ' || case doc_id % 3 when 0 then 'Section: A > B' || chr(10) || chr(10) when 1 then '' else 'Document: x' || chr(10) || chr(10) end || coalesce(text, '') as t from documents)
        select doc_id, least(300, length(t))::int as n, substr(t, 1, 24) as head from w""",
    "j19_repaired_records": "select p_partkey, case p_partkey % 3 when 0 then 'entity<|#|>' || p_name || '<|#|>category<|#|>' || p_type when 1 then 'relation<|#|>' || p_name || '<|#|>' || p_brand || '<|#|>related<|#|>' || p_type else 'entity<|#|>' || p_name || '<|#|>' || p_brand || '<|#|>' || p_type end as record from part",
    "j20_parsed_answers": "select event_id, case when event_id % 4 != 0 then user_id end as user_id from events",
    "j21_quote_support": """select s_suppkey as answer_id, case s_suppkey % 5 when 1 then lower('Valve ' || s_suppkey || ' must NOT be open') when 2 then 'A safe valve' when 3 then 'Valve 0 must NOT be shut' else '' end as unsupported from supplier""",
    "j22_quoting_answers": "select s_suppkey as answer_id, s_suppkey % 5 != 4 as quoted from supplier",
    "j23_labels": f"with {bind.CATALOG} select doc_id, filename || case when doc_id % 2 = 1 then ', ' || lang else '' end || case when doc_id % 3 = 0 then ', p. ' || doc_id else '' end as label from catalog",
    "j29_subjects": "select n_nationkey, case n_nationkey % 3 when 0 then 'the ports of ' || n_name when 1 then n_name else 'show ' || n_name end as subject from nation",
    "j34_groups": "select event_id, case event_id % 4 when 0 then 'ALL' when 1 then 'ALL' else 'x,' || event_type end as groups, case event_id % 3 when 0 then event_type when 1 then 'set' else 'me' end as document_groups from events",
    "j37_key_digests": "select c_custkey, sha256(c_name) as key_hash, substr(c_name, 1, 8) as key_prefix, case when c_custkey % 2 = 0 then 'transient' else 'permanent' end as failure from customer",
    "j39_headings": """with m as (select l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as median from lineitem group by 1)
        select l_orderkey, l_linenumber, l_quantity >= 1.15 * median or l_linenumber = 2 as heading, l_linenumber = 3 as caption from lineitem join m using (l_orderkey)""",
    "k2_profiles": "select * from (values ('part', 'key,key,measure,measure'), ('supplier', 'key,' || (select case when 2 * count(case when s_suppkey % 2 = 1 then 1 end) > count(*) then 'measure' else 'key' end from supplier) || ',measure')) t(doc_id, profile)",
    "x9_contexts": """with l as (select l_orderkey as doc_id, l_linenumber as k, 'line ' || l_linenumber as t from lineitem), a as (select *, row_number() over (partition by doc_id, k < 4 order by abs(k * 10 - 35), t) as p from l)
        select doc_id, string_agg(t, chr(10) order by k, t) as context from a where doc_id in (select o_orderkey from orders) and p <= case when k < 4 then 2 else 1 end group by 1""",
    "x29_clarifications": "select event_id, (case event_id % 3 when 0 then 41 + 2 + length('Which site or deployment does this apply to?') when 2 then 41 + 2 + length('Which SD-WAN platform or product does this apply to?') end)::int as n from events",
    "h10_packed_evidence": """with d as (select doc_id from documents order by n_chars % 101 desc, doc_id limit 40)
        select 'within budget' as what, 1::bigint as n union all select 'rows', case when 40 <= 10 then 40 else (select case when length(string_agg('{"id": ' || doc_id || '}', ', ')) + 2 <= 200 then 40 else 10 end from d) end
        union all select 'bins within budget', 1 union all select 'combined', sum(1 + doc_id % 50)::bigint from d""",
    "q4_mapped_documents": "select doc_id, case length(coalesce(text, '')) % 7 when 0 then 'failed' when 1 then 'empty' else case when trim(substr(text, 1, 3)) = '' then 'empty' else 'ok' end end as status, case when length(coalesce(text, '')) % 7 > 1 and trim(substr(text, 1, 3)) != '' then substr(text, 1, 3) end as extract from documents",
    "q7_extracted_metadata": """with d as (select doc_id, length(substr(coalesce(text, ''), 1, 1000)) as n from documents) select doc_id, case when n % 5 > 1 then n || ' characters' end as summary, case when n % 5 > 1 then 'a,b' else '' end as topics from d""",
    "c10_dates": "select o_orderkey from orders where month(o_orderdate) = 3 and (day(o_orderdate) = 5 or (o_orderkey % 2 = 0 and day(o_orderdate) between 50 and 59))",
    "c26_navigation": """with n as (select n_nationkey as doc_id, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as t from nation where n_nationkey % 4 != 0),
        l as (select doc_id, unnest(regexp_extract_all('The port of ' || t || ' is open. Table', '\\b([A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*)', 1)) as name from n) select distinct doc_id, name from l where lower(name) not in ('the', 'table')""",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
