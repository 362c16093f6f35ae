"""Recognised pages, figures and lines of characters over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import scans as S
from docloom.queries import bind


def j30_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of text boxes on a page, here an order's lines under each other with holes, and their text."""
    l = bind.table(spark, sf, "lineitem").filter("l_quantity > 12").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.format_string("%03d", "l_linenumber").alias("box_id"), (F.col("l_linenumber") * 10).cast("double").alias("top"), F.concat(F.lit("port "), F.col("l_partkey").cast("string")).alias("text"))
    boxes = l.withColumn("x0", F.lit(20.0)).withColumn("x1", F.lit(120.0)).withColumn("bottom", F.col("top") + 8)
    return S.box_regions(boxes, 3.0).select("doc_id", "region", "top", "bottom", "n", "text")


def j30_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of recognised regions: grids of networks, paragraphs, drawings of networks and of processes, labels, next to nothing."""
    p, n = bind.table(spark, sf, "part"), F.col("p_partkey")
    name = F.col("p_name")
    prose = F.concat(name, F.lit(" is a sentence that goes on and on until its line is long\n"))
    forms = [
        F.concat(F.lit("Subnets of "), name, F.lit("\n10.0.0.0/8 uplink of the plant\n10.1.0.0/16 cells\n")), F.repeat(prose, 4),
        F.concat(F.lit("router a\nfirewall b\nvlan c\n"), name, F.lit("\nlink\n")), F.concat(F.lit("phase one\nphase two\nprepare\n"), name, F.lit("\nstep\n")),
        F.concat(name, F.lit(" at 10.0.0.1 and 10.0.0.2 in the rack of the hall")), F.lit("start"), F.lit("a photo"),
    ]
    text = F.element_at(F.array(*forms), (n % 7 + 1).cast("int"))
    return p.select("p_partkey", S.region_kind(text, F.when(n % 2 == 0, 800).otherwise(450), F.lit(400)).alias("kind"))


def j30_kept(spark: SparkSession, sf: str) -> DataFrame:
    """What recognised text names and a description lacks: links, addresses, acronyms; nothing that is there or garbled."""
    p, n = bind.table(spark, sf, "part"), F.col("p_partkey").cast("string")
    text = F.concat(F.lit("see https://h"), n, F.lit(".example.com/x.\nbut 10.0."), F.col("p_size").cast("string"), F.lit(".7/24 by bgp,\nqq zz |[x\n"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a drawing of BGP at https://h"), n, F.lit(".example.com/x"))).otherwise("a drawing")
    got = S.kept_tokens(p.select("p_partkey", text.alias("text"), said.alias("description")))
    return got.select("p_partkey", F.concat_ws(" ", "kept").alias("kept"), F.length(S.merged_description(F.col("description"), F.col("kept"))).alias("n"))


def x33_line_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts set in sheared letters without visible gaps: words come apart where origins and advances say so; level
    letters, and lines that lack a figure, stay as they were read."""
    p = bind.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    letters = p.select("p_partkey", "name", F.posexplode(F.split("name", "")).alias("place", "char")).filter("char != ' ' and char != ''")
    origin = F.col("place") * 10.0  # a space is a place without a letter
    c = letters.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("line_id"), "place", "char", F.replace("name", F.lit(" "), F.lit("")).alias("text"), F.lit(True).alias("upright"), F.lit(12.0).alias("a"), F.lit(0.0).alias("b"),
                       F.when(F.col("p_partkey") % 3 == 1, 0.0).otherwise(2.5).alias("c"), F.lit(12.0).alias("d"), origin.alias("e"), F.when((F.col("p_partkey") % 3 == 2) & (F.col("place") == 0), None).otherwise(0.8).alias("advance"), F.lit(12.0).alias("size"))
    return S.line_texts(c).select("doc_id", "text")


def x33_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """figures' texts under their labels with what the document says about them, and the hint for whoever describes them."""
    p, odd = bind.table(spark, sf, "part"), F.col("p_partkey") % 2 == 1
    section, caption = F.when(odd, F.array(F.lit("Parts"), "p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("[Figure 1 — network]\n"), "p_name", F.lit("\n[/Figure]"))).otherwise(F.col("p_name"))
    none = F.lit(None).cast("string")
    return p.select("p_partkey", S.placed_figure(text, F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.lit("other"), section, caption, none).alias("text"), F.length(S.context_of_figure(section, caption, none, F.repeat("p_name", 300), none)).alias("n"))


ORACLE_SQL = {
    "j30_regions": """with l as (select l_orderkey as doc_id, l_linenumber as k, 'port ' || min(l_partkey) as t from lineitem where l_quantity > 12 group by 1, 2), i as (select *, k - row_number() over (partition by doc_id order by k) as island from l)
        select doc_id, lpad(min(k)::varchar, 3, '0') as region, min(k) * 10::double as top, max(k) * 10 + 8::double as bottom, count(*) as n, string_agg(t, chr(10) order by k) as text from i group by doc_id, island""",
    "j30_kinds": "select p_partkey, case p_partkey % 7 when 0 then 'table' when 1 then 'text_scan' when 2 then case when p_partkey % 2 = 0 then 'network' else 'other' end when 3 then case when p_partkey % 2 = 0 then 'process' else 'other' end when 4 then 'network' when 5 then 'process' else 'other' end as kind from part",
    "j30_kept": """with k as (select p_partkey, 'https://h' || p_partkey || '.example.com/x' as u, '10.0.' || p_size || '.7/24' as a from part), s as (select *, case when p_partkey % 2 = 0 then 'a drawing of BGP at ' || u else 'a drawing' end as d, case when p_partkey % 2 = 0 then a else u || ' ' || a end as kept from k)
        select p_partkey, kept, length(d) + length('Also visible (OCR identifiers not in description):') + 2 + length('- ' || replace(kept, ' ', chr(10) || '- ')) as n from s""",
    "x33_line_texts": "select p_partkey as doc_id, case when p_partkey % 3 = 0 then p_name else replace(p_name, ' ', '') end as text from part",
    "x33_contexts": """with f as (select p_partkey, p_name, case when p_partkey % 2 = 1 then 'Section: Parts > ' || p_brand end as s, case when p_partkey % 3 = 0 then 'Caption: ' || p_type end as c, 'f' || p_partkey || ' — ' || case when p_partkey % 5 = 0 then 'network' else 'other' end as label from part)
        select p_partkey, concat_ws(chr(10), '[Figure ' || label || ']', s, c, p_name, '[/Figure]') as text,
        length(chr(10) || chr(10) || 'DOCUMENT CONTEXT (use to disambiguate the image, but do not report context text as visually observed unless you can confirm it in the image):' || chr(10) || concat_ws(chr(10), s, c, 'Text immediately before: ' || substr(repeat(p_name, 300), 1, 1000))) as n from f""",
}

QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
