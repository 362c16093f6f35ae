"""The test tables in the roles of the engine's relations, on Spark and, as WITH clauses, in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.session import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as catalog: types by number, source as category (every seventh has none), two groups each. Every fifth may share its
    file name with others."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 400).otherwise(F.col("doc_id")), F.lit(".txt")).alias("filename"),
        F.get(F.array(F.lit("pdf"), F.lit("docx"), F.lit("txt")), (F.col("doc_id") % 3).cast("int")).alias("doc_type"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")).alias("category"),
        (F.col("doc_id") % 5).alias("dataset_id"),
        F.array(F.concat(F.lit("g"), F.col("doc_id") % 4), F.when(F.col("doc_id") % 10 == 0, "ALL").otherwise(F.concat(F.lit("h"), F.col("doc_id") % 6))).alias("acl_groups"),
        "lang",
        "text",
        "n_chars",
    )


CATALOG = """
catalog as (
  select doc_id, 'doc-' || case when doc_id % 5 = 0 then doc_id % 400 else doc_id end || '.txt' as filename,
         case doc_id % 3 when 0 then 'pdf' when 1 then 'docx' else 'txt' end as doc_type,
         case when doc_id % 7 = 0 then '' else source end as category, doc_id % 5 as dataset_id,
         ['g' || (doc_id % 4), case when doc_id % 10 = 0 then 'ALL' else 'h' || (doc_id % 6) end] as acl_groups,
         lang, text, n_chars
  from documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks of documents of ten, in two tiers."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.floor(F.col("vec_id") / 10).alias("doc_id"),
        (F.col("vec_id") % 10).alias("chunk_index"),
        F.when(F.col("vec_id") % 20 < 10, "medium").otherwise("large").alias("chunk_size_tier"),
        F.array(F.concat(F.lit("g"), F.floor(F.col("vec_id") / 20) % 4)).alias("acl_groups"),
        F.lit("text").alias("content_type"),
        "label",
    )


CHUNKS = """
chunks as (
  select vec_id as id, embedding as vector, vec_id // 10 as doc_id, vec_id % 10 as chunk_index,
         case when vec_id % 20 < 10 then 'medium' else 'large' end as chunk_size_tier,
         ['g' || ((vec_id // 20) % 4)] as acl_groups, 'text' as content_type, label
  from embeddings)"""


def query_vector(spark: SparkSession, sf_dir: str, key: int = 7) -> list[float]:
    """A question's vector: that of one row, as an embedding function would give it."""
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == key).select("embedding").first()[0])


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as feedback on documents; the last event is now."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.sha2((F.col("event_id") % 100).cast("string").cast("binary"), 256).alias("query_hash"),
        (F.col("event_id") % 100).alias("q"),
        (F.col("user_id") % 50).alias("doc_id"),
        (F.col("event_type") == "purchase").alias("was_cited"),
        F.col("event_type").isin("purchase", "click", "view").alias("was_relevant"),
        F.col("ts").alias("created_at"),
    )


FEEDBACK = """
feedback as (
  select event_id as id, sha256((event_id % 100)::varchar) as query_hash, event_id % 100 as q, user_id % 50 as doc_id,
         event_type = 'purchase' as was_cited, event_type in ('purchase', 'click', 'view') as was_relevant, ts as created_at
  from events)"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as strategy memory: users' groups are patterns, event types strategies."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 8).alias("pattern"), F.col("event_type").alias("strategy"), (F.col("event_id") % 5).alias("cited"), (F.col("event_id") % 7).alias("relevant"), (F.col("event_id") % 11).alias("discovered"), F.col("value").alias("seconds"))


MEMORY = """
memory as (
  select user_id % 8 as pattern, event_type as strategy, event_id % 5 as cited, event_id % 7 as relevant,
         event_id % 11 as discovered, value as seconds
  from events)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as links of a graph: customer-nation, supplier-nation, nation-region, order-customer."""
    c, s, n, o = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation", "orders"))

    def link(df: DataFrame, a: str, ak: str, b: str, bk: str, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(ak)).alias("source"), F.concat(F.lit(b), F.col(bk)).alias("target"), F.lit(kind).alias("relation_type"))

    return (
        link(c, "c", "c_custkey", "n", "c_nationkey", "lives_in")
        .unionByName(link(s, "s", "s_suppkey", "n", "s_nationkey", "based_in"))
        .unionByName(link(n, "n", "n_nationkey", "r", "n_regionkey", "part_of"))
        .unionByName(link(o, "o", "o_orderkey", "c", "o_custkey", "placed_by"))
    )


EDGES = """
edges as (
  select 'c' || c_custkey as source, 'n' || c_nationkey as target, 'lives_in' as relation_type from customer
  union all select 's' || s_suppkey, 'n' || s_nationkey, 'based_in' from supplier
  union all select 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' from nation
  union all select 'o' || o_orderkey, 'c' || o_custkey, 'placed_by' from orders)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    return (
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"))
        .unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("name"), F.lit("region").alias("entity_type")))
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type")))
    )


ENTITIES = """
entities as (
  select 'n' || n_nationkey as node, n_name as name, 'nation' as entity_type from nation
  union all select 'r' || r_regionkey, r_name, 'region' from region
  union all select 's' || s_suppkey, s_name, 'supplier' from supplier)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier and part rows as untyped sheets: a header row, then cells as text; every 17th part cell is odd."""
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier")
    head = spark.createDataFrame(
        [("part", "parts", 0, ["Part Name", "Brand", "Size (cm)", "Retail Price"]), ("supplier", "suppliers", 0, ["Supplier", "Nation", "Balance"])],
        "doc_id string, sheet string, row_idx int, cells array<string>",
    )
    parts = p.select(
        F.lit("part").alias("doc_id"), F.lit("parts").alias("sheet"), (F.col("p_partkey") + 1).cast("int").alias("row_idx"),
        F.array("p_name", "p_brand", F.when(F.col("p_partkey") % 17 == 0, "n/a").otherwise(F.col("p_size").cast("string")), F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice"))).alias("cells"),
    )
    sups = s.select(
        F.lit("supplier").alias("doc_id"), F.lit("suppliers").alias("sheet"), (F.col("s_suppkey") + 1).cast("int").alias("row_idx"),
        F.array("s_name", F.when(F.col("s_suppkey") % 2 == 0, "n/a").otherwise(F.col("s_nationkey").cast("string")), F.format_string("%.2f", "s_acctbal")).alias("cells"),
    )
    return head.unionByName(parts).unionByName(sups)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A new folder with these few small files, in whatever store the shared folder is."""
    path = folder(spark, "files")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, data in files.items():
        out = fs.create(hadoop(f"{path}/{name}"))
        out.write(bytearray(data))
        out.close()
    return path


_INDEXES: dict[tuple[str, str], R.TermIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> R.TermIndex:
    """The term index of documents, written once a session."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _INDEXES:
        _INDEXES[name] = R.TermIndex.write(catalog(spark, sf_dir), folder(spark, "terms"), "doc_id")
    return _INDEXES[name]
