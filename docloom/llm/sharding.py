"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. A bucket over the byte limit is split on its next bit, others
stay as they are, until every shard fits. Bytes are summed up by hash prefix before anything is decided, so that rows move
once, and only buckets that even the finest prefix leaves too large are looked at again, some bits further on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm._common import checkpoint

#: Bits of the hash: 15 hexadecimal digits of an MD5, any SQL engine has them.
BITS = 60
#: Bits beyond what even sizes would need that are summed up at once, and bits by which a look goes further.
SPARE, STEP = 4, 6
#: Production limit of a shard's bytes.
LIMIT = 1 << 20


def row_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key as text (null: empty), as a long of 0 or more."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hash_: Column, depth: Column) -> Column:
    return F.call_function("shiftright", hash_, (F.lit(BITS) - depth).cast("int"))


def _split(sums: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """From bytes by prefix p of high bits to the shards among depths low to high: depth, prefix, open.

    Of each p it is the shallowest depth at which the bucket fits or is one row; open ones fit at none.
    """
    levels = sums.select("p", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("q", F.call_function("shiftright", F.col("p"), (F.lit(high) - F.col("depth")).cast("int")))
    fits = levels.groupBy("depth", "q").agg(F.sum("bytes").alias("all"), F.sum("n").alias("n")).withColumn("fits", (F.col("all") <= limit) | (F.col("n") == 1))
    at = levels.join(fits.filter("fits").select("depth", "q"), ["depth", "q"]).groupBy("p").agg(F.min("depth").alias("depth"))
    return sums.select("p").join(at, "p", "left").withColumn("open", F.col("depth").isNull()).withColumn("depth", F.coalesce("depth", F.lit(high)))


def _placed(rows: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """rows (h, n_bytes and more) with their depth, in parts, and those that no number of bits can tell apart, if any."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    low, high = 0, min(BITS, SPARE + max(0, math.ceil(math.log2(max(1, total / limit)))))
    left, done = rows, []
    while True:
        p = _prefix(F.col("h"), F.lit(high))
        sums = checkpoint(left.groupBy(p.alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
        found = checkpoint(_split(sums, low, high, limit))
        placed = left.withColumn("p", p).join(found, "p").drop("p")
        done.append(placed.filter("not open").select(*rows.columns, "depth"))
        if found.filter("open").isEmpty():
            return done, None
        left = placed.filter("open").select(*rows.columns)
        if high == BITS:
            return done, checkpoint(left)
        left = checkpoint(left)
        low, high = high + 1, min(BITS, high + STEP)


def _rows(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """h, n_bytes and more of each row; all the operator's own names begin with two underscores or are h, n_bytes."""
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long")
    return docs.select(F.col(key).alias("__k"), size.alias("n_bytes"), row_hash(F.col(key)).alias("h"), *more)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: key, n_bytes (null text: 0), depth and prefix of its bucket, page, shard_id.

    shard_id is depth:prefix:page. No shard exceeds limit bytes, but for a single row that does so alone, as a very long text
    may: its bucket is split until it is alone. Rows of one key can't be told apart by hash bits; where they exceed the limit
    together, they overflow onto pages 1, 2, ... of their bucket, each filled to the limit. Null keys count as the empty key.
    An empty table gives an empty table. Other columns of docs may have any names.
    """
    plain, k, t = _plain(docs, key, text)
    done, left = _placed(checkpoint(_rows(plain, k, t, F.spark_partition_id().alias("__part"))), limit)
    out = _union(done).withColumn("page", F.lit(0).cast("long"))
    return _named(out if left is None else out.unionByName(_paged(left, limit)), key)


def _plain(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str, str]:
    """docs with its columns named by their position, and the new names of key and text."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return plain, plain.columns[docs.columns.index(key)], plain.columns[docs.columns.index(text)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _shard() -> list[Column]:
    prefix = _prefix(F.col("h"), F.col("depth"))
    return [F.col("depth").cast("int").alias("depth"), prefix.alias("prefix"), F.col("page"), F.concat_ws(":", F.col("depth").cast("int"), prefix, "page").alias("shard_id")]


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col("__k").alias(key), "n_bytes", *_shard())


def _paged(left: DataFrame, limit: int) -> DataFrame:
    """left, checkpointed rows with __part, with depth and page: overflow pages of hashes that exceed the limit.

    limit / size rows of one size fill a page; sizes of a hash follow each other and never share a page. So a row's page is
    arithmetic on its number among the rows of its hash and size: how many are in earlier parts, and its number in its part.
    """
    kinds = left.groupBy("h", "n_bytes").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    kinds = kinds.withColumn("each", each).withColumn("pages", F.ceil(F.col("n") / F.col("each")))
    first = F.coalesce(F.sum("pages").over(Window.partitionBy("h").orderBy(F.desc("n_bytes")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = kinds.select("h", "n_bytes", "each", first.alias("first"))
    parts = left.groupBy("h", "n_bytes", "__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h", "n_bytes").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = checkpoint(parts.select("h", "n_bytes", "__part", before.alias("before")).join(kinds, ["h", "n_bytes"]))
    number = F.row_number().over(Window.partitionBy("h", "n_bytes", "__part").orderBy("__k")) - 1
    met = left.withColumn("i", number).join(parts, ["h", "n_bytes", "__part"])
    page = (F.col("first") + F.floor((F.col("before") + F.col("i")) / F.col("each"))).cast("long")
    return met.select(*left.columns, F.lit(BITS).alias("depth"), page.alias("page"))


def directory(assigned: DataFrame) -> DataFrame:
    """shard_id, depth, prefix, page, rows and bytes of each shard."""
    return assigned.groupBy("shard_id", "depth", "prefix", "page").agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> str:
    """Write docs as Parquet, a folder per shard, each row once into its own; gives the name of the folders' column.

    That is shard_id, or shard_id_1, shard_id_2, ... if docs has such a column, so that no column is lost. The shards are those
    of assign(), within the limit: rows of a hash that needs no pages find theirs by the hash, and only those of hashes that
    do are numbered. Nulls, empty and very long texts are as in assign(); an empty table writes no folder.
    """
    plain, k, t = _plain(docs, key, text)
    done, left = _placed(checkpoint(_rows(plain, k, t)), limit)
    taken = {c.lower() for c in docs.columns}
    name = next(x for x in ("shard_id", *(f"shard_id_{i}" for i in range(1, len(taken) + 2))) if x not in taken)
    by_hash = _union(done).select("h", "depth").distinct().withColumn("page", F.lit(0).cast("long")).select(F.col("h").alias("__h"), _shard()[-1].alias("__shard"))
    boxed = plain.select(F.struct(*plain.columns).alias("__row"), F.col(k).alias("__k"), row_hash(F.col(k)).alias("__hash"), F.octet_length(F.coalesce(F.col(t).cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
    out = boxed.join(by_hash, boxed["__hash"] == by_hash["__h"]).select("__row", "__shard")
    if left is not None:
        over = left.select(F.col("h").alias("__h")).distinct()
        rows = boxed.join(over, boxed["__hash"] == over["__h"], "left_semi").select("__row", "__k", "n_bytes", F.col("__hash").alias("h"), F.spark_partition_id().alias("__part"))
        out = out.unionByName(_paged(checkpoint(rows), limit).select("__row", _shard()[-1].alias("__shard")))
    flat = out.select("__shard", "__row.*").toDF(name, *docs.columns)
    flat.repartition(name).sortWithinPartitions(name).write.mode("overwrite").partitionBy(name).parquet(path)
    return name


#: The directory and assignment as SQL: sizes by prefix at every depth, then the shallowest that fits.
ORACLE_SQL = f"""
with r as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
d as (select unnest(range(0, 41)) as depth),
b as (
  select depth, h >> ({BITS} - depth)::int as prefix, sum(n_bytes) as s, count(*) as n
  from r, d group by all),
a as (
  select r.doc_id, r.n_bytes, min(d.depth)::int as depth, r.h
  from r join d on true join b on b.depth = d.depth and b.prefix = r.h >> ({BITS} - d.depth)::int
  where b.s <= {LIMIT} or b.n = 1
  group by r.doc_id, r.n_bytes, r.h)
select doc_id, n_bytes, depth, h >> ({BITS} - depth)::int as prefix, 0::bigint as page,
       depth || ':' || (h >> ({BITS} - depth)::int) || ':0' as shard_id
from a
"""
