"""Set operations, de-duplication, mutations as copy-on-write, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_union(lists: Sequence[DataFrame], key: str, position: str) -> DataFrame:
    """Keys of several lists, each where it came first: list and place in it."""
    every = None
    for i, one in enumerate(lists):
        part = one.select(key, F.lit(i).alias("list_no"), F.col(position).alias("pos"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min(F.struct("list_no", "pos")).alias("m")).select(key, "m.list_no", "m.pos")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. An aggregate, so that repeated keys fold before they move."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in rest]).select(rows.columns)


def first_by_hash(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """Rows whose content an earlier row has, and that row's key."""
    first = rows.groupBy(digest).agg(F.min(key).alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, digest).filter(F.col(key) != F.col("first_id")).select(key, "first_id")


def unique_by(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose name no other row has."""
    return rows.join(rows.groupBy(name).agg(F.count("*").alias("__n")).filter("__n = 1").select(name), name, "left_semi")


def purge_plan(catalog_ids: DataFrame, chunk_ids: DataFrame, ingestion_active: bool) -> DataFrame:
    """What a purge of chunks without document would do: refused while ingesting or with an empty catalog."""
    gone = chunk_ids.select("doc_id").distinct().join(catalog_ids.select("doc_id"), "doc_id", "left_anti")
    if ingestion_active or catalog_ids.isEmpty():
        return gone.limit(0).agg(F.lit("refused_active" if ingestion_active else "refused_empty_metadata").alias("status"), F.count("*").alias("n_orphans"))
    return gone.agg(F.lit("ok").alias("status"), F.count("*").alias("n_orphans"))


def synchronise_acl(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks with their document's groups, and whether that changes them as sets. Chunks without document stay."""
    new = catalog.select("doc_id", F.col("acl_groups").alias("__new"))
    met = chunks.join(new, "doc_id", "left")
    differs = F.col("__new").isNotNull() & (F.array_sort(F.array_distinct("__new")) != F.array_sort(F.array_distinct("acl_groups")))
    return met.withColumn("changed", differs).withColumn("acl_groups", F.coalesce("__new", "acl_groups")).drop("__new")


def replace_document(target: DataFrame, staged: DataFrame, key: str, value) -> DataFrame:
    """The table with one document's rows replaced by the staged ones."""
    return target.filter(~F.col(key).eqNullSafe(F.lit(value))).unionByName(staged, allowMissingColumns=True)


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows in the place of those with their key."""
    return target.join(rows.select(*key), list(key), "left_anti").select(target.columns).unionByName(rows, allowMissingColumns=True)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Each table without the rows of documents that go."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def append_unique(target: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Rows with names that neither the table nor an earlier row has."""
    fresh = rows.dropDuplicates([name]).join(target.select(name), name, "left_anti").select(rows.columns)
    return target.unionByName(fresh, allowMissingColumns=True)


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, row: str, stretch: Column | None = None) -> DataFrame:
    """Left rows with the latest right row of their key at or before their time, null if there is none.

    Both sides are sorted together once and the last right row is carried on, so a key's pairs are never formed. A key is
    sorted by stretches of time (days, unless given), and the last right row of each is carried on to the later ones: a key
    with very many rows is many tasks.
    """
    stretch = F.date_trunc("day", F.col(time)) if stretch is None else stretch
    l = left.withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(right.schema[row].dataType))
    r = right.withColumn("__side", F.lit(0)).withColumn("__r", F.col(row))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__s", stretch)
    here = Window.partitionBy(*key, "__s").orderBy(time, "__side", row).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.filter("__side = 0").groupBy(*key, "__s").agg(F.max_by("__r", F.struct(time, row)).alias("__last"))
    asked = both.select(*key, "__s").distinct()
    before = Window.partitionBy(*key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(ends, [*key, "__s"], "left").withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    found = both.withColumn("__here", F.last("__r", ignorenulls=True).over(here)).filter("__side = 1").join(carried, [*key, "__s"], "left")
    return found.withColumn(f"right_{row}", F.coalesce("__here", "__carried")).drop("__side", "__r", "__s", "__here", "__carried")


def deltas(rows: DataFrame, group: Sequence[str], time: str, row: str) -> DataFrame:
    """Seconds since the group's step before, null for the first."""
    order = Window.partitionBy(*group).orderBy(time, row)
    now = F.col(time).cast("timestamp")
    ms = F.unix_micros(now) - F.unix_micros(F.lag(now).over(order))
    return rows.withColumn("seconds", F.round(ms / 1e6, 3))
