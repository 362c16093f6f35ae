"""Aggregations over catalog, feedback, metrics and strategy relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def category_summary(catalog: DataFrame) -> DataFrame:
    """G1: documents per category, and their type or mixed."""
    named = catalog.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("uncategorized")))
    kinds = named.groupBy("category").agg(F.count("*").alias("n_docs"), F.min("doc_type").alias("lo"), F.max("doc_type").alias("hi"))
    return kinds.select("category", "n_docs", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("mixed").alias("kind"))


def type_counts(catalog: DataFrame) -> DataFrame:
    """G2."""
    return catalog.groupBy("doc_type").agg(F.count("*").alias("n_docs"))


def group_usage(catalog: DataFrame) -> DataFrame:
    """Documents per group; a group named twice in a row counts twice."""
    return catalog.select(F.explode("acl_groups").alias("acl_group")).groupBy("acl_group").agg(F.count("*").alias("n_docs"))


def orphan_groups(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Groups on documents that aren't registered, without ALL."""
    used = catalog.select(F.explode("acl_groups").alias("acl_group")).filter("acl_group != 'ALL'").distinct()
    return used.join(known.select("acl_group"), "acl_group", "left_anti")


def strategy_stats(memory: DataFrame) -> DataFrame:
    """Per pattern the strategies' averages, the best by cited + 0.001 relevant, and its lead over the next."""
    stats = memory.groupBy("pattern", "strategy").agg(
        F.count("*").alias("n"), F.avg("cited").alias("avg_cited"), F.avg("relevant").alias("avg_relevant"), F.avg("seconds").alias("avg_seconds")
    )
    stats = stats.withColumn("composite", F.col("avg_cited") + 0.001 * F.col("avg_relevant"))
    order = Window.partitionBy("pattern").orderBy(F.desc("composite"), "strategy")
    out = stats.withColumn("place", F.row_number().over(order)).withColumn("margin", F.col("composite") - F.coalesce(F.lead("composite").over(order), F.lit(0.0)))
    return out.filter("place = 1").drop("place")


def metrics_dashboard(metrics: DataFrame, last: int = 50) -> DataFrame:
    """Over the last rows: counts, averages of those that the cache didn't answer, cache hits."""
    some = metrics.orderBy(F.desc("created_at"), F.desc("id")).limit(last)
    cold = ~F.col("cache_hit")
    return some.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.round(F.avg(F.when(cold, F.col("seconds"))), 4).alias("avg_seconds"),
        F.round(F.avg(F.when(cold, F.col("n_docs"))), 4).alias("avg_docs"),
    )


def feedback_stats(log: DataFrame) -> DataFrame:
    """G7."""
    return log.agg(
        F.count("*").alias("n"),
        F.count_if("was_cited").alias("n_cited"),
        F.count_if(F.expr("was_relevant and not was_cited")).alias("n_relevant"),
        F.count_if(F.expr("not was_relevant and not was_cited")).alias("n_irrelevant"),
        F.countDistinct("query_hash").alias("n_queries"),
        F.countDistinct("doc_id").alias("n_docs"),
    )


def memory_stats(memory: DataFrame) -> DataFrame:
    """Distinct patterns and the commonest strategy (of equals the first by name)."""
    top = memory.groupBy("strategy").agg(F.count("*").alias("n")).agg(F.min_by("strategy", F.struct((-F.col("n")).alias("n"), F.col("strategy"))).alias("top_strategy"))
    return memory.agg(F.countDistinct("pattern").alias("n_patterns")).crossJoin(top)


def precision(relevant: Column, read: Column) -> Column:
    """Share of the documents read that were relevant; 0 if none was read."""
    return F.coalesce(F.round(F.try_divide(relevant, read), 3), F.lit(0.0))


def dominant(rows: DataFrame, group: Sequence[str], value: str, position: str) -> DataFrame:
    """The commonest value of each group, of equals the one seen first."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias(value))


def merged_lists(parts: DataFrame, group: Sequence[str], lists: Sequence[str], position: str, summary: str = "summary") -> DataFrame:
    """Distinct values of each list in order of first appearance, and the longest summary. A group is a document's parts."""
    ordered = parts.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct(position, *lists))).alias("p"), F.max_by(summary, F.struct(F.length(summary), (-F.col(position)).alias("f"))).alias(summary)
    )
    return ordered.select(*group, *[F.array_distinct(F.flatten(F.filter(F.col(f"p.{c}"), lambda x: x.isNotNull()))).alias(c) for c in lists], summary)


def line_statistics(text: Column) -> Column:
    """Of a recognised page: lines, mean length, short (under 40) and long (55 or more) lines, characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sizes = F.transform(lines, lambda x: F.length(x))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    return F.struct(
        F.size(lines).alias("n"),
        F.coalesce(F.try_divide(total, F.size(lines)), F.lit(0.0)).alias("mean_length"),
        F.size(F.filter(sizes, lambda n: n < 40)).alias("n_short"),
        F.size(F.filter(sizes, lambda n: n >= 55)).alias("n_long"),
        total.alias("n_chars"),
    )


def upper_median(values: Column) -> Column:
    """The middle value, of two the larger."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def evidence_coverage(chunks: DataFrame, expected: Sequence[str], key: str = "id") -> DataFrame:
    """Each expected role and how many chunks support it."""
    roles = chunks.select(F.explode(F.split("evidence_role", ",")).alias("role"), key)
    wanted = chunks.sparkSession.createDataFrame([(r, i) for i, r in enumerate(expected)], "role string, place int")
    return wanted.join(roles, "role", "left").groupBy("role", "place").agg(F.count(key).alias("n_chunks")).select("role", "place", "n_chunks", (F.col("n_chunks") == 0).alias("missing"))
