"""Retrieval strategies as compositions, and the engine's facade."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import access, aggregates, graph, retrieval as R, routing
from docloom.plans import sqlguard

LOOKUP, SWEEP = 30, 500


def lookup(chunks: DataFrame, groups: Sequence[str], question: str, vector: Sequence[float], k: int = LOOKUP, doc_ids=None, boosts: DataFrame | None = None, window: int = 1) -> DataFrame:
    """Hybrid search on the medium tier, re-ranked, boosted, cut at 0.3 of the best, widened to neighbours."""
    rows = access.scope_filter(chunks, groups, "medium", doc_ids)
    found = R.hybrid(rows, vector, question, k)
    seeds = rows.join(F.broadcast(found), "id")  # k rows
    seeds = R.rerank(seeds, R.lexical_score(question, F.col("text")), k)
    seeds = R.relative_cut(seeds if boosts is None else R.apply_boosts(seeds, boosts))
    return R.neighbours(seeds, rows.withColumn("score", F.lit(0.0)), window)


def sweep(chunks: DataFrame, groups: Sequence[str], question: str, vector: Sequence[float], k: int = SWEEP, boosts: DataFrame | None = None, extra: DataFrame | None = None, per_doc: int = 200) -> DataFrame:
    """Documents by their summaries (by large chunks where there are none), boosted, cut, joined by extra ones, then
    their large chunks, some per document, in order."""
    tiers = access.acl_filter(chunks, groups)
    summaries = tiers.filter("chunk_size_tier = 'summary'")
    top = R.vector_topk(summaries if not summaries.isEmpty() else tiers.filter("chunk_size_tier = 'xlarge'"), vector, k)
    best = top.groupBy("doc_id").agg(F.max("score").alias("score"))
    if boosts is not None:
        best = R.apply_boosts(R.drop_negative(best, boosts), boosts)
    docs = R.relative_cut(best).select("doc_id")
    docs = docs if extra is None else docs.unionByName(extra.select("doc_id")).distinct()
    body = tiers.filter("chunk_size_tier not in ('summary', 'table_row')").join(docs, "doc_id", "left_semi")
    return R.per_document(R.tier_fallback(body, ["large"]), per_doc, order=["chunk_index", "id"]).orderBy("doc_id", "chunk_index")


def map_reduce_candidates(vector_hits: DataFrame, metadata_hits: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """Documents of two ranked lists (doc_id, score), fused, boosted, without those feedback speaks against, cut."""
    a = R.ranked(vector_hits, [F.desc("score"), F.col("doc_id")])
    b = R.ranked(metadata_hits, [F.desc("score"), F.col("doc_id")])
    fused = R.rrf([a, b], "doc_id")
    if boosts is not None:
        fused = R.apply_boosts(R.drop_negative(fused, boosts), boosts)
    return R.relative_cut(fused)


def cross_reference(chunks: DataFrame, groups: Sequence[str], tasks: Sequence[tuple[str, Sequence[float]]], k: int = 10) -> DataFrame:
    """Each sub-task's own search, the chunks of all, each where it was found first."""
    rows = access.scope_filter(chunks, groups, "small")
    found = [rows.join(F.broadcast(R.hybrid(rows, v, q, k)), "id").withColumn("synthetic", F.lit(False)) for q, v in tasks]
    return routing.merged_branches(found, ["doc_id", "chunk_size_tier", "chunk_index"])


@dataclass
class Engine:
    """Q9, Q10: the tools over one set of relations, each scoped to the caller's groups. Models are given as functions."""

    spark: SparkSession
    catalog: DataFrame
    chunks: DataFrame
    embed: Callable[[str], Sequence[float]]
    edges: DataFrame | None = None
    tables: dict[str, DataFrame] | None = None
    generate: Callable[[str], str] | None = None

    def search_documents(self, question: str, groups: Sequence[str], doc_type: str | None = None, k: int = 10) -> DataFrame:
        rows = access.scope_filter(self.chunks, groups, "medium")
        found = rows.join(F.broadcast(R.hybrid(rows, self.embed(question), question, k)), "id")
        named = found.join(self.catalog.select("doc_id", "doc_type", "filename"), "doc_id")
        return routing.type_filter(named, doc_type).orderBy(F.desc("score"), "id")

    def lookup_document(self, name: str, groups: Sequence[str], offset: int = 0, limit: int = 50) -> DataFrame:
        """C14: chunks of a document by id, else by a file name that is unique."""
        seen = access.acl_filter(self.catalog, groups)
        ids = [r[0] for r in seen.filter(F.col("doc_id").cast("string") == name).select("doc_id").limit(2).collect()]
        ids = ids or [r[0] for r in seen.filter(F.col("filename") == name).select("doc_id").limit(2).collect()]
        if len(ids) != 1:
            raise LookupError("no such document" if not ids else "several documents have this name")
        rows = self.chunks.filter((F.col("doc_id") == ids[0]) & F.col("chunk_size_tier").isin("medium", "table_row"))
        return R.page_of(rows, ["chunk_index", "start_char", "id"], offset, limit)

    def list_documents(self, category: str | None, groups: Sequence[str]) -> DataFrame:
        """Documents of a category; all visible ones if it has none."""
        seen = access.acl_filter(self.catalog, groups).withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("uncategorized")))
        mine = seen if category is None else seen.filter(F.col("category") == category)
        return seen if category is not None and mine.isEmpty() else mine

    def list_sources(self, groups: Sequence[str]) -> DataFrame:
        return aggregates.category_summary(access.acl_filter(self.catalog, groups))

    def query_database(self, question: str, groups: Sequence[str]) -> sqlguard.Trace:
        """Generated SQL over the tables given, repaired if need be."""
        tables = self.tables or {}
        prompt = f"{question}\n{sqlguard.schema_prompt(list(tables.items()))}"
        run = lambda sql: [r.asDict() for r in sqlguard.run(self.spark, sql, tables).limit(1000).collect()]  # noqa: E731  an answer's rows
        return sqlguard.repaired(self.generate or (lambda p: ""), run, prompt)

    def search_graph(self, names: Sequence[str], depth: int = 1, most: int = 100) -> DataFrame:
        """Nodes within depth (3 at most) of the named ones, most of them."""
        seeds = self.spark.createDataFrame([(n,) for n in names], "node string")
        return graph.k_hop(self.edges, seeds, min(depth, 3)).orderBy("hop", "node").limit(most)

    def ask(self, question: str, groups: Sequence[str]) -> DataFrame:
        """The evidence for a question by the strategy its words call for."""
        from docloom.operators.models import QUERY_TYPES
        import re

        kind = next((n for n, p in QUERY_TYPES if re.search(p, question.lower())), "lookup")
        plan = sweep if kind == "sweep" else lookup
        return plan(self.chunks, groups, question, self.embed(question))
