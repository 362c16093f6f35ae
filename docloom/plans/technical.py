"""Compositions for technical and tabular questions: re-ranked search, figures, coverage with one follow-up, SQL beside rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import access, aggregates, retrieval as R, routing
from docloom.plans import sqlguard, strategies
from docloom.session import checkpoint

# What an answer to a technical question should be made of.
TROUBLESHOOTING = ("symptoms", "causes", "diagnostics", "interpretation", "correction")
PROCEDURE = ("prerequisites", "steps", "warnings", "verification", "rollback")


def hybrid_reranked(rows: DataFrame, vector: Sequence[float], question: str, k: int = 10, score: Callable[[str, Column], Column] | None = R.lexical_score, top_n: int | None = None) -> DataFrame:
    """D3: hybrid search, its first top_n ordered anew by a model's score of question and text; without a scorer as D2 ranks
    them. Both work on the k rows found."""
    found = rows.join(F.broadcast(R.hybrid(rows, vector, question, k)), "id")  # k rows
    return found.orderBy(F.desc("score"), "id") if score is None else R.rerank(found, score(question, F.col("text")), top_n or k)


def search_figures(chunks: DataFrame, groups: Sequence[str], vector: Sequence[float], question: str, k: int = 10, kind: str | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Figures by vector and words. documents, the ones that the caller may see by the catalog, decide instead of the
    figures' own groups, which may be out of date. Words that no figure has leave the vector's order."""
    rows = chunks if documents is not None else access.acl_filter(chunks, groups)
    rows = rows.filter("chunk_size_tier = 'medium' and content_type = 'figure'")
    rows = rows if kind is None else rows.filter(F.col("figure_kind") == kind)
    rows = rows if documents is None else rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.join(F.broadcast(R.hybrid(rows, vector, question, k)), "id").orderBy(F.desc("score"), "id")  # k rows


def coverage(chunks: DataFrame, intent: str) -> DataFrame:
    """Of the roles that an intent's answer has, which the found passages play. Figures and made-up passages prove none."""
    own = chunks.filter("coalesce(content_type, '') != 'figure' and not coalesce(synthetic, false)") if "synthetic" in chunks.columns else chunks.filter("coalesce(content_type, '') != 'figure'")
    roles = own.withColumn("evidence_role", F.array_join(X.evidence_roles(F.col("text")), ","))
    return aggregates.evidence_coverage(roles, TROUBLESHOOTING if intent == "troubleshooting" else PROCEDURE)


def technical(chunks: DataFrame, groups: Sequence[str], question: str, vector: Sequence[float], intent: str, embed: Callable[[str], Sequence[float]], k: int = strategies.LOOKUP, follow_up: int = 12) -> tuple[DataFrame, DataFrame]:
    """(chunks, coverage): what a lookup finds, with the pages around figures, and, if roles are missing, what one more
    search for them finds. The lists are top-ks."""
    rows = access.scope_filter(chunks, groups, "medium")
    found = checkpoint(strategies.lookup(chunks, groups, question, vector, k).withColumn("origin", F.lit("lookup")))  # a top-k, read four times
    figures = found.filter("content_type = 'figure'").select("doc_id", "page").distinct()
    near = R.figure_pages(figures, rows.filter("content_type != 'figure'")).select(*rows.columns).withColumn("score", F.lit(0.4)).withColumn("origin", F.lit("figure page"))
    every = checkpoint(R.keyed_union(found, near.select(*found.columns), ["id"], ["id"]))
    report = coverage(every, intent)
    missing = [r["role"] for r in report.filter("missing").orderBy("place").collect()]  # five roles
    if not missing:
        return every, report
    more = f"{question}\nDocumentation for: {', '.join(missing)}"
    extra = hybrid_reranked(rows, embed(more), more, follow_up).withColumn("origin", F.lit("follow-up"))
    every = checkpoint(R.keyed_union(every, extra.select(*found.columns), ["id"], ["id"]))
    return every, coverage(every, intent)


def structured(tables: DataFrame, relations: dict[str, DataFrame], chunks: DataFrame, groups: Sequence[str], question: str, vector: Sequence[float], look_up: Callable[[list[str]], sqlguard.Trace], boosts: DataFrame | None = None, threshold: float = 0.3, k: int = 20) -> tuple[sqlguard.Trace, DataFrame]:
    """the SQL trace over the tables that a question is near to, and the k nearest row narratives, boosted. Without such a
    table the trace is skipped; whatever fails in SQL leaves the rows."""
    near = [r["table_name"] for r in routing.route_tables(tables, vector, threshold).select("table_name").collect() if r["table_name"] in relations]  # most names
    trace = sqlguard.Trace()
    if near:
        try:
            trace = look_up(near)
        except Exception as e:  # an answer without SQL is better than none
            trace.verdict, trace.error = "error", str(e)
    rows = R.vector_topk(access.scope_filter(chunks, groups, "table_row"), vector, k)
    return trace, rows if boosts is None else R.apply_boosts(rows, boosts)
