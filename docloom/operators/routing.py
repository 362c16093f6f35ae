"""What a request may see and where it goes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import vectors as V
from docloom.operators.access import acl_filter

# How many candidates each depth of an answer asks for.
DEPTHS = {
    "focused": {"lookup": 15, "discovery": 50, "subtask": 5, "window": 1},
    "balanced": {"lookup": 30, "discovery": 250, "subtask": 10, "window": 2},
    "thorough": {"lookup": 60, "discovery": 500, "subtask": 20, "window": 3},
}
DOC_TYPES = ("pdf", "docx", "pptx", "xlsx", "markdown", "transcript", "csv", "web")
# Suffixes of files without entities, and words that ask for pictures or for technical help.
TABULAR = ("xls", "xlsx", "xlsm", "xlsb", "csv", "tsv")
VISUAL = r"\b(diagrams?|topolog(?:y|ies)|venn|flowcharts?|illustrations?|figures?|schematics?|images?|pictures?)\b"
# Technical intents and the expressions that tell them, first match first; a command asked for in steps is a procedure.
INTENTS = (
    ("version_comparison", r"\b(?:compare|difference|changed between)\b.*\b(?:versions?|revisions?|editions?|releases?)\b"),
    ("troubleshooting", r"\b(?:troubleshoot|diagnos\w*|not working|failing|fails|timeout|packet loss|tunnel(?: is)? down|cannot connect)\b"),
    ("command_reference", r"\b(?:command|syntax|cli reference)\b"),
    ("procedure", r"\b(?:how (?:do|can|should|to)|steps (?:to|for)|configuration steps|list[^\n]*steps|procedure|configure|deploy|install|roll back)\b"),
    ("architecture", r"\b(?:architecture|topology|how .+ works?|explain .+ network)\b"),
)
NOT_COMMAND = r"\b(?:steps|how to|how do|procedure)\b"


def query_scope(catalog: DataFrame, groups: Sequence[str], dataset: int | None = None, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C4: documents in scope (access, dataset, the caller's own list), and their revision: one digest of ids and contents.

    The revision is a sum of row digests beside the count: no document's state has to meet the others' in one place.
    """
    scope = acl_filter(catalog, groups)
    scope = scope if dataset is None else scope.filter(F.col("dataset_id") == dataset)
    scope = scope if allowed is None else scope.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    row = F.xxhash64("doc_id", "content_hash").cast("decimal(38,0)")
    revision = scope.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("string")).cast("binary"), 256).alias("revision"))
    return scope, revision


def scoped_schemas(registry: DataFrame, groups: Sequence[str], documents: DataFrame, dataset_given: bool) -> DataFrame:
    """Tables the caller may read: of documents in scope, and external ones unless a dataset is asked for.

    registry has the owner's doc_id, null for external tables; a name's prefix can belong to two documents, so it decides nothing.
    """
    seen = acl_filter(registry, groups, literal_all=True)
    own = seen.filter("doc_id is not null").join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select(registry.columns)
    return own if dataset_given else own.unionByName(seen.filter("doc_id is null"))


def type_filter(top: DataFrame, doc_type: str | None) -> DataFrame:
    """C11: rows of a top-k of one of the known types; an unknown type filters nothing. Never moved before the top-k."""
    return top.filter(F.col("doc_type") == doc_type) if doc_type in DOC_TYPES else top


def speaker_filter(top: DataFrame, speaker: str | None = None, kind: str | None = None) -> DataFrame:
    """Utterances of a top-k by a speaker (any case, part of the name) and of a kind."""
    out = top if not speaker else top.filter(F.contains(F.lower("speaker"), F.lit(speaker.lower())))
    return out if not kind else out.filter(F.col("utterance_type") == kind)


def suggested_categories(categories: DataFrame, question: str) -> DataFrame:
    """C17: categories one of whose keywords the question has, and the first such keyword."""
    hit = F.filter("routing_keywords", lambda k: F.contains(F.lit(question.lower()), F.lower(k)) & (k != ""))
    return categories.withColumn("keyword", F.get(hit, 0)).filter("keyword is not null")


def all_sources(categories: DataFrame, schemas: DataFrame) -> DataFrame:
    """C18."""
    return categories.select(F.lit("category").alias("kind"), "name", "description").unionByName(schemas.select(F.lit("schema").alias("kind"), F.col("table_name").alias("name"), "description"))


def listed(rows: DataFrame, order: Sequence[str], **equal) -> DataFrame:
    """Rows with given values (None: any), in order."""
    for name, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows.orderBy(*order)


def skips_graph(filename: Column) -> Column:
    """C27."""
    return F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1)).isin(*TABULAR)


def intent(question: Column) -> Column:
    """The technical intent that a question's words tell, empty if none."""
    out = F.lit("")
    for name, pattern in reversed(INTENTS):
        hit = question.rlike("(?i)" + pattern)
        out = F.when(hit & ~question.rlike("(?i)" + NOT_COMMAND) if name == "command_reference" else hit, name).otherwise(out)
    return out


def visual(question: Column) -> Column:
    """Whether a question is about pictures."""
    return question.rlike("(?i)" + VISUAL)


def image_limit(question: Column, mode: str, most: int) -> Column:
    """Images that an answer may show: most if that is automatic or they are asked for, else none."""
    return F.when(F.lit(mode == "auto") | (F.lit(mode == "requested") & visual(question)), F.lit(most)).otherwise(F.lit(0))


def depth_limit(depth: str, kind: str) -> int:
    """D29."""
    return DEPTHS.get(depth, DEPTHS["balanced"])[kind]


def route_tables(tables: DataFrame, question: Sequence[float], threshold: float = 0.3, most: int = 8, choose: Callable[[list[str]], list[str] | None] | None = None) -> DataFrame:
    """Tables whose vector is near the question's, nearest first, most at most; a chooser may pick among them.

    The chooser's answer is met with the list (unknown names go, its order counts); [] declines, None leaves the list.
    """
    near = tables.withColumn("sim", V.cosine(F.col("vector"), V.literal(question))).filter(F.col("sim") >= threshold).orderBy(F.desc("sim"), "table_name").limit(most)
    if choose is None:
        return near
    picked = choose([r["table_name"] for r in near.select("table_name").collect()])  # most names
    if picked is None:
        return near
    if not picked:
        return near.limit(0)
    place = F.array_position(F.array(*[F.lit(p) for p in picked]), F.col("table_name"))
    return near.filter(place > 0).orderBy(place)


def graph_sources(hints: DataFrame, question: str, catalog: DataFrame, most: int = 3) -> DataFrame:
    """Documents behind graph hints that share most words with the question, where the file name is unique."""
    words = sorted({w for w in question.lower().split() if len(w) > 3})
    shared = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    best = hints.withColumn("shared", shared).filter("shared > 0").orderBy(F.desc("shared"), "hint_id").limit(most)
    files = catalog.groupBy("filename").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n = 1").select("filename", "doc_id")
    return best.join(files, "filename").select("hint_id", "doc_id", "shared")


def merged_branches(branches: Sequence[DataFrame], key: Sequence[str], synthetic: str = "synthetic") -> DataFrame:
    """Chunks of several branches, each where it came first, with relevance by the best score of real ones."""
    every = None
    for i, b in enumerate(branches):
        part = b.withColumn("branch", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("branch", F.desc("score")))
    kept = every.withColumn("__p", place).filter("__p = 1").drop("__p")
    top = kept.filter(~F.col(synthetic)).agg(F.max("score").alias("__top"))
    return kept.crossJoin(F.broadcast(top)).withColumn("relevance", F.when(~F.col(synthetic) & (F.col("__top") > 0), F.col("score") / F.col("__top"))).drop("__top")


def activity_strategy(status: Column, cached: Column, strategy: Column) -> Column:
    """What an activity row says was done."""
    return F.when(status == "error", "error").when(cached, "cache").otherwise(F.coalesce(strategy, F.lit("unknown")))
