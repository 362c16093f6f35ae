"""Access scope: which rows a caller may see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "ALL"


def acl_condition(groups: Sequence[str], acl: str = "acl_groups", literal_all: bool = False, strict: bool = False) -> Column:
    """Whether a row's groups meet the caller's. No groups see nothing; ALL sees everything, unless it is taken literally
    (literal_all) or taken away from the caller (strict). Null elements never grant access."""
    own = [g for g in groups if not (strict and g == ALL)]
    if not own:
        return F.lit(False)
    if ALL in own and not literal_all:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.col(acl), F.array(*[F.lit(g) for g in own])), F.lit(False))


def acl_filter(df: DataFrame, groups: Sequence[str], acl: str = "acl_groups", literal_all: bool = False, strict: bool = False) -> DataFrame:
    return df.filter(acl_condition(groups, acl, literal_all, strict))


def scope_filter(
    df: DataFrame, groups: Sequence[str], tier: str | None = None, doc_ids: Sequence | DataFrame | None = None, acl: str = "acl_groups"
) -> DataFrame:
    """Access, tier and documents. doc_ids: None is no restriction, an empty list is nothing; a DataFrame of doc_id is semi-joined."""
    out = acl_filter(df, groups, acl)
    if tier is not None:
        out = out.filter(F.col("chunk_size_tier") == tier)
    if doc_ids is None:
        return out
    if isinstance(doc_ids, DataFrame):
        return out.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return out.filter(F.col("doc_id").isin(*doc_ids)) if len(doc_ids) else out.filter(F.lit(False))


def may_use(groups: Sequence[str], allowed: Column) -> Column:
    """Permission of an agent: the list of allowed names holds ALL or one of the caller's."""
    return F.coalesce(F.array_contains(allowed, ALL) | F.arrays_overlap(allowed, F.array(*[F.lit(g) for g in groups] or [F.lit(None).cast("string")])), F.lit(False))


def parse_groups(text: Column) -> Column:
    """Comma-separated groups, trimmed; none or ALL among them gives [ALL]."""
    names = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.size(names) == 0) | F.array_contains(names, ALL), F.array(F.lit(ALL))).otherwise(names)


def ingest_groups(explicit: Column, dataset_default: Column, caller: Column) -> Column:
    """Groups of a new document: those given, else the dataset's, else the caller's; empty lists count as not given."""

    def given(x: Column) -> Column:
        return F.when(F.size(x) > 0, x)

    return F.coalesce(given(explicit), given(dataset_default), given(caller))


def graph_paths_allowed(paths: Column, allowed: Sequence[str], separator: str = "<SEP>") -> Column:
    """An item of several source files is visible only if every one of them is."""
    own = F.array(*[F.lit(a) for a in allowed] or [F.lit(None).cast("string")])
    return F.coalesce(F.forall(F.split(paths, separator), lambda p: F.array_contains(own, p)), F.lit(False))


def allowed_filenames(catalog: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Filenames all of whose documents the caller may see: one shared with a hidden document stays hidden."""
    seen = acl_condition(groups)
    return catalog.groupBy("filename").agg(F.bool_and(seen).alias("ok")).filter("ok").select("filename")
