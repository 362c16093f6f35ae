"""Sheets to relations: grids, headers, dtypes, classification, typed tables, narratives.

A grid is one row per sheet row: doc_id, sheet, row_idx, cells array<string>.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.session import ship

SHEET = ("doc_id", "sheet")
SCAN, LEAST_FILLED, MOST_NUMERIC, LEAST_CELLS, LEAST_ROWS, RECTANGULAR, CONSISTENT = 10, 0.6, 0.3, 2, 3, 0.8, 0.8


#: Numbers of rows of a sheet that one step of regions() walks.
BLOCK = 1 << 13


def kinds(cells: Column) -> Column:
    return F.transform(cells, X.cell_kind)


def count_of(values: Column, value: str) -> Column:
    return F.size(F.filter(values, lambda k: k == value))


def normalise_grid(grid: DataFrame) -> DataFrame:
    """Blank for null, cells trimmed, rows padded to the widest; empty rows and columns go."""
    clean = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    rows = grid.withColumn("cells", clean).filter(F.exists("cells", lambda c: c != ""))
    long = rows.select(*SHEET, F.posexplode("cells").alias("at", "c")).filter("c != ''")
    used = long.groupBy(*SHEET).agg(F.sort_array(F.collect_set("at")).alias("used"))  # a sheet's columns
    return rows.join(used, list(SHEET)).withColumn("cells", F.transform("used", lambda k: F.coalesce(F.get(F.col("cells"), k), F.lit("")))).drop("used")


def stitch(grids: DataFrame) -> DataFrame:
    """Consecutive grids with one header become one (island), the repeated headers dropped.

    grids: doc_id, sheet, grid_no, row_idx, cells.
    """
    heads = grids.filter("row_idx = 0").select("doc_id", "grid_no", F.col("cells").alias("head"))
    order = Window.partitionBy("doc_id").orderBy("grid_no")
    marked = heads.withColumn("new", (~F.coalesce(F.lag("head").over(order) == F.col("head"), F.lit(False))).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grids.join(marked.select("doc_id", "grid_no", "island", "new"), ["doc_id", "grid_no"]).filter("row_idx > 0 or new = 1").drop("new")


def header_rows(grid: DataFrame) -> DataFrame:
    """H9: per sheet the index of the first row that looks like a header, -1 if none, and the number of rows."""
    k = kinds(F.col("cells"))
    filled = F.size(k) - count_of(k, "empty")
    last = grid.groupBy(*SHEET).agg(F.max("row_idx").alias("last_row"))
    looks = (filled >= LEAST_CELLS) & (filled / F.size(k) >= LEAST_FILLED) & (count_of(k, "number") / filled <= MOST_NUMERIC)
    early = grid.filter(F.col("row_idx") < SCAN).withColumn("looks", F.coalesce(looks, F.lit(False)))
    found = early.join(last, list(SHEET)).filter("looks and row_idx < last_row").groupBy(*SHEET).agg(F.min("row_idx").alias("header_row"))
    return last.join(found, list(SHEET), "left").select(*SHEET, F.coalesce("header_row", F.lit(-1)).alias("header_row"), (F.col("last_row") + 1).alias("n_rows"))


def column_stats(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Per column of each sheet with a header: numbers, texts, dtype, and the share of the commoner kind."""
    h = headers.filter("header_row >= 0")
    head = grid.join(h, list(SHEET)).filter("row_idx = header_row").select(*SHEET, F.size("cells").alias("width"), F.col("cells").alias("head"))
    data = grid.join(h.select(*SHEET, "header_row"), list(SHEET)).filter("row_idx > header_row").join(head, list(SHEET))
    cells = data.select(*SHEET, "width", "head", F.posexplode(F.slice("cells", F.lit(1), F.col("width"))).alias("col", "cell")).withColumn("kind", X.cell_kind(F.col("cell")))
    seen = cells.groupBy(*SHEET, "col").agg(F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if(F.col("kind") == "text").alias("texts"))
    every = head.select(*SHEET, F.posexplode("head").alias("col", "header"))
    out = every.join(seen, [*SHEET, "col"], "left").fillna(0, ["numbers", "texts"])
    dtype = F.when(F.col("numbers") + F.col("texts") == 0, "empty").when(F.col("numbers") > F.col("texts"), "number").otherwise("text")
    return out.withColumn("dtype", dtype).withColumn("share", F.try_divide(F.greatest("numbers", "texts"), F.col("numbers") + F.col("texts")))


def classify(grid: DataFrame) -> DataFrame:
    """K1: per sheet the route (clean or messy), header row, column dtypes and reason."""
    headers = header_rows(grid)
    head = grid.join(headers, list(SHEET)).filter("row_idx = header_row").select(*SHEET, F.size("cells").alias("width"))
    shape = grid.join(headers, list(SHEET)).filter("row_idx > header_row").join(head, list(SHEET)).groupBy(*SHEET).agg(F.count("*").alias("n_data"), F.count_if(F.size("cells") == F.col("width")).alias("n_fit"))
    cols = column_stats(grid, headers).groupBy(*SHEET).agg(
        F.sort_array(F.collect_list(F.struct("col", "dtype"))).alias("d"), F.min(F.when(F.col("share") < CONSISTENT, F.col("col"))).alias("odd")
    )
    met = headers.join(shape, list(SHEET), "left").join(cols, list(SHEET), "left")
    n = F.coalesce("n_data", F.lit(0))
    reason = (
        F.when(F.col("header_row") < 0, "no header detected")
        .when(n < LEAST_ROWS, "too few data rows")
        .when(F.col("n_fit") / n < RECTANGULAR, "not rectangular")
        .when(F.col("odd").isNotNull(), F.concat(F.lit("column "), F.col("odd"), F.lit(" not type-consistent")))
        .otherwise("clean table")
    )
    known = reason.isin("clean table") | reason.startswith("column")
    return met.withColumn("reason", reason).select(
        *SHEET,
        F.when(F.col("reason") == "clean table", "clean").otherwise("messy").alias("route"),
        "header_row",
        F.when(known, F.col("d.dtype")).otherwise(F.array().cast("array<string>")).alias("dtypes"),
        "reason",
    )


def typed_table(grid: DataFrame, header_row: int, headers: Sequence[str | None], dtypes: Sequence[str]) -> DataFrame:
    """A clean sheet as a relation: double or string columns under safe names; missing cells are null."""
    names = X.column_names(list(headers))
    cols = []
    for i, (name, dtype) in enumerate(zip(names, dtypes, strict=True)):
        cell = F.get("cells", F.lit(i))
        value = X.to_number(cell) if dtype == "number" else F.nullif(cell, F.lit(""))
        cols.append(value.alias(name, metadata={"header": headers[i] or ""}))
    return grid.filter(F.col("row_idx") > header_row).select("row_idx", *cols).orderBy("row_idx").drop("row_idx")


def profile(dtypes: Sequence[str]) -> list[str]:
    """K2: numbers are measures, all else keys."""
    return ["measure" if d == "number" else "key" for d in dtypes]


def narrative(table: DataFrame, keys: Sequence[str], measures: Sequence[str], labels: dict[str, str] | None = None, context: str = "") -> Column:
    """A row in words: keys as label=value, measures as label is value, blanks as (not specified)."""
    label = labels or {}
    said = [F.concat(F.lit(f"{label.get(c, c)}="), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(not specified)"))) for c in keys]
    told = [F.concat(F.lit(f"{label.get(c, c)} is "), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("(not specified)"))) for c in measures]
    return F.concat(F.lit(f"{context}: " if context else ""), F.concat_ws(", ", *said), F.lit("; " if said and told else ""), F.concat_ws(", ", *told))


def looks_like_header(row: Sequence[str | None]) -> bool:
    k = [_kind(c) for c in row]
    filled = [x for x in k if x != "empty"]
    return len(filled) >= LEAST_CELLS and len(filled) / len(k) >= LEAST_FILLED and filled.count("number") / len(filled) <= MOST_NUMERIC


def _kind(cell: str | None) -> str:
    """cell_kind in Python, for sheets that are walked row by row."""
    bare = re.sub(r"[$,%]", "", (cell or "").strip()).strip()
    if not (cell or "").strip():
        return "empty"
    try:
        float(bare)
    except ValueError:
        return "text"
    return "number"


def consistent_run(kinds: Sequence[Sequence[str]], start: int, numbers: list[int], texts: list[int]) -> int | None:
    """Place of the row, from start on, that ends a run of data rows; None if none does. Rows join while they have two filled
    cells, aren't wider than the header, and leave every column of one kind to four fifths.

    kinds: of the rows' cells; numbers, texts: of each column of the header in the run so far, counted on here.
    """
    for at in range(start, len(kinds)):
        k = kinds[at]
        if len(k) > len(numbers) or len(k) - k.count("empty") <= 1:
            return at
        for i, x in enumerate(k):
            numbers[i] += x == "number"
            texts[i] += x == "text"
            if max(numbers[i], texts[i]) < CONSISTENT * (numbers[i] + texts[i]):
                return at
    return None


def _kinds(frame: pd.DataFrame) -> list[list[str]]:
    return [[_kind(c) for c in row] for row in frame["cells"]]


def _tally(kinds: Sequence[Sequence[str]], value: str) -> list[int]:
    """How many cells of each column are of a kind."""
    out = [0] * max(map(len, kinds), default=0)
    for row in kinds:
        for i, x in enumerate(row):
            out[i] += x == value
    return out


def regions(grid: DataFrame, block: int = BLOCK) -> DataFrame:
    """H8, K5: header_row and end (exclusive) of each sheet's longest consistent run of at least three rows, the first of equals.

    A row joins by what all rows before it add up to. So blocks of row numbers are counted, a sheet's counts added up to what
    stands before each block, and blocks walked on from there, each by itself: a sheet may have any number of rows, and one
    group holds a block of it, or a row of counts for each block.
    """
    place = F.coalesce(F.floor(F.col("row_idx") / block), F.lit((1 << 63) - 1))
    rows = grid.select(*[F.col(c).cast("string").alias(c) for c in SHEET], place.alias("block"), "row_idx", "cells")
    sheet = "doc_id string, sheet string"

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        """Of a block: its number of rows, its columns' numbers and texts, and its first rows."""
        frame = frame.sort_values("row_idx")
        k = _kinds(frame)
        return frame.iloc[:1][[*SHEET, "block"]].assign(n=len(k), numbers=[_tally(k, "number")], texts=[_tally(k, "text")], first=[[list(c) for c in frame["cells"].iloc[:SCAN]]])

    def begun(frame: pd.DataFrame) -> pd.DataFrame:
        """Of a sheet's blocks, for each header among its first rows: what its run has counted before the block."""
        frame = frame.sort_values("block")
        first = [list(row) for some in frame["first"].iloc[:SCAN] for row in some][:SCAN]
        n_rows = int(frame["n"].sum())
        out = []
        for h in range(min(n_rows - 1, len(first))):
            if not looks_like_header(first[h]):
                continue
            above = [[_kind(c) for c in row] for row in first[: h + 1]]
            held = {x: [-c for c in (_tally(above, v) + [0] * len(first[h]))[: len(first[h])]] for x, v in (("numbers", "number"), ("texts", "text"))}
            before = 0
            for b in frame.itertuples(index=False):
                if before + b.n > h + 1:
                    inside = before <= h
                    out.append((b.doc_id, b.sheet, b.block, n_rows, h, before, *[[0] * len(x) if inside else list(x) for x in held.values()]))
                for x, more in (("numbers", b.numbers), ("texts", b.texts)):
                    held[x] = [c + d for c, d in zip(held[x], [*map(int, more), *[0] * len(held[x])])]  # columns behind the header's end a run
                before += b.n
        return pd.DataFrame(out, columns=[*SHEET, "block", "n_rows", "header_row", "before", "numbers", "texts"])

    def walked(frame: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        """Of a block, for each header: where its run ends, if it does so there."""
        k = _kinds(frame.sort_values("row_idx")) if len(heads) else []
        out = []
        for x in heads.itertuples(index=False):
            end = consistent_run(k, max(0, x.header_row + 1 - x.before), list(map(int, x.numbers)), list(map(int, x.texts)))
            out.append((x.doc_id, x.sheet, x.header_row, x.n_rows if end is None else x.before + end))
        return pd.DataFrame(out, columns=[*SHEET, "header_row", "end_row"])

    ship(grid.sparkSession)
    by = [*SHEET, "block"]
    counts = rows.groupBy(*by).applyInPandas(counted, f"{sheet}, block long, n long, numbers array<long>, texts array<long>, first array<array<string>>")
    heads = counts.groupBy(*SHEET).applyInPandas(begun, f"{sheet}, block long, n_rows long, header_row int, before long, numbers array<long>, texts array<long>")
    ends = rows.groupBy(*by).cogroup(heads.groupBy(*by)).applyInPandas(walked, f"{sheet}, header_row int, end_row int")
    runs = ends.groupBy(*SHEET, "header_row").agg(F.min("end_row").alias("end_row"))
    size = F.col("end_row") - F.col("header_row") - 1
    best = runs.filter(size >= LEAST_ROWS).groupBy(*SHEET).agg(F.max(F.struct(size.alias("n"), (-F.col("header_row")).alias("h"), "end_row")).alias("b"))
    return best.select(*SHEET, (-F.col("b.h")).alias("header_row"), "b.end_row")


def resolve_hints(hints: DataFrame) -> DataFrame:
    """The best hint of each table, column and kind: by provenance, then confidence, then age."""
    rank = F.when(F.col("provenance") == "human", 3).when(F.col("provenance") == "document", 2).otherwise(1)
    best = F.max_by(F.struct("payload", "provenance", "confidence"), F.struct(rank.alias("r"), F.col("confidence"), F.col("created_at")))
    return hints.groupBy("scope_value", "hint_type", "target_column").agg(best.alias("b")).select("scope_value", "hint_type", "target_column", "b.*")


def glossary(values: DataFrame, entries: DataFrame, value: str = "value") -> DataFrame:
    """The meaning of each value: the entry of that name, else the first entry ending in * that it begins with."""
    exact = values.join(entries.filter("key not like '%*'").select(F.col("key").alias(value), F.col("meaning").alias("exact")), value, "left")
    stems = entries.filter("key like '%*'").select(F.expr("substring(key, 1, length(key) - 1)").alias("stem"), F.col("meaning").alias("loose"), "place")
    sizes = [r["n"] for r in stems.select(F.length("stem").alias("n")).distinct().collect()]  # lengths of glossary keys
    asked = exact.withColumn("stem", F.explode_outer(F.array(*[F.substring(F.col(value), 1, n) for n in sizes] or [F.lit(None).cast("string")])))
    met = asked.join(stems, "stem", "left")
    return met.groupBy(value, "exact").agg(F.min_by("loose", "place").alias("loose")).select(value, F.coalesce("exact", "loose").alias("meaning"))
