"""What prompts and answers show: tables, schemas, clarifications, streamed lines, figures in their place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Characters of a table's note, and what is asked where an edition can't be told.
NOTE = 200
CLARIFY = {
    "platform": "Which SD-WAN platform or product does this apply to?",
    "software_version": "Which software or firmware version are you using?",
    "environment": "Which environment does this apply to, such as lab or production?",
    "site": "Which site or deployment does this apply to?",
}


def _lines(line: Column, *order: str) -> Column:
    """A group's lines in order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")


def available_tables(tables: DataFrame, notes: DataFrame) -> DataFrame:
    """(table_name, line) as a classifier sees tables: name, description and what is noted about it, each note once, in
    order, NOTE characters in all. tables: table_name, description; notes: table_name, place, note."""
    once = notes.filter("coalesce(note, '') != ''").groupBy("table_name", "note").agg(F.min("place").alias("place"))
    said = once.groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "note"))), lambda x: x["note"]), "; ").alias("notes"))
    line = F.concat(F.lit("- "), "table_name", F.lit(": "), "description", F.coalesce(F.concat(F.lit(" — "), F.substring("notes", 1, NOTE)), F.lit("")))
    return tables.join(said, "table_name", "left").select("table_name", line.alias("line")).orderBy("table_name")


def schema_context(columns: DataFrame, glossary: DataFrame) -> DataFrame:
    """(table_name, context): a table's columns with their meaning, and the meanings of coded values.

    columns: table_name, description, position, column, dtype, meaning; glossary: table_name, column, code, meaning.
    """
    one = F.concat(F.lit("  - "), "column", F.lit(" ("), "dtype", F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.nullif(F.col("meaning"), F.lit(""))), F.lit("")))
    heads = columns.groupBy("table_name").agg(F.concat(F.lit("Table "), F.col("table_name"), F.lit(" — "), F.min("description"), F.lit("\nColumns:\n"), _lines(one, "position")).alias("head"))
    codes = glossary.groupBy("table_name", "column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code", "meaning"))), lambda x: F.concat(x["code"], F.lit(" = "), x["meaning"])), ", ").alias("codes"))
    meanings = codes.groupBy("table_name").agg(_lines(F.concat(F.lit("  - "), "column", F.lit(": "), "codes"), "column").alias("values"))
    text = F.concat("head", F.coalesce(F.concat(F.lit("\nValue meanings:\n"), "values"), F.lit("")))
    return heads.join(meanings, "table_name", "left").select("table_name", text.alias("context"))


def clarification(missing: Column, asked: Sequence[str] = tuple(CLARIFY)) -> Column:
    """The questions that would tell which edition applies, null if none of the missing details is to be asked for."""
    table = F.create_map(*[x for k in asked if k in CLARIFY for x in (F.lit(k), F.lit(f"- {CLARIFY[k]}"))])
    lines = F.array_compact(F.transform(missing, lambda m: F.try_element_at(table, m)))
    return F.when(F.size(lines) > 0, F.concat(F.lit("To choose the applicable documentation:\n\n"), F.array_join(lines, "\n")))


# What Markdown takes literally inside a line (code, images and links, links by reference), and evidence markers.
LITERAL = r"`+[^`]*`+|!?\[[^\]\n]*\]\([^\n]*?\)|\[[^\]\n]*\]\[[^\]\n]*\]"
MARKER = r"(?<!\\)\[(?:E[A-Za-z0-9_-]+|\d+)\]"
FENCE = r"^\s*(`{3,}|~{3,})"


def _fences(lines: Column) -> Column:
    """Of each line whether it's literal code: inside fences, or a fence. A fence is closed by the same sign, at least as often."""
    none = F.lit("")

    def step(state: Column, line: Column) -> Column:
        sign, inside = F.regexp_extract(line, FENCE, 1), state["open"] != ""
        closes = inside & (F.substring(sign, 1, 1) == F.substring(state["open"], 1, 1)) & (F.length(sign) >= F.length(state["open"]))
        return F.struct(F.when(closes, none).when(inside, state["open"]).otherwise(sign).alias("open"), F.concat(state["code"], F.array(inside | (sign != ""))).alias("code"))

    start = F.struct(none.alias("open"), F.array().cast("array<boolean>").alias("code"))
    return F.aggregate(lines, start, step, lambda state: state["code"])


def streamed_lines(pieces: DataFrame) -> DataFrame:
    """(answer_id, line_no, line, code) of answers that come in pieces (answer_id, n, text): whole lines, each marked if it
    is literal code, so that citations inside code stay as they are. An answer's pieces are bounded. For a stream of pieces see
    docloom.streaming.citations."""
    whole = pieces.groupBy("answer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
    lines = whole.select("answer_id", F.split("text", "\n", -1).alias("lines"))
    both = lines.select("answer_id", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), _fences(F.col("lines")).alias("code"))).alias("line_no", "x"))
    return both.select("answer_id", "line_no", "x.line", "x.code")


def marked_parts(line: Column) -> Column:
    """A line in parts: literal stretches, evidence markers, and what is between them, in order."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?:{LITERAL}|{MARKER}|[^`!\[\\]+|.)"), 0)


def rendered_citations(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """streamed_lines with evidence markers of ids (answer_id, evidence_id, number) written as numbers. Inline code, links
    and code stay as they are, and so do markers that the answer's evidence lacks, and those behind a backslash."""
    per = ids.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", F.col("number").cast("string")))).alias("__n"))
    number = lambda p: F.try_element_at(F.col("__n"), F.substring(p, F.lit(2), F.length(p) - 2))
    parts = marked_parts(F.col("line"))
    one = lambda p: F.when(p.rlike(rf"^{MARKER}$"), F.coalesce(F.concat(F.lit("["), number(p), F.lit("]")), p)).otherwise(p)
    met = lines.join(per, "answer_id", "left")
    return met.withColumn("line", F.when(F.col("code"), F.col("line")).otherwise(F.array_join(F.transform(parts, one), ""))).drop("__n")


def placed_images(lines: DataFrame, images: DataFrame) -> DataFrame:
    """X11: (answer_id, line_no, images) where an answer's figures are shown: each once, at the end of the paragraph that cites
    it first, by a marker outside code and links. images: answer_id, evidence_id, doc_id, figure_id; lines: see streamed_lines."""
    marks = F.transform(F.filter(marked_parts(F.col("line")), lambda p: p.rlike(rf"^{MARKER}$")), lambda p: F.substring(p, F.lit(2), F.length(p) - 2))
    cites = lines.filter("not code").select("answer_id", "line_no", F.explode(marks).alias("evidence_id"))
    first = cites.join(images, ["answer_id", "evidence_id"]).groupBy("answer_id", "doc_id", "figure_id").agg(F.min("line_no").alias("line_no"))
    after = Window.partitionBy("answer_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("end", F.min(F.when(F.trim("line") == "", F.col("line_no"))).over(after))
    last = lines.groupBy("answer_id").agg((F.max("line_no") + 1).alias("last"))
    met = first.join(ends.select("answer_id", "line_no", "end"), ["answer_id", "line_no"]).join(last, "answer_id")
    placed = met.groupBy("answer_id", (F.coalesce("end", "last") - 1).alias("line_no"))
    return placed.agg(F.array_sort(F.collect_set(F.concat_ws("/", "doc_id", "figure_id"))).alias("images"))
