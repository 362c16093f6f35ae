"""From files to what is indexed: pages, sheets and documents, each kind by its own branch, failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.operators import models, tabular
from docloom.session import checkpoint, ship
from docloom.sources import readers

# Fixed value: characters from which a page counts as digital text, not as a scan.
DIGITAL = 20


def pages(files: DataFrame, read: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """A4, A5: path, page (from 1), text and error of files, by a page reader that the caller gives (for PDF, any library's).

    A file that it can't read gives one row with an error; a file's pages leave one by one.
    """
    ship(files.sparkSession)

    def run(batches):
        names = ["path", "page", "text", "error"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                n = 0
                try:
                    for n, text in enumerate(read(data), 1):
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, n, text, None), kinds, strict=True)], names)
                except Exception as e:  # the reader's own errors
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, n + 1, None, f"{type(e).__name__}: {e}"), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


def flat_pages(page: DataFrame) -> DataFrame:
    """A4: a document's text: its pages that aren't blank, in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return page.filter("trim(coalesce(text, '')) != ''").groupBy("path").agg(F.array_join(ordered, "\n\n").alias("text"))


def triaged(page: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: pages with method (digital or ocr), and documents with theirs: digital, ocr or mixed."""
    digital = F.length(F.trim(F.coalesce("text", F.lit("")))) >= DIGITAL
    one = page.withColumn("method", F.when(digital, "digital").otherwise("ocr"))
    return one, one.groupBy("path").agg(F.when(F.min("method") == F.max("method"), F.min("method")).otherwise("mixed").alias("method"), F.count("*").alias("n_pages"))


def html_grid(tables: DataFrame, html: str = "html") -> DataFrame:
    """Rows of the HTML tables that a recogniser of scans gives (doc_id, sheet, html), normalised as any grid.

    Columns only: rows by their tags, cells by theirs, tags inside cells dropped, the common entities read.
    """
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)

    def cell(c: Column) -> Column:
        bare = F.regexp_replace(c, r"(?s)<[^>]*>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(entity), F.lit(sign))
        return bare

    found = tables.select("doc_id", "sheet", F.posexplode(rows).alias("row_idx", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), cell)
    return tabular.normalise_grid(found.select("doc_id", "sheet", "row_idx", cells.alias("cells")))


def ingested(grid: DataFrame) -> DataFrame:
    """(doc_id, sheet, chunk_index, route, text): every sheet's rows in words, by its own route.

    A clean sheet's rows say their columns, texts as keys and numbers as measures. Of a messy sheet the rows of its longest
    consistent run do, under the run's header. chunk_index goes on through a document's sheets.
    """
    ship(grid.sparkSession)
    sheet = list(tabular.SHEET)
    kinds = checkpoint(tabular.classify(grid).select(*sheet, "route", F.col("header_row").alias("h"), "dtypes"))
    runs = tabular.regions(grid.join(kinds.filter("route = 'messy'"), sheet, "left_semi"))
    spans = kinds.filter("route = 'clean'").select(*sheet, "route", "h", F.lit(1 << 30).alias("e"), "dtypes")
    spans = spans.unionByName(runs.select(*sheet, F.lit("messy").alias("route"), F.col("header_row").alias("h"), F.col("end_row").alias("e"), F.array().cast("array<string>").alias("dtypes")))
    spans = checkpoint(spans)  # a row for each sheet
    head = grid.join(spans, sheet).filter("row_idx = h").select(*sheet, F.col("cells").alias("head"))
    rows = grid.join(spans, sheet).filter("row_idx > h and row_idx < e").join(head, sheet)
    blank = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(not specified)"))
    places = F.sequence(F.lit(0), F.size("head") - 1)
    number = lambda i: F.coalesce(F.get("dtypes", i) == "number", F.lit(False))
    keys = F.transform(F.filter(places, lambda i: ~number(i)), lambda i: F.concat(F.get("head", i), F.lit("="), blank(F.get("cells", i))))
    told = F.transform(F.filter(places, number), lambda i: F.concat(F.get("head", i), F.lit(" is "), blank(F.get("cells", i))))
    said = F.concat_ws("; ", F.nullif(F.array_join(keys, ", "), F.lit("")), F.nullif(F.array_join(told, ", "), F.lit("")))
    counts = rows.groupBy(*sheet).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("sheet").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*sheet).orderBy("row_idx")) - 1  # a sheet's rows are bounded
    return rows.withColumn("place", place).join(before, sheet).select(*sheet, (F.col("before") + F.col("place")).alias("chunk_index"), "route", said.alias("text"))


def needs_text(grid: DataFrame, chunks: DataFrame) -> DataFrame:
    """K4: sheets that must be indexed as plain text: those that gave no row in words."""
    sheet = list(tabular.SHEET)
    return grid.select(*sheet).distinct().join(chunks.select(*sheet).distinct(), sheet, "left_anti")


def prepared(files: DataFrame, read_pages: Callable[[bytes], Iterable[str]] | None = None) -> DataFrame:
    """Path, doc_type, text and warning of files (see readers.read_binary): each kind by its branch, and a file that its
    branch can't read by its bytes as text, with a warning. Refused kinds and images give a warning alone."""
    plain = readers.plain_text(files.filter("kind in ('text', 'transcript')")).select("path", F.lit("text").alias("doc_type"), "text", F.lit(None).cast("string").alias("warning"))
    marked = readers.markdown(files.filter("kind = 'markdown'")).select("path", "doc_type", "text", F.lit(None).cast("string").alias("warning"))
    office = readers.blocks(files)
    broken = office.filter("block_type = 'error'").select("path", "doc_type", F.lit("").alias("text"), F.concat(F.lit("extraction failed: "), "text").alias("warning"))
    whole = readers.rendered(office).select("path", "doc_type", "text", F.lit(None).cast("string").alias("warning"))
    sheets = readers.flat_sheets(readers.sheets(files)).select("path", F.lit("sheet").alias("doc_type"), "text", F.lit(None).cast("string").alias("warning"))
    out = plain.unionByName(marked).unionByName(whole).unionByName(broken).unionByName(sheets)
    if read_pages is not None:
        read = pages(files.filter("kind = 'pdf'"), read_pages)
        failed = read.filter("error is not null").groupBy("path").agg(F.min("error").alias("warning"))
        texts = flat_pages(read)
        out = out.unionByName(texts.join(failed, "path", "full").select("path", F.lit("pdf").alias("doc_type"), F.coalesce("text", F.lit("")).alias("text"), "warning"))
    rest = files.select("path", "kind", "content").join(out.select("path").distinct(), "path", "left_anti")
    text = F.when(readers.is_text(F.col("content")) & ~F.col("kind").isin("refused", "emf"), F.make_valid_utf8(F.col("content").cast("string"))).otherwise("")
    return out.unionByName(rest.select("path", F.col("kind").alias("doc_type"), text.alias("text"), F.concat(F.lit("no reader for "), "kind").alias("warning")))


# What is extracted about a document.
METADATA = "summary string, topics array<string>, organizations array<string>, dates array<string>"


def extracted_metadata(docs: DataFrame, generate: Callable[[str], str], text: str = "text", longest: int = 12_000, schema: str = METADATA) -> DataFrame:
    """Q7: docs and metadata, a struct: what a model says about the first longest characters of each, parsed from its JSON.

    Failed calls and answers without JSON give a struct of nulls, so that no document stops the others.
    """
    ship(docs.sparkSession)
    asked = docs.withColumn("__asked", F.substring(text, 1, longest))
    said = models.mapped(asked, "__asked", generate)
    found = F.when(F.col("status") == "ok", X.parse_model_json(F.col("extract"), schema))
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    return said.withColumn("metadata", F.coalesce(found, none)).drop("__asked", "status", "extract")


def crawl_run(connectors: DataFrame, found: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Connectors with the figures of a crawl that was run again: pages found, those whose content is new, and when.

    found: connector_id, url, content_hash; known: content_hash of what is indexed.
    """
    fresh = found.join(known.select("content_hash").distinct().withColumn("__old", F.lit(True)), "content_hash", "left")
    stats = fresh.groupBy("connector_id").agg(F.countDistinct("url").alias("pages_found"), F.count_distinct(F.when(F.col("__old").isNull(), F.col("content_hash"))).alias("pages_ingested"))
    names = [c for c in connectors.columns if c not in ("pages_found", "pages_ingested", "last_crawl")]
    met = connectors.select(*names).join(stats, "connector_id", "left")
    return met.select(*names, F.coalesce("pages_found", F.lit(0)).alias("pages_found"), F.coalesce("pages_ingested", F.lit(0)).alias("pages_ingested"), F.when(F.col("pages_found").isNotNull(), now).alias("last_crawl"))
