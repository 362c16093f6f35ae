"""Files to relations (A1-A3, A11-A18, A23-A27, A32-A35). Bytes come through Spark's readers, so any store works."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X
from docloom.session import ship

BLOCKS = "doc_type string, body_index int, block_type string, text string, page int, section_path string"
KINDS = {
    "pdf": ("pdf",), "docx": ("docx",), "pptx": ("pptx",), "workbook": ("xlsx", "xlsm", "xls"), "delimited": ("csv", "tsv"), "markdown": ("md", "markdown"),
    "transcript": ("txt",), "visio": ("vsdx",), "emf": ("emf",), "refused": ("vsd", "vdx", "vsdm"),
}


def document_kind(path: Column) -> Column:
    """A1: what reads a file, by its suffix; plain text for all it doesn't know."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for kind, names in KINDS.items():
        out = F.when(suffix.isin(*names), kind).otherwise(out)
    return out


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, kind, format and content of files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), document_kind(F.col("path")).alias("kind"), workbook_format(F.col("content")).alias("format"), "content")


def workbook_format(content: Column) -> Column:
    """What a workbook is by its first bytes, whatever its name."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "ooxml").when(head == "D0CF11E0A1B11AE1", "ole").otherwise("delimited")


def is_text(content: Column) -> Column:
    """A2: no NUL among the first 8192 bytes."""
    return ~F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))


def plain_text(files: DataFrame) -> DataFrame:
    """A2: text of files that aren't binary; bytes that aren't UTF-8 become U+FFFD."""
    suffix = F.nullif(F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    return files.filter(is_text(F.col("content"))).select("path", "filename", F.coalesce(suffix, F.lit("text")).alias("doc_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def markdown(files: DataFrame) -> DataFrame:
    """A3."""
    return plain_text(files).withColumn("doc_type", F.lit("markdown")).withColumn("text", X.strip_furniture(F.col("text")))


# Keys of a transcript's header.
HEADERS = ("Meeting", "Date", "Location", "Attendees")


def transcript(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Key, position, kind (header, question, statement or text), speaker and text of a transcript's lines."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")).alias("position", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lines = lines.filter("line != '' and line != '---'")
    colon = F.instr("line", ":") > 0
    name = F.trim(F.split_part("line", F.lit(":"), F.lit(1)))
    said = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    kind = F.when(colon & name.isin(*HEADERS), "header").when(colon & said.endswith("?"), "question").when(colon, "statement").otherwise("text")
    return lines.select(key, "position", kind.alias("kind"), F.when(colon, name).alias("speaker"), F.when(colon, said).otherwise(F.col("line")).alias("text"))


GRID = T.StructType([T.StructField("path", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet name, row and cells of an OOXML workbook, values as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = links[sheet.get(REL)].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            at = -1
            for row in ET.fromstring(z.read(target)).iter(f"{MAIN}row"):
                index = int(row.get("r", at + 2)) - 1
                for blank in range(at + 1, index):
                    yield sheet.get("name"), blank, []
                at = index
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    col = len(cells)
                    if letters:
                        col = 0
                        for x in letters[0]:
                            col = col * 26 + ord(x) - 64
                        col -= 1
                    cells += [None] * (col - len(cells))
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                    elif v is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}.get(v.text) if kind == "b" else v.text)
                yield sheet.get("name"), at, cells


def delimited_rows(data: bytes, filename: str) -> Iterator[tuple[str, int, list[str]]]:
    if b"\0" in data[:8192]:
        raise ValueError(f"{filename}: binary, not delimited text")
    stem = filename.rsplit(".", 1)[0]
    for i, row in enumerate(csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), delimiter="\t" if filename.lower().endswith(".tsv") else ",")):
        yield stem, i, row


def sheets(files: DataFrame) -> DataFrame:
    """Every sheet of workbooks and delimited files as untyped rows. A file that can't be read gives none."""

    def run(batches):
        for b in batches:
            for path, name, form, data in zip(*(b.column(c).to_pylist() for c in ("path", "filename", "format", "content")), strict=True):
                try:
                    rows = list(workbook_rows(data) if form == "ooxml" else delimited_rows(data, name))
                except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError):
                    continue
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.list_(pa.string()))], GRID.names
                    )

    ship(files.sparkSession)
    return files.filter("kind in ('workbook', 'delimited') and format != 'ole'").select("path", "filename", "format", "content").mapInArrow(run, GRID)


def flat_sheets(grid: DataFrame) -> DataFrame:
    """A workbook as text: a line for each sheet's name and each row. A workbook's rows are one document's text."""
    lines = grid.select("path", "sheet", "row_idx", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " | ").alias("line"))
    per = lines.groupBy("path", "sheet").agg(F.concat(F.lit("Sheet: "), F.col("sheet"), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "line"))), lambda r: r["line"]), "\n")).alias("text"))
    return per.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet", "text"))), lambda r: r["text"]), "\n\n").alias("text"))


WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_blocks(data: bytes) -> Iterator[tuple[str, str, int | None, str]]:
    """Block type, text, page and heading path of paragraphs and tables, in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{WORD_NS}body")
    path: list[str] = []
    for node in body:
        if node.tag == f"{WORD_NS}p":
            said = "".join(t.text or "" for t in node.iter(f"{WORD_NS}t")).strip()
            if not said:
                continue
            style = node.find(f"{WORD_NS}pPr/{WORD_NS}pStyle")
            level = re.match(r"Heading\s*(\d)", style.get(f"{WORD_NS}val", "")) if style is not None else None
            if level:
                path = path[: int(level[1]) - 1] + [said]
            yield "heading" if level else "paragraph", said, None, " > ".join(path)
        elif node.tag == f"{WORD_NS}tbl":
            rows = [" | ".join("".join(t.text or "" for t in c.iter(f"{WORD_NS}t")).strip() for c in r.iter(f"{WORD_NS}tc")) for r in node.iter(f"{WORD_NS}tr")]
            yield "table", "\n".join(rows), None, " > ".join(path)


def pptx_blocks(data: bytes) -> Iterator[tuple[str, str, int | None, str]]:
    """Texts of slides, shapes by place (top, left), then notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for n in numbers:
            shapes = []
            root = ET.fromstring(z.read(f"ppt/slides/slide{n}.xml"))
            for k, shape in enumerate(x for x in root.iter() if x.tag.endswith(("}sp", "}graphicFrame"))):
                off = next(shape.iter(f"{DRAW}off"), None)
                where = (int(off.get("y")), int(off.get("x"))) if off is not None else (1 << 60, 0)
                said = "\n".join(p for p in ("".join(t.text or "" for t in para.iter(f"{DRAW}t")) for para in shape.iter(f"{DRAW}p")) if p.strip())
                if said:
                    shapes.append((*where, k, said))
            for *_, said in sorted(shapes):
                yield "paragraph", said, n, ""
            if f"ppt/notesSlides/notesSlide{n}.xml" in z.namelist():
                said = "\n".join(t.text for t in ET.fromstring(z.read(f"ppt/notesSlides/notesSlide{n}.xml")).iter(f"{DRAW}t") if t.text)
                if said:
                    yield "notes", said, n, ""


def visio_blocks(data: bytes) -> Iterator[tuple[str, str, int | None, str]]:
    """shapes' texts of each page, and connectors as begin -> end."""
    ns = "{http://schemas.microsoft.com/office/visio/2012/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"visio/pages/page\d+\.xml", n)):
            root, page = ET.fromstring(z.read(name)), int(re.search(r"(\d+)\.xml", name)[1])
            texts = {s.get("ID"): "".join(t.itertext()).strip() for s in root.iter(f"{ns}Shape") if (t := s.find(f"{ns}Text")) is not None}
            for said in texts.values():
                if said:
                    yield "shape", said, page, ""
            ends: dict[str, dict[str, str]] = {}
            for c in root.iter(f"{ns}Connect"):
                ends.setdefault(c.get("FromSheet"), {})["begin" if c.get("FromCell", "").startswith("Begin") else "end"] = c.get("ToSheet")
            for e in ends.values():
                yield "connector", f"{texts.get(e.get('begin')) or 'unknown'} -> {texts.get(e.get('end')) or 'unknown'}", page, ""


READERS = {"docx": docx_blocks, "pptx": pptx_blocks, "visio": visio_blocks}


def blocks(files: DataFrame) -> DataFrame:
    """Ordered blocks of Office documents: path, and BLOCKS. A file that can't be read gives one block of type error."""

    def run(batches):
        for b in batches:
            for path, kind, data in zip(*(b.column(c).to_pylist() for c in ("path", "kind", "content")), strict=True):
                try:
                    rows = [(path, kind, i, *x) for i, x in enumerate(READERS[kind](data))]
                except (KeyError, ValueError, AttributeError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows = [(path, kind, 0, "error", str(e), None, "")]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "doc_type", "body_index", "block_type", "text", "page", "section_path"])

    ship(files.sparkSession)
    return files.filter(F.col("kind").isin(*READERS)).select("path", "kind", "content").mapInArrow(run, f"path string, {BLOCKS}")


def rendered(parts: DataFrame) -> DataFrame:
    """A document's blocks as its text, in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("body_index", "text"))), lambda x: x["text"])
    return parts.filter("block_type != 'error'").groupBy("path", "doc_type").agg(F.array_join(ordered, "\n\n").alias("text"))


# Elements of a page that aren't its content.
SKIPPED = ("script", "style", "nav", "footer", "header", "aside", "iframe", "noscript")


class _Markdown(HTMLParser):
    def __init__(self, root: str | None):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.inside, self.root, self.href, self.at = 0, root is None, root, None, 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.root and (tag == self.root or self.root == "role" and a.get("role") == "main"):
            self.inside, self.tag = True, tag
            self.at += 1
        if tag in SKIPPED:
            self.skip += 1
        if self.skip or not self.inside:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "table", "ul", "ol", "blockquote"):
            self.out.append("\n\n")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag == "a" and a.get("href"):
            self.href = a["href"]
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and self.inside:
            if tag in ("strong", "b"):
                self.out.append("**")
            elif tag == "a" and self.href:
                self.out.append(f"]({self.href})")
                self.href = None
            elif re.fullmatch(r"h[1-6]|p", tag):
                self.out.append("\n\n")
        if self.root and self.at and tag == getattr(self, "tag", None):
            self.at -= 1
            self.inside = self.at > 0

    def handle_data(self, data):
        if not self.skip and self.inside:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    """The page's main part (main, article, role=main, body) without scripts and navigation."""
    low = html.lower()
    root = "main" if "<main" in low else "article" if "<article" in low else "role" if re.search(r"role=[\"']?main", low) else "body" if "<body" in low else None
    p = _Markdown(root)
    p.feed(html)
    p.close()
    out = "\n".join(line.strip() for line in "".join(p.out).split("\n"))
    return re.sub(r"\n{4,}", "\n\n\n", out).strip()


def pages_to_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """A24 over pages: their other columns, and markdown."""
    keep = [c for c in pages.columns if c != html]

    def run(batches):
        for b in batches:
            made = [html_to_markdown(h or "") for h in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], [*keep, "markdown"])

    ship(pages.sparkSession)
    return pages.select(*keep, html).mapInArrow(run, T.StructType([*(pages.schema[c] for c in keep), T.StructField("markdown", T.StringType())]))


def clean_url(url: Column) -> Column:
    """Without fragment and trailing slashes; the query stays."""
    bare = F.regexp_replace(url, r"#.*$", "")
    path, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)$", 1)
    return F.concat(F.regexp_replace(path, r"/+$", ""), query)


def is_file_url(url: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a URL names a document to download."""
    suffixes = ("pdf", "docx", "doc", "pptx", "xlsx", "xls", "csv", *extra)
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(" + "|".join(suffixes) + ")$")


def links(pages: DataFrame, pattern: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): distinct links of each page to its own host, absolute and clean."""
    found = pages.select(url, F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'>]+)["']"""), 1)).alias("href"))
    host = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", "")
    href = F.trim("href")
    whole = F.when(href.rlike(r"^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, r"^(https?:)", 1), href)).when(href.startswith("/"), F.concat(host, href)).when(href.rlike(r"^(#|[a-z]+:)"), None).otherwise(F.concat(base, href))
    out = found.select(url, host.alias("host"), clean_url(whole).alias("target")).filter(F.regexp_extract("target", r"^(https?://[^/?#]+)", 1) == F.col("host"))
    out = out if pattern is None else out.filter(F.col("target").rlike(pattern))
    return out.select(url, "target").distinct()


def crawl(pages: DataFrame, start: str, depth: int, most: int, pattern: str | None = None) -> DataFrame:
    """(url, hop) of pages reached from a start by links, breadth first, depth links deep, the first most pages.

    Offline over a table of fetched pages. Pages of one depth are taken in order of URL.
    """
    known = pages.select(clean_url(F.col("url")).alias("url"), "html")
    edge = links(known, pattern)
    frontier = known.filter(F.col("url") == start).select("url").withColumn("hop", F.lit(0))
    seen = frontier
    for hop in range(1, depth + 1):
        fresh = edge.join(frontier.select("url"), "url").select(F.col("target").alias("url")).distinct().join(known.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti").withColumn("hop", F.lit(hop))
        seen, frontier = seen.unionByName(fresh), fresh
    return seen.orderBy("hop", "url").limit(most)


# How nodes, links, their ends and their first text are written in GraphML, and what parts a merged text.
NODE, LINK, DATA, PARTS = r'<node id="([^"]+)"', r"(?s)(<edge .*?</edge>|<edge [^>]*/>)", r"(?s)<data[^>]*>(.*?)</data>", "&lt;SEP&gt;"


def graphml(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (source, target, label up to 120 characters of the first part) of GraphML texts."""
    nodes = docs.select(F.explode(F.regexp_extract_all(text, F.lit(NODE), 1)).alias("id")).distinct()
    raw = docs.select(F.explode(F.regexp_extract_all(text, F.lit(LINK), 1)).alias("e"))
    label = F.substring(F.split_part(F.regexp_extract("e", DATA, 1), F.lit(PARTS), F.lit(1)), 1, 120)
    edges = raw.select(F.regexp_extract("e", r'source="([^"]+)"', 1).alias("source"), F.regexp_extract("e", r'target="([^"]+)"', 1).alias("target"), label.alias("label"))
    return nodes, edges


def audit_log(lines: DataFrame, schema: str, last: int = 100) -> DataFrame:
    """The last entries of a JSON-lines log (position, value), newest first, without malformed ones."""
    parsed = lines.select("position", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).filter("r is not null and r._bad is null")
    return parsed.orderBy(F.desc("position")).limit(last).select("position", "r.*").drop("_bad")


def indexed_text(chunks: DataFrame) -> DataFrame:
    """A document's text from its chunks: in order, without added headers and repeated chunks."""
    body = F.regexp_replace("text", r"^(?:Section|Document): [^\n]*\n\n", "")
    first = chunks.select("doc_id", body.alias("t"), F.struct("chunk_index", "start_char").alias("o")).groupBy("doc_id", "t").agg(F.min("o").alias("o"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def matched_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose bytes a catalogued document has: path and the least such doc_id."""
    have = catalog.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return files.select("path", F.sha2("content", 256).alias("content_hash")).join(have, "content_hash")
