"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a query pattern leaves out, and organisations it masks, in this order.
PATTERN_STOP = (
    "what which who how when where the a an is are was were did does do by for with from about all any been being had has have "
    "its that this those can could would should will may might must shall tell me list show find give get"
).split()
ORGANISATIONS = ("army", "navy", "air force", "marine corps", "dha", "dla", "defense health agency", "defense logistics agency", "u.s. army corps of engineers")
# How dates, amounts and long numbers are spelled in a query pattern.
DATE = (
    r"(?i)(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    r"[\w.]*\s+\d{1,2}(?:st|nd|rd|th)?(?:\s*,?\s*\d{4})?"
)
AMOUNT, NUMBER = r"(?i)\$[\d,.]+\s*(?:million|billion|[kmb])?", r"\b\d{4,}\b"
# Words that never discriminate documents.
TERM_STOP = "what which when where who whom whose did does the and for all any list show give find about contract contracts award awarded awards".split()
# Evidence roles and the expressions that tell them.
ROLES = {
    "prerequisites": r"prerequisites?|before you (?:begin|start)|requirements?",
    "steps": r"procedure|configuration steps|configure|deployment steps|installation|^\s*\d+[.)]\s",
    "warnings": r"warning|caution|important|disrupt|outage|service impact",
    "verification": r"verif(?:y|ication)|validation|confirm|expected (?:output|result)",
    "rollback": r"rollback|roll back|revert|restore previous",
    "symptoms": r"symptoms?|observed|error|failure|packet loss|timeout",
    "causes": r"possible causes?|potential causes?|cause of|due to",
    "diagnostics": r"diagnostic|check|test|inspect|show\s",
    "interpretation": r"if .* (?:then|indicates|means)|indicates|expected|otherwise",
    "correction": r"remediat|corrective|resolution|workaround|repair",
}
# Fixed value: a version.
VERSION = r"\d+(?:\.\d+){0,3}(?:[a-z])?"
# What marks a line of a web page as furniture.
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "youtube.com", "twitter.com", "/#facebook", "/#x)", "/#email")
PHRASES = (
    "skip to main content", "official websites use .gov", "secure .gov websites", "how you know", "share sensitive information",
    "official government organization", "safely connected", "addtoany", "thanks for sharing", "previous next slideshow",
)
WIDGETS = ("×", "Share", "**Copy Link**", "---", "Search", "Search Search")


def any_of(text: Column, parts: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def words(text: Column) -> Column:
    """Words between white space, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def query_hash(query: Column) -> Column:
    """SHA-256 of the query in lower case with single spaces."""
    return F.sha2(F.array_join(words(F.lower(query)), " ").cast("binary"), 256)


def query_pattern(query: Column) -> Column:
    """The query with dates, amounts, long numbers and organisations masked and common words left out."""
    t = F.regexp_replace(F.trim(F.lower(query)), r"[?!.]+$", "")
    for expression, mask in ((DATE, "[DATE]"), (AMOUNT, "[AMOUNT]"), (NUMBER, "[ID]")):
        t = F.regexp_replace(t, expression, re.escape(mask).replace("\\[", "[").replace("\\]", "]"))
    masks = F.array(F.lit("[DATE]"), F.lit("[AMOUNT]"), F.lit("[ID]"))
    stop = F.array(*[F.lit(w) for w in PATTERN_STOP])
    kept = F.filter(words(t), lambda w: ~F.array_contains(stop, w))
    fold = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda out, w: F.when(F.array_contains(masks, w) & F.coalesce(F.try_element_at(out, F.lit(-1)) == w, F.lit(False)), out).otherwise(F.concat(out, F.array(w))),
    )
    t = F.array_join(fold, " ")
    for name in ORGANISATIONS:
        t = F.replace(t, F.lit(name), F.lit("[ORG]"))
    return F.array_join(words(t), " ")


def query_terms(question: Column) -> Column:
    """Distinct lower-case words of more than three characters that aren't common, without punctuation around them."""
    stop = F.array(*[F.lit(w) for w in TERM_STOP])
    bare = F.transform(words(question), lambda w: F.lower(F.regexp_replace(w, r"^[.,?!:;\"'()]+|[.,?!:;\"'()]+$", "")))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)))


def cell_kind(cell: Column) -> Column:
    """Empty, number or text. Signs of money, thousands and per cent are taken off; nan and inf count as numbers here."""
    bare = F.trim(F.regexp_replace(F.trim(cell), r"[$,%]", ""))
    named = F.lower(bare).rlike(r"^[+-]?(nan|inf|infinity)$")
    number = named | bare.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$")
    return F.when(cell.isNull() | (F.trim(cell) == ""), "empty").when(number, "number").otherwise("text")


def to_number(cell: Column) -> Column:
    """The number of a cell, null if it has none or an infinite or undefined one."""
    bare = F.replace(F.trim(F.regexp_replace(F.trim(cell), r"[$,%]", "")), F.lit("_"), F.lit(""))
    value = F.when(cell_kind(cell) == "number", bare.try_cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def column_names(headers: list[str | None]) -> list[str]:
    """Safe, distinct column names of a header row."""
    out: list[str] = []
    for i, header in enumerate(headers):
        name = re.sub(r"[^0-9a-z]+", "_", (header or "").lower()).strip("_") or f"col_{i}"
        name = f"c_{name}" if name[0].isdigit() else name
        base, n = name, 0
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def safe_names(headers: pd.Series) -> pd.Series:
    """J5 over header rows, arrays; null stays null."""
    return headers.map(lambda h: None if h is None else column_names([None if x is None else str(x) for x in h]))


def table_name(doc: Column, sheet: Column) -> Column:
    """Name of the table of a document's sheet."""

    def safe(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^0-9a-z]+", "_"), r"^_+|_+$", "")

    return F.concat(F.lit("doc_"), safe(doc), F.lit("_"), safe(sheet))


def metadata_blob(fields: list[Column]) -> Column:
    """All values of list fields as one lower-case text."""
    return F.lower(F.array_join(F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in fields])), " "))


def url_decode(name: Column) -> Column:
    """Percent-decoding that leaves + alone, and the text itself if it can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def strip_furniture(text: Column) -> Column:
    """A web page's text without lines of links, sharing widgets and stock phrases.

    If over nine tenths of a text of over 500 characters would go, the text stays.
    """

    def kept(line: Column) -> Column:
        s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        plain = F.trim(F.regexp_replace(F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_\[\]()#|>!]", ""))
        links = F.size(F.split(s, r"\]\(")) - 1
        low = F.lower(s)
        furniture = (
            ((links >= 1) & (F.length(plain) < 30) & s.startswith("*"))
            | ((links >= 2) & (F.length(plain) < 20))
            | (s.rlike(r"^\[?\[?\]?\(") & (F.length(plain) < 5))
            | any_of(low, SOCIAL)
            | any_of(low, PHRASES)
            | s.isin(*WIDGETS)
            | s.rlike(r"^!\[.*\]\(.*\)$")
            | s.rlike(r"^\[!\[.*\]\(.*\)\]\(.*\)$")
        )
        return (s == "") | ~furniture

    out = F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), kept), "\n"), r"\n{4,}", "\n\n\n")
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return F.when((F.length(out) < F.length(text) * 0.1) & (F.length(text) > 500), text).otherwise(out)


def normalise_title(value: Column) -> Column:
    """Words of a title without its revision."""
    bare = F.regexp_replace(value, r"(?i)\b(?:rev(?:ision)?|edition|version)\s*[:#-]?\s*" + VERSION, "")
    return F.array_join(F.regexp_extract_all(F.lower(bare), F.lit(r"([a-z0-9]+)"), 1), " ")


def version_key(value: Column) -> Column:
    """Comparable struct of up to four numbers and a letter, null if the text is no version."""
    low = F.lower(value)
    parts = F.split(F.regexp_extract(low, r"^(\d+(?:\.\d+)*)", 1), r"\.")

    def n(i: int) -> Column:
        return F.coalesce(F.get(parts, i).try_cast("long"), F.lit(0).cast("long"))

    key = F.struct(n(0).alias("n1"), n(1).alias("n2"), n(2).alias("n3"), n(3).alias("n4"), F.regexp_extract(low, r"([a-z]?)$", 1).alias("suffix"))
    return F.when(low.rlike("^" + VERSION + "$"), key)


def source_date(value: Column) -> Column:
    """ISO date of one of five spellings; slashes are ambiguous and give null."""
    t = F.trim(value)
    iso = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
    spelled = [
        F.when(t.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.coalesce(F.try_to_date(F.initcap(t), "MMMM d, yyyy"), F.try_to_date(F.initcap(t), "MMM d, yyyy"))),
        F.when(t.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.coalesce(F.try_to_date(F.initcap(t), "d MMMM yyyy"), F.try_to_date(F.initcap(t), "d MMM yyyy"))),
    ]
    return F.date_format(F.coalesce(iso, *spelled), "yyyy-MM-dd")


def evidence_roles(text: Column) -> Column:
    """Roles that a passage plays, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?im)" + p), F.lit(n)) for n, p in ROLES.items()]))


def cap(text: Column, budget: int) -> Column:
    """Text of at most budget characters, with a mark if it was cut."""
    return F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget), F.lit("\n... [truncated]"))).otherwise(text)


def index_text(context: Column, section_path: Column, text: Column) -> Column:
    """What is embedded: the section, or else the document's context, before the text."""
    section = F.when(F.coalesce(section_path, F.lit("")) != "", F.concat(F.lit("Section: "), section_path, F.lit("\n\n"), text)).otherwise(text)
    return F.when(section_path.isNull(), F.concat(context, F.lit("\n\n"), text)).otherwise(section)


def embed_text(text: Column, prefix: str = "", limit: int = 8000) -> Column:
    """A text with the model's prefix, cut to the model's length."""
    return F.substring(F.concat(F.lit(prefix), text), 1, limit)


def key_digest(key: Column) -> Column:
    """Digest and visible prefix of an API key."""
    return F.struct(F.sha2(key.cast("binary"), 256).alias("key_hash"), F.substring(key, 1, 8).alias("key_prefix"))


def failure_kind(error: Column) -> Column:
    """Whether a failed call is worth another try."""
    return F.when(error == "connection", "transient").otherwise("permanent")


def graph_timeout(chars: Column, chunk_chars: int = 4800, seconds: int = 22, concurrency: int = 4, least: int = 900, most: int = 3600) -> Column:
    """Seconds granted to build a document's graph, from its length."""
    chunks = F.greatest(F.lit(1), F.ceil(chars / chunk_chars))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(chunks * seconds / concurrency))).cast("long")


def repair_record(line: Column, delimiter: str = "<|#|>") -> Column:
    """An extraction record with a default for the field it lacks: an entity's type, a relation's keywords."""
    parts = F.split(F.trim(line), r"<\|#\|>")
    kind = F.lower(F.trim(F.get(parts, 0)))
    entity = F.array_join(F.array_insert(parts, 3, F.lit("category")), delimiter)
    relation = F.array_join(F.array_insert(parts, 4, F.lit("related")), delimiter)
    return F.when((kind == "entity") & (F.size(parts) == 3), entity).when(kind.isin("relation", "relationship") & (F.size(parts) == 4), relation).otherwise(line)


def repair_extraction(text: Column) -> Column:
    """Every short record of an extraction repaired, all other lines as they are."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: repair_record(line)), "\n")


def parse_model_json(text: Column, schema: str) -> Column:
    """The object in a model's answer: thoughts and fences are taken off; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)
