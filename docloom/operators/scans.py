"""Recognised pages and figures: what a region of text boxes is, which words are worth keeping, gaps between words."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.operators.aggregates import line_statistics
from docloom.operators.graph import connected

# Words that hint at a drawing, at a process, at a network, and at a process where hardly anything was read.
DRAWING = ("portal", "overlay", "architecture", "lifecycle", "topology", "workflow", "pipeline", "controller", "deploy", "accelerator", "regulation", "visibility", "operation", "services", "network", "router", "cloud")
PROCESS = ("workflow", "pipeline", "lifecycle", "process", "portal", "phase", "jenkins", "bamboo", "prepare", "incident", "decision", "step")
NETWORK = ("router", "overlay", "tloc", "ipsec", "dtls", "vlan", "vrf", "topology", "firewall", "controller", "validator", "vmanage", "vbond")
SPARSE = ("start", "end", "decision", "workflow", "approve")
# Addresses, hosts and links in recognised text, and what is a candidate for keeping.
ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HOST = r"(?i)\b[a-zA-Z0-9][\w.-]*\.(?:local|corp|com|net|io|internal)\b"
LINK = r"(?i)https?://[^\s]+"
CIDR = r"\d+\.\d+\.\d+\.\d+/\d+"
ADDRESSES = r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b"
NAMES = (
    r"https?://[^\s]+",
    ADDRESSES,
    r"\b[A-Z][A-Za-z0-9]+(?:[ -][A-Z][A-Za-z0-9]+){1,5}\b",
    r"\b[A-Z]{2,}[A-Z0-9]*\b",
    r"\b(?:vManage|vBond|vSmart|vMonitor|vOrchestrator|vdaemon|SD-WAN|IPsec|DTLS|SAML|Okta|Jenkins|Bamboo)\b",
)
# Acronyms and names that are worth keeping, and fragments that recognition makes up.
ACRONYMS = (
    "RBAC", "TACACS", "VRF", "ALB", "WAF", "VPN", "ACL", "API", "SSH", "TLS", "SSL", "DNS", "NTP", "AAA", "SSO", "MFA", "PCI", "AWS", "GCP", "SCP", "FTP",
    "S3", "SSP", "OMP", "TLOC", "IPSEC", "DTLS", "SAML", "HTTPS", "HTTP", "TCP", "UDP", "NAT", "BGP", "OSPF", "MPLS", "DMZ", "FQDN", "CIDR", "VLAN", "VXLAN",
    "GRE", "IKE", "PKI", "LDAP", "RADIUS", "SNMP", "MTU", "QOS", "SLA", "HA", "DR", "CI", "CD", "QA", "UI", "CLI", "SDK", "AMI", "VPC", "IAM",
)
KNOWN = r"(?i)\b(?:vManage|vBond|vSmart|vMonitor|vOrchestrator|vdaemon|SD-WAN|Self-Service|Portal|Jenkins|Bamboo|SonarQube|Okta|TACACS|RBAC)\b"
PROTOCOL = r"(?i)^(?:HTTPS?|TCP|UDP|SAML|TLS|DTLS|IPsec)(?:\s*\(?\d{2,5}\)?)?$"
FRAGMENTS, LABEL_FRAGMENTS = r"(?i)\b(?:py|ee|ted|in:|NEE|SEU|Pisco)\b", r"(?i)\b(?:py|ee|ted|NEE|Pisco|selese)\b"
MOST_TOKENS, MOST_KEPT, NEAR = 80, 10, 0.82
#: Share of a character's size that a gap between words is wider than.
GAP = 0.15
CELL = 100.0


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _count(text: Column, characters: str) -> Column:
    """Characters of a text that are in a class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))


def is_prose(text: Column) -> Column:
    """Whether recognised text reads as paragraphs: mostly long lines, or few and very long ones."""
    s = line_statistics(text)
    long_lines = (s["mean_length"] >= 48) & (s["n_long"] >= F.greatest(F.lit(2.0), 0.45 * s["n"]))
    return (s["n"] >= 2) & (s["n_chars"] >= 80) & (long_lines | ((s["n"] <= 4) & (s["mean_length"] >= 70)))


def is_drawing(text: Column, width: Column, height: Column) -> Column:
    """Whether a region is a drawing: large, with many short labels or words that hint at one. Little text alone says nothing."""
    s, hints = line_statistics(text), _hits(text, DRAWING)
    large, wide = (width >= 550) & (height >= 220), (width >= 700) & (height >= 180)
    labels = (large | wide) & (s["n"] >= 4) & (s["n_short"] >= 3) & (s["mean_length"] < 50)
    return labels | (large & (s["n"] >= 6) & (s["mean_length"] < 55)) | ((large | wide) & (hints >= 2) & (s["mean_length"] < 60)) | (large & (s["n_chars"] < 40) & (hints >= 1))


def is_data_table(text: Column) -> Column:
    """Whether a region is a grid of numbers: several networks, or many digits in lines with gaps."""
    s = line_statistics(text)
    digits, letters = _count(text, r"\d"), F.greatest(_count(text, r"\p{L}\p{N}"), F.lit(1))
    gaps = F.size(F.regexp_extract_all(text, F.lit(r"  |\t"), 0))
    networks = F.size(F.regexp_extract_all(text, F.lit(CIDR), 0))
    grid = (s["n"] >= 4) & (((digits > 0.22 * letters) & (gaps >= 5)) | ((digits > 0.2 * letters) & (gaps >= 3)))
    return (s["n"] >= 3) & (s["n_chars"] >= 40) & ((networks >= 2) | grid)


def region_kind(text: Column, width: Column, height: Column) -> Column:
    """Table, text_scan, network, process or other. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    s = line_statistics(text)
    addresses, host = F.size(F.regexp_extract_all(text, F.lit(ADDRESS), 0)), text.rlike(HOST)
    drawing, named = is_drawing(text, width, height), (addresses >= 2) | host
    digits, letters = _count(text, r"\d"), F.greatest(_count(text, r"\p{L}\p{N}"), F.lit(1))
    return (
        F.when(is_data_table(text), "table")
        .when(is_prose(text) & ~drawing, "text_scan")
        .when(drawing, F.when(named | (_hits(text, NETWORK) > _hits(text, PROCESS)), "network").otherwise("process"))
        .when(named & (width >= 400), "network")
        .when(F.length(text) < 25, F.when(_hits(text, SPARSE) > 0, "process").otherwise("other"))
        .when((width >= 600) & (height >= 250) & (s["n"] >= 3) & (s["mean_length"] < 55), F.when(digits < 0.12 * letters, "process").otherwise("network"))
        .otherwise("other")
    )


def is_garbled(token: Column) -> Column:
    """Whether a token is a broken fragment: too short, junk signs, no vowels, a doubled phrase, stray single letters."""
    t = F.trim(F.coalesce(token, F.lit("")))
    parts = F.filter(F.split(t, r"\s+"), lambda p: p != "")
    n, half = F.size(parts), F.floor(F.size(parts) / 2).cast("int")
    doubled = (n >= 4) & (F.slice(parts, F.lit(1), F.greatest(half, F.lit(1))) == F.slice(parts, half + 1, F.greatest(n - half, F.lit(1))))
    stray = (n >= 3) & t.rlike(r"\b[a-zA-Z]\b.*\b[a-zA-Z]\b") & (F.size(F.filter(parts, lambda p: F.length(p) == 1)) >= 2)
    mute = (_count(t, r"\p{L}") >= 4) & (_count(F.lower(t), "aeiou") == 0) & ~t.rlike(r"\d")
    return (F.length(t) < 3) | (_count(t, r"\p{L}\p{N}") < 3) | (_count(t, r"|\[\]{}<>~`@#$%^*_+=") >= 2) | mute | doubled | stray


def is_telling(token: Column) -> Column:
    """Whether a token is worth keeping where a description lacks it: links, addresses, hosts, protocols, known acronyms and
    names, labels of capitalised words, long technical words."""
    t = F.trim(F.coalesce(token, F.lit("")))
    words = F.filter(F.split(F.replace(t, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    sizes = F.transform(words, F.length)
    label = F.size(words).between(2, 6) & F.forall(words, lambda w: w.rlike(r"^[A-Z0-9][A-Za-z0-9+./-]{0,30}$")) & (F.aggregate(sizes, F.lit(0), lambda a, x: a + x) >= 8) & ~F.exists(sizes, lambda x: x == 1)
    spaceless = ~F.contains(t, F.lit(" "))
    yes = _any([t.rlike(r"(?i)^https?://\S+$"), t.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?$"), t.rlike(LINK) & spaceless, t.rlike(rf"^{CIDR}$"), t.rlike(HOST) & spaceless, t.rlike(PROTOCOL)])
    return ~is_garbled(t) & (
        F.when(yes, F.lit(True))
        .when(t.rlike("^[A-Z]{2,12}$"), t.isin(*ACRONYMS) | (F.length(t) >= 5))
        .when(t.rlike(KNOWN), ~t.rlike(FRAGMENTS))
        .otherwise(label | t.rlike(r"^[A-Z][A-Za-z0-9+./-]{5,40}$"))
    )


def tokens(text: Column) -> Column:
    """Candidates for keeping, links and addresses first, then names and acronyms, then clean labels; each once whatever its
    case, the first MOST_TOKENS."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != "")
    labels = F.filter(lines, lambda x: F.length(x).between(3, 48) & x.rlike(r"^\p{Lu}") & ~x.endswith(".") & ~x.rlike(LABEL_FRAGMENTS) & x.rlike("[A-Za-z]{3,}"))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (LINK, ADDRESSES, "(?i)(?:" + "|".join(NAMES) + ")")], labels)
    bare = F.filter(F.transform(found, lambda t: F.regexp_replace(F.trim(t), r"[.,;:)\]}]+$", "")), lambda t: ~is_garbled(t))
    low = F.transform(bare, F.lower)
    once = F.filter(F.transform(bare, lambda t, i: F.when(F.array_position(low, F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())
    return F.slice(once, 1, MOST_TOKENS)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _stands(token: Column, text: Column) -> Column:
    """Whether a text has the token: as it is, without other signs, or all its longer words. An address, which is a token without
    letters, has to stand there number by number: its digits in a row may be part of another number or name."""
    squeezed = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    apart = lambda x: F.concat(F.lit(" "), _plain(x), F.lit(" "))
    bare = F.when(F.lower(token).rlike("[a-z]"), F.contains(squeezed(text), squeezed(token))).otherwise(F.contains(apart(text), apart(token)))
    words = F.filter(F.split(_plain(token), " "), lambda w: F.length(w) > 2)
    has = F.split(_plain(text), " ")
    return _any([F.contains(F.lower(text), F.trim(F.lower(token))), bare, (F.size(words) > 0) & (F.size(F.array_except(words, has)) == 0)])


def _near(candidates: pd.Series, text: pd.Series) -> pd.Series:
    """Of each candidate whether a snippet of the text, or a window over a long one, is NEAR it."""
    from re import split, sub

    plain = lambda x: " ".join(sub("[^a-z0-9]+", " ", x.lower()).split())

    def near(token: str, snippets: list[str]) -> bool:
        for s in snippets:
            step = max(1, len(token) // 2)
            parts = [s] if len(s) <= max(80, len(token) + 20) else [s[i : i + len(token) + 8] for i in range(0, max(1, len(s) - len(token) + 1), step)]
            if any(SequenceMatcher(None, token, p).ratio() >= NEAR for p in parts):
                return True
        return False

    out = []
    for some, body in zip(candidates, text, strict=True):
        snippets = [p for p in map(plain, [*split(r"[\n,;|/]+", body or ""), body or ""]) if len(p) >= 3]
        out.append([near(plain(t), snippets) for t in (some if some is not None else [])])
    return pd.Series(out)


def kept_tokens(regions: DataFrame, description: str = "description", text: str = "text") -> DataFrame:
    """Regions and kept, the telling tokens of their text that a description of the figure lacks, MOST_KEPT at most. What
    the description has in about the same letters counts as there: only tokens that are left until then are compared so."""
    said = F.coalesce(F.col(description), F.lit(""))
    some = F.filter(F.filter(tokens(F.coalesce(F.col(text), F.lit(""))), is_telling), lambda t: ~_stands(t, said))
    near = F.pandas_udf(_near, T.ArrayType(T.BooleanType())).asNondeterministic()
    both = regions.withColumn("__some", some).withColumn("__near", F.when(F.size("__some") > 0, near("__some", said)))
    left = F.filter("__some", lambda t, i: ~F.coalesce(F.get("__near", i), F.lit(False)))
    return both.withColumn("kept", F.slice(left, 1, MOST_KEPT)).drop("__some", "__near")


def merged_description(description: Column, kept: Column) -> Column:
    """A figure's description, and behind it, inside its closing mark if it has one, what it lacks."""
    extra = F.concat(F.lit("Also visible (OCR identifiers not in description):\n"), F.array_join(F.transform(kept, lambda t: F.concat(F.lit("- "), t)), "\n"))
    at = F.instr(description, "[/Figure]")
    inside = F.concat(F.substring(description, F.lit(1), at - 1), extra, F.lit("\n"), F.substring(description, at, F.length(description)))
    return F.when(F.size(kept) == 0, description).when(at > 0, inside).otherwise(F.concat(description, F.lit("\n"), extra))


def box_regions(boxes: DataFrame, gap: float) -> DataFrame:
    """(doc_id, page, region, x0, top, x1, bottom, n, text, kind): groups of boxes that are no more than gap apart, however
    long the chain, region being the least box_id. boxes: doc_id, page, box_id (a string), x0, top, x1, bottom, text.

    Boxes are laid on a grid, widened by half the gap, so that near ones have a cell in common, and only such are compared;
    boxes of one place count as one. Text is in reading order, a line for each row of boxes.
    """
    place = ["doc_id", "page", "x0", "top", "x1", "bottom"]
    sites = boxes.groupBy(*place).agg(F.min("box_id").alias("site"))
    half = gap / 2
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - half) / CELL), F.floor((F.col(hi) + half) / CELL)))
    cells = sites.select("*", span("x0", "x1").alias("gx")).select("*", span("top", "bottom").alias("gy"))
    other = cells.select("doc_id", "page", "gx", "gy", *[F.col(c).alias(f"o_{c}") for c in ("site", "x0", "top", "x1", "bottom")])
    apart = lambda lo, hi: F.greatest(F.col(f"o_{lo}") - F.col(hi), F.col(lo) - F.col(f"o_{hi}"))
    near = cells.join(other, ["doc_id", "page", "gx", "gy"]).filter((F.col("site") < F.col("o_site")) & (apart("x0", "x1") <= gap) & (apart("top", "bottom") <= gap))
    name = lambda c: F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col(c))
    roots = connected(near.select(name("site").alias("a"), name("o_site").alias("b")).distinct()).select(F.col("node").alias("__node"), F.element_at(F.split("root", "\u0001"), -1).alias("__root"))
    member = boxes.join(sites, place).withColumn("__node", name("site")).join(roots, "__node", "left").withColumn("region", F.coalesce("__root", "site"))
    ordered = F.sort_array(F.collect_list(F.struct("top", "x0", "bottom", "box_id", "text")))

    def write(state: Column, box: Column) -> Column:
        below = box["top"] >= state["bottom"] - (box["bottom"] - box["top"]) / 2
        joint = F.when(state["text"].isNull(), F.lit("")).when(below, F.lit("\n")).otherwise(F.lit(" "))
        return F.struct(F.concat(F.coalesce(state["text"], F.lit("")), joint, F.coalesce(box["text"], F.lit(""))).alias("text"), F.when(below | state["text"].isNull(), box["bottom"]).otherwise(F.greatest(state["bottom"], box["bottom"])).alias("bottom"))

    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("bottom"))
    grouped = member.groupBy("doc_id", "page", "region").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("n"), ordered.alias("bs"))
    said = grouped.withColumn("text", F.aggregate("bs", start, write, lambda s: s["text"])).drop("bs")
    return said.withColumn("kind", region_kind(F.col("text"), F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")))


def line_texts(characters: DataFrame) -> DataFrame:
    """(doc_id, page, line_id, text): lines with the gaps that sheared letters hide.

    characters: doc_id, page, line_id, place, char, text (the line as it was read), upright, a, b, c, d, e (a character's text
    matrix: scale, turn, shear, scale, origin), advance, size. Boxes of sheared letters overlap the next one; their origins and
    advances don't. So in a level line with a sheared letter a space stands where a letter begins further behind the end of the
    one before than GAP of its size. A line with a letter that has no such figures, or is turned, stays as it was read, and so
    does one whose letters the read text doesn't have.
    """
    line = Window.partitionBy("doc_id", "page", "line_id").orderBy("place")
    end = F.col("e") + F.col("a") * F.col("advance")
    figures = [F.col(c) for c in ("a", "b", "c", "d", "e", "advance")]
    finite = reduce(lambda x, y: x & y, [f.isNotNull() & ~F.isnan(f.cast("double")) & (F.abs(f) < float("inf")) for f in figures])
    fit = finite & F.coalesce(F.col("upright"), F.lit(False)) & (F.abs(F.col("b")) <= 1e-6) & (F.col("a") > 0) & (F.col("d") > 0) & (F.col("advance") >= 0)
    gap = F.col("e") - F.lag(end).over(line) > GAP * F.lag("size").over(line)
    each = characters.withColumn("__fit", F.coalesce(fit, F.lit(False))).withColumn("__said", F.concat(F.when(F.coalesce(gap, F.lit(False)), F.lit(" ")).otherwise(F.lit("")), F.col("char")))
    written = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "__said"))), lambda x: x["__said"]), "")
    lines = each.groupBy("doc_id", "page", "line_id").agg(F.first("text").alias("read"), written.alias("w"), F.bool_and("__fit").alias("fit"), F.bool_or(F.coalesce(F.abs("c") > 1e-6, F.lit(False))).alias("sheared"))
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    read, w = F.trim(F.coalesce("read", F.lit(""))), F.trim("w")
    return lines.select("doc_id", "page", "line_id", F.when(F.col("sheared") & F.col("fit") & (bare(w) == bare(read)), w).otherwise(read).alias("text"))


def context_of_figure(section: Column, caption: Column, alt: Column, before: Column, after: Column) -> Column:
    """What a document says around a figure, as a hint for whoever describes it; empty if nothing. section: an array."""
    given = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    fields = F.array_compact(F.array(given("Section: ", F.array_join(section, " > ")), given("Caption: ", caption), given("Office alt text: ", alt), given("Text immediately before: ", F.substring(before, 1, 1000)), given("Text immediately after: ", F.substring(after, 1, 1000))))
    head = "\n\nDOCUMENT CONTEXT (use to disambiguate the image, but do not report context text as visually observed unless you can confirm it in the image):\n"
    return F.when(F.size(fields) > 0, F.concat(F.lit(head), F.array_join(fields, "\n"))).otherwise("")


def placed_figure(text: Column, label: Column, kind: Column, section: Column, caption: Column, alt: Column) -> Column:
    """A figure's text under its label, with what its document says about it in the lines behind the first; empty stays empty."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    named = F.regexp_replace(bare, F.lit(r"^\[Figure\s+[^\]—]+\s*—"), F.concat(F.lit("[Figure "), label, F.lit(" —")))
    whole = F.when(F.startswith(named, F.lit("[Figure")), named).otherwise(F.concat(F.lit("[Figure "), label, F.lit(" — "), kind, F.lit("]\n"), named, F.lit("\n[/Figure]")))
    given = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(name), x))
    lines = F.array_compact(F.array(given("Section: ", F.array_join(section, " > ")), given("Caption: ", caption), given("Alt text: ", alt)))
    first, rest = F.substring_index(whole, "\n", 1), F.substring(whole, F.length(F.substring_index(whole, "\n", 1)) + 1, F.length(whole))
    return F.when(bare == "", "").when(F.size(lines) > 0, F.concat(first, F.lit("\n"), F.array_join(lines, "\n"), rest)).otherwise(whole)
