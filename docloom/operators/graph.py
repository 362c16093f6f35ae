"""Entity graph: matching, traversal, reconciliation, views."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import checkpoint, ship


def entity_key(name: Column) -> Column:
    """The loosest form in which names match: lower case, dots, hyphens and white space as one space; short names only as they are."""
    loose = F.trim(F.regexp_replace(F.lower(name), r"[.\-\s]+", " "))
    return F.when(F.length(loose) >= 3, loose).otherwise(F.lower(name))


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(canonical, entity_type, name, first_doc): mentions under one key and type are one entity, named by the
    longest name, of equally long ones the one with more capitals, then the first by code point."""
    capitals = F.length(F.regexp_replace("name", "[^A-Z]", ""))
    order = F.struct(F.length("name").alias("n"), capitals.alias("c"))
    keyed = mentions.withColumn("canonical", entity_key(F.col("name")))
    names = keyed.groupBy("canonical", "entity_type", "name").agg(F.min("doc_id").alias("doc"), F.count("*").alias("m"), F.max(order).alias("o"))
    best = F.max(F.struct("o", F.struct(F.col("name").alias("x")).alias("x")))
    out = names.groupBy("canonical", "entity_type").agg(best.alias("b"), F.min("doc").alias("first_doc"), F.sum("m").alias("n_mentions"), F.count("*").alias("n_names"))
    return out.select("canonical", "entity_type", F.col("b.x.x").alias("name"), "first_doc", "n_mentions", "n_names")


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, types: Sequence[str] | None = None) -> DataFrame:
    """(node, hop): nodes within depth links of the seeds, either way, with the least number of links.

    An edge list both ways turns source-or-target into an equality; each hop joins the frontier only, and visited nodes
    are taken out by an anti-join. The lineage grows with depth, which callers bound.
    """
    some = edges if types is None else edges.filter(F.col("relation_type").isin(*types))
    both = some.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(some.select(F.col("target").alias("u"), F.col("source").alias("v"))).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        fresh = both.join(frontier.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    keep = nodes.select("node").distinct()
    return edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi")


def described(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends' names; edges with a missing end are dropped."""
    s = entities.select(F.col("node").alias("source"), F.col("name").alias("source_name"))
    t = entities.select(F.col("node").alias("target"), F.col("name").alias("target_name"))
    return edges.join(s, "source").join(t, "target")


def entity_details(edges: DataFrame, entities: DataFrame, node) -> DataFrame:
    """Links of an entity with direction and the other end's name, unknown if it is missing."""
    out = edges.filter(F.col("source") == node).select(F.col("target").alias("other"), "relation_type", F.lit("outgoing").alias("direction"))
    into = edges.filter(F.col("target") == node).select(F.col("source").alias("other"), "relation_type", F.lit("incoming").alias("direction"))
    return out.unionByName(into).join(entities.select(F.col("node").alias("other"), "name"), "other", "left").withColumn("name", F.coalesce("name", F.lit("unknown")))


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that nothing mentions."""
    return entities.join(mentions.select("node"), "node", "left_anti")


def merged(edges: DataFrame, mapping: DataFrame, ends: Sequence[str] = ("source", "target")) -> DataFrame:
    """M5: edges with merged nodes (remove -> keep) replaced; what becomes a self link or a repetition goes (I8)."""
    out = edges
    for end in ends:
        m = mapping.select(F.col("remove").alias(f"__{end}"), F.col("keep").alias(f"__{end}k"))
        out = out.join(m, F.col(end) == F.col(f"__{end}"), "left").withColumn(end, F.coalesce(f"__{end}k", end)).drop(f"__{end}", f"__{end}k")
    return out.filter(F.col(ends[0]) != F.col(ends[1])).dropDuplicates()


#: Names of a type that share a word, above which the word only counts together with another one of the name.
HOT = 64
# Confidences from which a judged pair is merged at once, or proposed for review.
MERGED, PROPOSED = 0.9, 0.7


def _same(a: Column, b: Column) -> Column:
    """Whether two names are equal but for case and white space around them."""
    bare = lambda name: F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    return bare(a) == bare(b)


def blocks(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, entity_type, k) of names (node, name, entity_type): what two names that may mean one entity share at least one of; and
    (node, entity_type, k, short) of common initials, by which only a short name and one of several words meet.

    Words; the initials of a name of several words, which is what an acronym of it looks like; and beginnings and ends of the name
    without white space, which an error elsewhere leaves alone. A word, beginning or end that more than HOT names of a type have
    is no key by itself: it counts together with each other one of the name that isn't of the same characters (an end and the word that it
    ends in say one thing), and the name meets by its whole set of words. Names of several words also meet by initials that they share, if no
    more than HOT names have them.
    """
    loose = F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", " "))
    words = F.array_distinct(F.split(loose, " "))
    tight = F.replace(loose, F.lit(" "), F.lit(""))
    initials = F.array_join(F.transform(F.split(loose, " "), lambda w: F.substring(w, 1, 1)), "")
    acronym = F.when(F.size(words) > 1, initials).when(F.length(tight) <= 6, tight)
    ends = F.array(F.concat(F.lit("b:"), F.substring(tight, 1, 4)), F.concat(F.lit("e:"), F.substring(tight, -4, 4)))
    parts = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), ends))
    each = names.filter(loose != "").select("node", "entity_type", F.array_sort(words).alias("ws"), acronym.alias("acronym"), F.explode(parts).alias("p"))
    hot = each.groupBy("entity_type", "p").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("entity_type", "p", F.lit(True).alias("hot"))
    told = each.join(hot, ["entity_type", "p"], "left").groupBy("node", "entity_type", "ws", "acronym").agg(F.collect_set(F.struct("p", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("ps"))
    rare = F.transform(F.filter("ps", lambda x: ~x["hot"]), lambda x: x["p"])
    often = F.transform(F.filter("ps", lambda x: x["hot"]), lambda x: x["p"])
    whole = F.array(F.concat(F.lit("s:"), F.array_join("ws", " ")))
    told = checkpoint(told.select("node", "entity_type", "acronym", (F.size("ws") <= 1).alias("short"), often.alias("often"), F.array_distinct(F.concat(rare, whole)).alias("ks")))

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows by whether at most HOT names of the type have the key, and the others."""
        rows = checkpoint(rows)
        over = rows.groupBy("entity_type", "k").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("entity_type", "k")
        return rows.join(over, ["entity_type", "k"], "left_anti"), rows.join(over, ["entity_type", "k"], "left_semi")

    bare = lambda x: F.substring(x, 3, F.length(x))
    within = lambda x, y: F.when(F.startswith(x, F.lit("b:")), F.startswith(bare(x), bare(y)) | F.startswith(bare(y), bare(x))).when(F.startswith(x, F.lit("e:")), F.endswith(bare(x), bare(y)) | F.endswith(bare(y), bare(x))).otherwise(False)
    both = F.flatten(F.transform("often", lambda x: F.transform(F.filter("often", lambda y: (y > x) & ~(F.startswith(y, F.lit("w:")) & within(x, y))), lambda y: F.concat(x, F.lit("|"), y))))
    joint = told.select("node", "entity_type", F.explode(both).alias("k"))
    initials, common = parted(told.filter("acronym is not null").select("node", "entity_type", F.concat(F.lit("a:"), "acronym").alias("k"), "short"))
    return told.select("node", "entity_type", F.explode("ks").alias("k")).unionByName(joint).unionByName(initials.drop("short")), common


def merge_candidates(entities: DataFrame, most_difference: float = 0.7, blocked: bool = True) -> DataFrame:
    """(keep, remove, outcome): pairs of one type whose names may be the same, keep < remove. `auto`: equal but for case and
    white space around them; `judge`: a judge has to say, see reconciled().

    Pairs meet in blocks(); without blocked each two spellings of a type meet, which is exact, and a square of a type's spellings.
    Nodes of one spelling are a class: pairs are between the least nodes of two spellings, and name_classes() says who belongs
    to them, so that a common name gives no more pairs than a rare one. Pairs whose lengths differ by over 70 % are left out.
    """
    e = name_classes(entities).filter("node = keep").select("node", "name", "entity_type")
    names = [e.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"), "entity_type") for end in ("keep", "remove")]
    if blocked:
        keys, common = blocks(e)
        keys = checkpoint(keys)
        x, y = keys.select(F.col("node").alias("keep"), "entity_type", "k"), keys.select(F.col("node").alias("remove"), "entity_type", "k")
        short, several = common.filter("short").select(F.col("node").alias("x"), "entity_type", "k"), common.filter("not short").select(F.col("node").alias("y"), "entity_type", "k")
        told = short.join(several, ["entity_type", "k"]).select(F.least("x", "y").alias("keep"), F.greatest("x", "y").alias("remove"))
        met = x.join(y, ["entity_type", "k"]).filter("keep < remove").select("keep", "remove").unionByName(told).distinct()
        both = met.join(names[0], "keep").join(names[1].drop("entity_type"), "remove")
    else:
        both = names[0].join(names[1], "entity_type").filter("keep < remove")
    la, lb = F.length("keep_name"), F.length("remove_name")
    near = both.filter(F.abs(la - lb) <= most_difference * F.greatest(la, lb))
    return near.select("keep", "remove", "keep_name", "remove_name", "entity_type", F.when(_same(F.col("keep_name"), F.col("remove_name")), "auto").otherwise("judge").alias("outcome"))


def reconciled(entities: DataFrame, judge: Callable[[str, str, str], dict], before: DataFrame | None = None) -> DataFrame:
    """M6: proposals (keep, remove, confidence, reason, status) for entities (node, name, entity_type).

    judge(name, name, type) says {"is_same", "confidence", "reason"}; it runs on executors, once for each pair of spellings. A
    call that fails, or says no, or is less sure than PROPOSED, leaves nothing. status: `auto_merged` or `pending`. before: proposals,
    or pairs that were looked at, of an earlier run (keep, remove): they aren't judged again, so that a run that broke off goes
    on where its written table ends.
    """
    ship(entities.sparkSession)
    pairs = merge_candidates(entities)
    if before is not None:
        pairs = pairs.join(before.select("keep", "remove").distinct(), ["keep", "remove"], "left_anti")
    kind = pairs.schema["keep"].dataType.simpleString()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for keep, remove, a, b, of in frame[["keep", "remove", "keep_name", "remove_name", "entity_type"]].itertuples(index=False, name=None):
                try:
                    said = judge(a, b, of)
                    out.append((keep, remove, float(said.get("confidence", 0.0)) if said.get("is_same") else 0.0, str(said.get("reason", ""))))
                except Exception:  # noqa: BLE001: a model's failure concerns one pair
                    continue
            yield pd.DataFrame(out, columns=["keep", "remove", "confidence", "reason"])

    judged = pairs.filter("outcome = 'judge'").mapInPandas(ask, f"keep {kind}, remove {kind}, confidence double, reason string")
    status = verdict(F.col("confidence"))
    asked = judged.withColumn("status", F.when(status == "auto", "auto_merged").when(status == "propose", "pending")).filter("status is not null")
    equal = pairs.filter("outcome = 'auto'").select("keep", "remove", F.lit(1.0).alias("confidence"), F.lit("Exact match (case-insensitive)").alias("reason"), F.lit("auto_merged").alias("status"))
    return equal.unionByName(asked)


def name_classes(entities: DataFrame) -> DataFrame:
    """M6: entities (node, name, entity_type) and keep, the least node of their spelling and type."""
    least = entities.groupBy("name", "entity_type").agg(F.min("node").alias("keep"))
    return entities.select("node", "name", "entity_type").join(least, ["name", "entity_type"]).select("node", "name", "entity_type", "keep")


def verdict(confidence: Column) -> Column:
    """M6: what a judge's confidence leads to."""
    return F.when(confidence >= MERGED, "auto").when(confidence >= PROPOSED, "propose").otherwise("reject")


def view(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """M9: nodes with the size they are drawn in: 20 and 5 for each mention, 60 at most."""
    counts = mentions.groupBy("node").agg(F.count("*").alias("n_mentions"))
    n = F.coalesce("n_mentions", F.lit(0))
    return entities.join(counts, "node", "left").withColumn("n_mentions", n.cast("long")).withColumn("size", F.least(F.lit(60), F.greatest(F.lit(20), 20 + 5 * F.col("n_mentions"))).cast("long"))


def search(entities: DataFrame, query: str, entity_type: str | None = None) -> DataFrame:
    """Entities whose name contains the query, whatever its case."""
    out = entities.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    return out if entity_type is None else out.filter(F.col("entity_type") == entity_type)


# Names that extraction yields but nobody means, and marks of navigation text.
JUNK = ("the", "this", "that", "it", "he", "she", "they", "we", "you", "unknown", "none", "n/a", "null", "document", "section", "page", "table", "figure")
NAVIGATION = ("skip to main content", "privacy policy", "terms of use", "site map", "sitemap", "contact us", "subscribe", "follow us", "share this", "copyright", "all rights reserved", "cookie")


def is_junk(name: Column) -> Column:
    """Names too short or too common to be entities."""
    bare = F.lower(F.trim(name))
    return (F.length(bare) <= 1) | bare.isin(*JUNK)


def is_navigation(text: Column, least: int = 2) -> Column:
    """Chunks with two or more marks of navigation."""
    low = F.lower(text)
    return sum((low.contains(m).cast("int") for m in NAVIGATION), F.lit(0)) >= least


def extract(mentions: DataFrame, find: Callable[[Column], Column]) -> DataFrame:
    """M8: mentions found in the first 4000 characters of each chunk by a pluggable function, junk left out."""
    found = mentions.filter(~is_navigation(F.col("text"))).select("doc_id", "chunk_index", F.explode(find(F.substring("text", 1, 4000))).alias("name"))
    return found.filter(~is_junk(F.col("name")))


def capitalised(text: Column) -> Column:
    """Default finder: runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*)"), 1))


def hubs(edges: DataFrame, most: int = 100) -> DataFrame:
    """The most nodes with the most links, both ways."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(most)


def sizes(edges: DataFrame) -> DataFrame:
    """Numbers of nodes and links, links counted once each."""
    links = edges.select("source", "target").distinct().agg(F.count("*").alias("n_edges"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().agg(F.count("*").alias("n_nodes"))
    return nodes.crossJoin(links)  # one row each


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the least node that it is connected with, however long the way.

    Rounds of two steps, until nothing changes: all neighbours above a node are linked to the least of its neighbourhood, then
    all below it. They grow with the logarithm of the longest way; each is checkpointed.
    """
    def down(edges: DataFrame) -> DataFrame:
        return edges.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).filter("hi != lo").distinct()

    def meet(rows: DataFrame, node: str, least: DataFrame) -> DataFrame:
        """rows with m of their node. By another form of the node: both sides are shuffled, and Spark can split a hub over tasks."""
        other = least.select(F.concat(F.lit("n"), F.col(node).cast("string")).alias("__w"), "m")
        return rows.withColumn("__w", F.concat(F.lit("n"), F.col(node).cast("string"))).join(other, "__w")

    now, seen = checkpoint(down(links.select(F.col(a).alias("x"), F.col(b).alias("y")))), None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = down(meet(both.filter("v > u"), "u", least).select(F.col("v").alias("x"), F.col("m").alias("y")))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = meet(large, "hi", least).select(F.col("lo").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("hi").alias("x"), F.col("m").alias("y")))
        now = checkpoint(down(small))
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
    star = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
