"""Ranking and top-k: vectors, BM25, fusion, re-ranking, cut-offs, boosts, expansion."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.session import checkpoint, ship

K1, B, RRF = 1.2, 0.75, 60
#: Rows of a group that is packed into a budget.
MOST_ROWS = 100_000


def vector_topk(rows: DataFrame, query: Sequence[float], k: int = 10, vector: str = "vector", key: str = "id") -> DataFrame:
    """The k rows nearest to the query by squared Euclidean distance, with distance and score; ties by key.

    rows are filtered to the caller's scope beforehand. An exact scan: partial top-k per task, one merge of k rows each.
    """
    near = rows.withColumn("distance", V.l2(F.col(vector), V.literal(query))).filter("distance is not null")
    return near.orderBy("distance", key).limit(k).withColumn("score", V.similarity(F.col("distance")))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def postings(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """term, key, tf and the row's length: an inverted index to be written once, bucketed by term."""
    base = rows.select(F.col(key), tokens(F.col(text)).alias("w"))
    return base.select(key, F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("term", key, "len").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class TermIndex:
    """An inverted index, written once: postings in buckets of their terms, sorted by term, and the facts of the whole.

    A question reads the buckets of its terms, and of these the row groups with the terms: the texts are never read again.
    """

    spark: SparkSession
    path: str
    key: str
    buckets: int

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str = "id", text: str = "text", buckets: int = 64) -> TermIndex:
        """buckets should grow with the vocabulary; a term's postings are one sorted run, however common it is."""
        spark = rows.sparkSession
        size = rows.select(F.size(tokens(F.col(text))).alias("len"))
        size.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).write.parquet(f"{path}/facts")
        p = postings(rows, key, text).withColumn("bucket", cls._bucket(F.col("term"), buckets))
        # dealt by ranges of (bucket, term, key): a common term may fill several tasks
        p.repartitionByRange("bucket", "term", key).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        return cls(spark, path, key, buckets)

    def search(self, query: str, k: int = 10, keys: DataFrame | None = None) -> DataFrame:
        """The k best rows by BM25, ties by key; keys: only these rows may be among them. Facts are those of all rows."""
        terms = query_words(query)
        number = {t: r for t, r in zip(terms, self.spark.range(1).select(*[self._bucket(F.lit(t), self.buckets).alias(f"b{i}") for i, t in enumerate(terms)]).first() or (), strict=True)}
        found = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket").isin(*set(number.values())) & F.col("term").isin(*terms))
        facts = self.spark.read.parquet(f"{self.path}/facts").first()  # one row
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term asked for
        idf = F.lit(0.0)
        for t, n in df.items():
            idf = F.when(F.col("term") == t, F.lit(math.log(1 + (facts["n"] - n + 0.5) / (n + 0.5)))).otherwise(idf)
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (facts["avg_len"] or 1.0)))
        found = found if keys is None else found.join(keys.select(self.key), self.key, "left_semi")
        return found.groupBy(self.key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), self.key).limit(k)


def query_words(query: str) -> list[str]:
    """Distinct tokens of a question, see tokens()."""
    return sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})


def _times(tokens_: Column, term: str) -> Column:
    return F.size(F.filter(tokens_, lambda w: w == term))


def bm25(rows: DataFrame, query: str, k: int = 10, key: str = "id", text: str = "text") -> DataFrame:
    """The k rows that match best by BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5))); ties by key.

    Term frequencies are counted inside the row. The texts are read once: a key, a length and a few counts of each row are written
    (checkpointed), and both N, the mean length and document frequencies and the matching rows come from these.
    """
    terms = query_words(query)
    if not terms:
        return rows.select(key).withColumn("score", F.lit(0.0)).limit(0)
    words = tokens(F.col(text))  # the question's words of a row are picked once, then counted among few
    base = rows.select(F.col(key), F.size(words).alias("len"), F.filter(words, lambda w: w.isin(*terms)).alias("w"))
    counts = checkpoint(base.select(key, "len", *[_times(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    facts = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hit = counts.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(facts))  # facts is one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hit.select(key, total.alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """H4: rows of a short list with rank from 0. The list is a top-k, so one task orders it."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def rrf(lists: Sequence[DataFrame], key: str = "id", k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of lists with key and rank (from 0)."""
    every = lists[0].select(key, "rank")
    for one in lists[1:]:
        every = every.unionByName(one.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def hybrid(rows: DataFrame, query: Sequence[float], question: str, k: int = 10, key: str = "id", vector: str = "vector", text: str = "text", depth: int | None = None) -> DataFrame:
    """Vector and BM25 lists of the same scope, fused."""
    depth = depth or max(k, 50)
    near = ranked(vector_topk(rows, query, depth, vector, key), [F.col("distance"), F.col(key)])
    match = ranked(bm25(rows, question, depth, key, text), [F.desc("score"), F.col(key)])
    return rrf([near, match], key).orderBy(F.desc("score"), key).limit(k)


def lexical_score(question: str, text: Column) -> Column:
    """Default scorer of a re-ranking: share of the question's terms in the text."""
    terms = sorted(set(question.lower().split()))
    if not terms:
        return F.lit(0.0)
    return sum((F.lower(text).contains(t).cast("double") for t in terms), F.lit(0.0)) / len(terms)


def rerank(chunks: DataFrame, model_score: Column, top_n: int, key: str = "id", score: str = "score", synthetic: str | None = None, boost: Column | None = None) -> DataFrame:
    """The top_n chunks by score are ordered anew by a model's score, above all others.

    Model scores are scaled to 0-1 over the head, lifted above the best of the tail, and boosted. Synthetic chunks keep
    their score; with fewer than two others nothing changes. The head is a top-k.
    """
    fake = F.coalesce(F.col(synthetic), F.lit(False)) if synthetic else F.lit(False)
    head_keys = chunks.filter(~fake).orderBy(F.desc(score), key).limit(top_n)
    head = head_keys.withColumn("__m", model_score)
    bounds = head.agg(F.min("__m").alias("__lo"), F.max("__m").alias("__hi"), F.count("*").alias("__n"))
    rest = chunks.join(F.broadcast(head.select(key)), key, "left_anti")  # top_n keys
    tail = rest.filter(~fake).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("__tail"))
    new = F.col("__tail") + 0.01 + F.when(F.col("__hi") > F.col("__lo"), (F.col("__m") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.5))
    new = new + (boost if boost is not None else F.lit(0.0))
    lifted = head.crossJoin(bounds).crossJoin(tail).withColumn(score, F.when(F.col("__n") < 2, F.col(score)).otherwise(new)).select(*chunks.columns)
    return lifted.unionByName(rest.select(*chunks.columns)).orderBy(F.desc(score), key)


def min_score(rows: DataFrame, least: float, score: str = "score") -> DataFrame:
    """C6."""
    return rows.filter(F.col(score) >= least)


def relative_cut(rows: DataFrame, share: float = 0.3, score: str = "score") -> DataFrame:
    """Rows with at least share of the best score; all if the best isn't above 0. The best is one aggregate, not a window."""
    best = rows.agg(F.max(score).alias("__top"))
    return rows.crossJoin(F.broadcast(best)).filter((F.col("__top") <= 0) | (F.col(score) >= share * F.col("__top"))).drop("__top")


def evidence_cut(rows: DataFrame, synthetic: str, score: str = "score") -> DataFrame:
    """Synthetic rows, and of more than ten others those with a tenth of the best score (0.01 at least) or a score of 0."""
    facts = rows.filter(~F.col(synthetic)).agg(F.count("*").alias("__n"), F.max(score).alias("__top"))
    met = rows.crossJoin(F.broadcast(facts))
    return met.filter(F.col(synthetic) | (F.col("__n") <= 10) | (F.col(score) >= F.greatest(F.lit(0.01), 0.1 * F.col("__top"))) | (F.col(score) == 0)).drop("__n", "__top")


def normalised(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores by the best one, all 0 if that isn't above 0."""
    best = rows.agg(F.max(score).alias("__top"))
    return rows.crossJoin(F.broadcast(best)).withColumn("relevance", F.when(F.col("__top") > 0, F.col(score) / F.col("__top")).otherwise(F.lit(0.0))).drop("__top")


def apply_boosts(rows: DataFrame, boosts: DataFrame, doc: str = "doc_id", score: str = "score") -> DataFrame:
    """Scores with their document's boost, 0 if it has none."""
    return rows.join(boosts.select(doc, "boost"), doc, "left").withColumn(score, F.col(score) + F.coalesce("boost", F.lit(0.0))).drop("boost")


def drop_negative(rows: DataFrame, boosts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of documents that feedback doesn't speak against."""
    return rows.join(boosts.filter("boost < 0").select(doc), doc, "left_anti")


def feedback_boosts(log: DataFrame, query: Sequence[float], now: Column, least: float = 0.85, half_life: float = 90.0) -> DataFrame:
    """Boost per document from what was cited, relevant or irrelevant for similar past questions, halved every 90 days.

    log: id, query_hash, vector, doc_id, was_cited, was_relevant, created_at. The similarity of a question is that of its
    first row's vector, computed once.
    """
    first = log.groupBy("query_hash").agg(F.min_by("vector", "id").alias("v"))
    near = first.withColumn("sim", V.cosine(F.col("v"), V.literal(query))).filter(F.col("sim") >= least).select("query_hash", "sim")
    weight = F.when(F.col("was_cited"), 0.3).when(F.col("was_relevant"), 0.2).otherwise(-0.1)
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400.0)
    return log.join(near, "query_hash").groupBy("doc_id").agg(F.sum(weight * F.pow(F.lit(0.5), age / half_life)).alias("boost"))


def term_idf(terms: Sequence[str], blobs: DataFrame, blob: str = "blob") -> DataFrame:
    """ln((n + 1) / (df + 1)) of each term, df by substring; 1 where there are no rows. One pass, no row per pair."""
    counts = [F.count_if(F.col(blob).contains(t)).alias(f"d{i}") for i, t in enumerate(terms)]
    one = blobs.agg(F.count("*").alias("n"), *counts)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"d{i}").alias("df")) for i, t in enumerate(terms)])
    return one.select("n", F.explode(pairs).alias("x")).select("x.term", "x.df", F.when(F.col("n") == 0, 1.0).otherwise(F.log((F.col("n") + 1) / (F.col("x.df") + 1))).alias("idf"))


def match_score(idf: dict[str, float], blob: Column) -> Column:
    """Sum of the idf of the terms that a text contains."""
    return sum((F.when(blob.contains(t), F.lit(w)).otherwise(0.0) for t, w in idf.items()), F.lit(0.0))


def prf_terms(docs: DataFrame, fields: Sequence[str], question: str, most: int = 10) -> DataFrame:
    """The commonest tag values of the nearest documents that the question lacks, with place; ties by first appearance.

    docs: the top documents, with pos (their order) and array columns.
    """
    every = docs.select("pos", F.posexplode(F.flatten(F.array(*[F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields]))).alias("at", "term"))
    counted = every.filter(F.length("term") > 2).groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("pos", "at")).alias("first"))
    top = counted.orderBy(F.desc("n"), "first").limit(2 * most)
    return top.filter(~F.lit(question.lower()).contains(F.lower("term"))).orderBy(F.desc("n"), "first").limit(most).select("term", "n")


def neighbours(seeds: DataFrame, chunks: DataFrame, window: int = 1, score: float = 0.4) -> DataFrame:
    """Seeds and the chunks up to window places beside them in document and tier, with a low score.

    The band becomes a key: each seed asks for its places by number, so the join is an equality. Figures ask for none.
    """
    wanted = seeds.filter(F.coalesce(F.col("content_type") != "figure", F.lit(True))).select(
        "doc_id", "chunk_size_tier", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")
    )
    wanted = wanted.filter("chunk_index >= 0").distinct().join(seeds.select("doc_id", "chunk_size_tier", "chunk_index"), ["doc_id", "chunk_size_tier", "chunk_index"], "left_anti")
    found = chunks.join(wanted, ["doc_id", "chunk_size_tier", "chunk_index"], "left_semi").withColumn("score", F.lit(score))
    return seeds.unionByName(found.select(*seeds.columns)).orderBy("doc_id", "chunk_index")


def greedy_budget(rows: DataFrame, group: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows admitted in order while they fit; one that doesn't is skipped and later ones still may.

    Not a running sum, so each group is folded in Python. Groups are bounded before (a section's or an answer's rows): one
    of over MOST_ROWS is an error.
    """
    schema = rows.schema

    def admit(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MOST_ROWS:
            raise ValueError(f"a group of {len(frame)} rows: bound it before it is packed")
        frame = frame.sort_values(list(order), kind="stable")
        left, keep = budget, []
        for n in frame[size]:
            keep.append(n <= left)
            left -= n if n <= left else 0
        return frame[keep]

    ship(rows.sparkSession)
    return rows.groupBy(*group).applyInPandas(admit, schema)


def section_expansion(seeds: DataFrame, chunks: DataFrame, budget: int = 16_000, sections: int = 6, rows: int = 128) -> DataFrame:
    """The rows of the seeds' first sections, within a budget of characters; score is the document's best seed's."""
    first = seeds.filter("coalesce(section_id, '') != ''").groupBy("doc_id", "section_id", "chunk_size_tier").agg(F.max("score").alias("best"), F.min(F.struct((-F.col("score")).alias("s"), F.col("chunk_index"))).alias("o"))
    chosen = first.orderBy("o", "doc_id", "section_id").limit(sections)
    per_doc = seeds.groupBy("doc_id").agg(F.max("score").alias("doc_best"))
    met = chunks.drop("score").join(chosen.select("doc_id", "section_id", "chunk_size_tier"), ["doc_id", "section_id", "chunk_size_tier"])
    place = F.row_number().over(Window.partitionBy("doc_id", "section_id", "chunk_size_tier").orderBy("chunk_index", "id"))
    met = met.withColumn("place", place).filter(F.col("place") <= rows).join(per_doc, "doc_id", "left").withColumn("score", F.coalesce("doc_best", F.lit(0.4)))
    met = met.withColumn("one", F.lit(1)).withColumn("n_chars", F.length("text")).select("id", "doc_id", "section_id", "chunk_size_tier", "chunk_index", "text", "score", "one", "n_chars")
    return greedy_budget(met, ["one"], ["doc_id", "section_id", "chunk_index"], "n_chars", budget).drop("one")


def figure_pages(anchors: DataFrame, prose: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """Prose near figures: up to one page before and two after, nearest first. The range becomes a key."""
    wanted = anchors.select("doc_id", F.col("page").alias("anchor"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - before), F.col("page") + after)).alias("page"))
    met = prose.join(wanted, ["doc_id", "page"])
    return met.withColumn("away", F.abs(F.col("page") - F.col("anchor"))).groupBy(*prose.columns).agg(F.min(F.struct("away", (F.col("page") < F.col("anchor")).alias("ahead"))).alias("near")).select(*prose.columns, "near.away", "near.ahead")


def keyed_union(present: DataFrame, added: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of present, and of added those whose key present lacks, the first of each key."""
    fresh = added.join(present.select(*key), list(key), "left_anti")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = fresh.withColumn("__p", place).filter("__p = 1").drop("__p")
    return present.unionByName(fresh)


def date_condition(question: str, dates: Column, filename: Column) -> Column:
    """Documents that name the month and day of a question, in their tags (any case) or their name. No date: all."""
    import re

    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    m = re.search(r"\b(" + "|".join(months) + r")\s+(\d{1,2})", question.lower())
    if not m:
        return F.lit(True)
    month, day = m[1], int(m[2])
    number = months.index(month) + 1
    forms = [f"{month.capitalize()} {day}", f"{month[:3].capitalize()} {day}", f"{number:02d}-{day:02d}", f"{number}/{day}", f"{month.capitalize()}-{day}"]
    tagged = F.exists(F.coalesce(dates, F.array().cast("array<string>")), lambda d: X.any_of(F.lower(d), [f.lower() for f in forms]))
    return tagged | X.any_of(filename, forms)


def per_document(rows: DataFrame, limit: int, doc: str = "doc_id", order: Sequence[str] = ("chunk_index",)) -> DataFrame:
    """The first rows of each document; Spark keeps a group's first rows before it shuffles."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return rows.withColumn("__p", place).filter(F.col("__p") <= limit).drop("__p")


def tier_fallback(rows: DataFrame, tiers: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Of each document the rows of the first of tiers that it has, of the least other one if it has none."""
    rank = F.coalesce(F.when(F.col("chunk_size_tier").isin(*tiers), F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("chunk_size_tier"))), F.lit(len(tiers) + 1))
    best = rows.groupBy(doc).agg(F.min(F.struct(rank.alias("r"), F.col("chunk_size_tier").alias("t"))).alias("b")).select(doc, F.col("b.t").alias("chunk_size_tier"))
    return rows.join(best, [doc, "chunk_size_tier"], "left_semi")


def page_of(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """O2: a page, and whether there is more after it."""
    some = rows.orderBy(*order).offset(offset).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))
    return some.withColumn("__p", place).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).filter(F.col("__p") <= limit).drop("__p")


def expand_query(question: str, terms: Sequence[str]) -> str:
    return f"{question} {' '.join(terms)}" if terms else question


Scorer = Callable[[str, Column], Column]
