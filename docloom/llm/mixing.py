"""Mixing sources to target weights by subset-sum budget fitting.

Of each source whole rounds are taken while its target holds them. What is left of the target is fitted: documents are
counted by exact length, the lengths give proportional shares, and a bounded knapsack over the documents that are left
fills the remaining budget to the word where lengths allow it. Then the seeded order picks that many documents of each
length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm._common import WORD, apart, boxed, checkpoint, text_key, unboxed

#: Weights that repeat over the sources in order, share of all sizes to hand out, and the most of its size a source gives.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Average documents' worth of a budget that is left to the knapsack.
ROOM = 4
#: Documents of a length that a window of the selection sees at most, about.
SLICE = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, source: str = "source", size: str = "source_size", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (a row each, source may be null) and target: share of all sizes by weight, in order of code points, null last.

    A target stops at most times the source's size, and the excess is shared again: that is the level L at which the sum
    of min(most * size, L * weight) is the whole. In order of most * size / weight the full sources come first.
    """
    order = Window.orderBy(F.col(source).isNull(), F.encode(F.col(source), "UTF-8"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    rows = sources.select(source, size, w.alias("w"), (F.col(size) * F.lit(float(most))).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col(source).isNull(), F.col(source))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("wleft", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("whole", F.sum(size).over(Window.partitionBy()) * F.lit(float(share)))
    # the level if all before are full and this and all later ones aren't; the first source it doesn't fill sets it
    rows = rows.withColumn("level", (F.col("whole") - F.col("full")) / F.col("wleft"))
    rows = rows.withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("level", level).select(source, size, F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _shares(lengths: list[int], free: list[int], budget: int) -> list[int]:
    """Proportional shares of a budget in whole documents, from the shortest length to the longest: what rounding leaves over
    is carried on to the next length, so that every stretch of lengths gets its share, and less than the longest is left."""
    total = sum(n * c for n, c in zip(lengths, free, strict=True))
    take, due, given = [], 0, 0
    for n, c in zip(lengths, free, strict=True):
        due += n * c
        k = min(c, (budget * due // total - given) // n)
        take.append(k)
        given += k * n
    return take


def _subset(lengths: list[int], free: list[int], left: int) -> list[int]:
    """Bounded knapsack: of the sums that documents can reach, the nearest to left, the lower of two; how many of each length.

    The sums reached so far are kept in order, each with the part that reached it first, and so can be taken apart again.
    """
    top = 2 * left  # nothing at all is nearer than sums beyond
    sums, by = np.zeros(1, np.int64), np.full(1, -1, np.int64)
    parts: list[tuple[int, int]] = []
    for i, (n, c) in enumerate(zip(lengths, free, strict=True)):
        c, k = min(c, top // n), 1
        while c > 0:  # binary parts of the count: each is taken or not
            k = min(k, c)
            grown = sums + n * k
            grown = grown[grown <= top]
            grown = grown[sums[np.minimum(np.searchsorted(sums, grown), len(sums) - 1)] != grown]
            if len(grown):
                at = np.searchsorted(sums, grown)
                sums, by = np.insert(sums, at, grown), np.insert(by, at, len(parts))
                parts.append((i, k))
            c -= k
            k *= 2
        if sums[min(np.searchsorted(sums, left), len(sums) - 1)] == left:
            break
    best = int(np.argmin(np.abs(sums - left)))
    take = [0] * len(lengths)
    while by[best] >= 0:
        i, k = parts[by[best]]
        take[i] += k
        best = int(np.searchsorted(sums, sums[best] - lengths[i] * k))
    return take


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near to the budget as can be.

    lengths are distinct and positive. All but ROOM average documents' worth of the budget is shared out in proportion, over
    and over among the documents that still fit, so that the mix keeps to the source's lengths. An exact bounded knapsack
    over all documents that are left fills the rest, whatever its size: none of their sums is nearer to it, below or above.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    take, left = [0] * len(lengths), budget
    room = ROOM * -(-total // sum(counts))
    while left > 2 * room:
        some = [i for i in order if lengths[i] <= left - room and counts[i] > take[i]]
        free = [counts[i] - take[i] for i in some]
        if sum(lengths[i] * c for i, c in zip(some, free, strict=True)) <= left - room:
            more = free
        else:
            more = _shares([lengths[i] for i in some], free, left - room)
        for i, k in zip(some, more, strict=True):
            take[i] += k
            left -= k * lengths[i]
        if not any(more):
            break
    some = [i for i in order if counts[i] > take[i]]
    for i, k in zip(some, _subset([lengths[i] for i in some], [counts[i] - take[i] for i in some], left), strict=True):
        take[i] += k
    return take


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size")
    some = frame["size"] > 0
    frame["extra"] = 0
    frame.loc[some, "extra"] = fit_budget([int(x) for x in frame["size"][some]], [int(x) for x in frame["docs"][some]], int(round(frame["budget"].iloc[0])))
    return frame.drop(columns="budget")


def plan(rows: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """What to take of each __source and size: docs, source_size, target, rounds, and extra documents beyond the rounds."""
    lengths = checkpoint(rows.groupBy("__source", "size").agg(F.count("*").alias("docs")))
    aims = targets(lengths.groupBy("__source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), "__source", "source_size", weights, share, most)
    aims = aims.select(F.col("__source").alias("as"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long").alias("rounds"))
    counted = lengths.join(aims, lengths["__source"].eqNullSafe(aims["as"])).drop("as").withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    schema = T.StructType([f for f in counted.schema.fields if f.name != "budget"] + [T.StructField("extra", T.LongType())])
    # a group holds a source's lengths, not its documents: they grow with the root of its words at most
    return checkpoint(counted.groupBy("__source").applyInPandas(_fit, schema))


def _decided(docs: DataFrame, key: str, source: str, text: str, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """__k, __tk, __source, size, source_size, target and times, how often the mix takes it, of each row."""
    rows = docs.select(F.col(f"`{key}`").alias("__k"), text_key(F.col(f"`{text}`")).alias("__tk"), F.col(f"`{source}`").cast("string").alias("__source"), word_count(F.col(f"`{text}`")).alias("size"))
    rows = checkpoint(rows)
    return _select(rows, plan(rows, weights, share, most), seed).withColumn("times", F.col("rounds") + F.col("more"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row per document: key, source, size, source_size, target, times (how often the mix takes it), taken.

    options: weights that repeat over the sources in order, share of all sizes to hand out, most times a source's size, seed.
    Null and empty texts have size 0: they are taken as often as their source has whole rounds. Very long texts are counted
    whole. Sources without words have target 0. A null source is a source, the last one. Repeated rows are documents like any
    other; which of documents of one length are taken, the seed decides, ties by key and text, and reruns agree. An empty
    table gives an empty table. Other columns of docs may have any names; a key or source that is named like a column of the
    result is in it with _key behind its name.
    """
    own = ("size", "source_size", "target", "times", "taken")
    names = [F.col("__k").alias(apart(key, *own)), F.col("__source").alias(apart(source, *own)), "size", "source_size", "target", "times"]
    return _decided(docs, key, source, text, **options).select(*names, (F.col("size") * F.col("times")).alias("taken"))


def _select(rows: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """rows, their plan, and more: 1 for the first extra documents of each source and length in seeded order, else 0.

    The seeded hash cuts each length into slices of about SLICE documents; whole slices are taken or left, and only the
    slice in between is put in order, so that no length, however common, meets in one task.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / SLICE))).cast("int")
    p = planned.select(F.col("__source").alias("ps"), F.col("size").alias("pn"), "docs", "source_size", "target", "rounds", "extra", bits.alias("bits"))
    rows = rows.withColumn("o", F.xxhash64(F.lit(seed), F.col("__k").cast("string"), "__tk"))
    rows = rows.join(p, rows["__source"].eqNullSafe(p["ps"]) & (rows["size"] == p["pn"])).drop("ps", "pn")
    slot = F.when(F.col("bits") > 0, F.call_function("shiftrightunsigned", F.col("o"), F.lit(64) - F.col("bits"))).otherwise(F.lit(0).cast("long"))
    rows = checkpoint(rows.withColumn("slot", slot))
    part = rows.filter("extra > 0 and extra < docs")
    slots = part.groupBy("__source", "size", "slot", "extra").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("__source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = checkpoint(slots.select(F.col("__source").alias("ss"), F.col("size").alias("sn"), F.col("slot").alias("sl"), "here", (F.col("extra") - F.coalesce(before, F.lit(0))).alias("room")))
    part = part.join(slots, part["__source"].eqNullSafe(slots["ss"]) & (part["size"] == slots["sn"]) & (part["slot"] == slots["sl"]))
    place = F.row_number().over(Window.partitionBy("__source", "size", "slot").orderBy("o", "__k", "__tk"))
    whole = rows.filter("extra <= 0 or extra >= docs").withColumn("more", (F.col("extra") > 0).cast("long"))
    sure = part.filter("room <= 0 or room >= here").withColumn("more", (F.col("room") > 0).cast("long"))
    cut = part.filter("room > 0 and room < here").withColumn("more", (place <= F.col("room")).cast("long"))
    names = ["__k", "__tk", "__source", "size", "source_size", "target", "rounds", "more"]
    return whole.select(names).unionByName(sure.select(names)).unionByName(cut.select(names))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with all its columns, whatever their names.

    Nulls, empty and very long texts, ties and empty tables are as in mix(). Of repeated rows (equal key, text and source) one
    stands for all, as often as they are taken together.
    """
    rows = _decided(docs, key, source, text, **options).filter("times > 0")
    kept = checkpoint(rows.groupBy(F.col("__k").alias("__wk"), F.col("__tk").alias("__wt"), F.col("__source").alias("__ws")).agg(F.sum("times").alias("__times"), F.count("*").alias("__n")))
    named = boxed(docs, key, text).withColumn("__source", F.col("__row").getField(f"_{docs.columns.index(source)}").cast("string"))
    hit = named.join(kept, named["__k"].eqNullSafe(kept["__wk"]) & (named["__tk"] == kept["__wt"]) & named["__source"].eqNullSafe(kept["__ws"]))
    if not kept.filter("__n > 1").isEmpty():
        hit = hit.filter("__n = 1").unionByName(hit.filter("__n > 1").dropDuplicates(["__wk", "__wt", "__ws"]))
    return unboxed(hit.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))), docs)
