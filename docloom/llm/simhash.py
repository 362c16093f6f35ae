"""Near-duplicates by SimHash, linked through anchor points of a covering code.

Exact for every pair: fingerprints are cut into bands with thresholds t_i whose t_i + 1 add up to threshold + 1, so that
two fingerprints within the threshold are within t_i in some band. In a band the anchors are the words of a Hamming code
beside free bits (covering radius 1; radius 0, every word an anchor, where t_i is 0). A fingerprint is at home at the anchor
that is nearest, and is copied to every anchor within radius + t_i; whoever is within t_i of it meets it at its home.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import checkpoint, keep_rows, map_texts, prepare, text_key
from docloom.llm.components import connected_components

#: Words of a text that are shingled at a time.
BLOCK = 1 << 16
#: Pairs compared at a time, fingerprints of an anchor, at home or guests, in one task (an anchor with more is split), and
#: split anchors that are sent to every task; with more they are joined by key.
PAIRS, HOMES, SENT = 1 << 22, 1 << 16, 10_000
#: Up to so many distinct fingerprints three bands suffice; beyond, the two wider bands compare fewer pairs.
MANY = 1 << 28


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of the text's word shingles, hashed by XXH64 with seed 42: a bit is 1 if set in over half of the hashes.

    A-Z are lower-cased, words end at ASCII white space, repeated shingles count; fewer words than width make one shingle,
    none (empty or null text) give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        count = min(BLOCK, n - start)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, count)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """docs' columns of keep (all by default) and fp, the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, [T.StructField("fp", T.LongType())], make)


@dataclass(frozen=True)
class Band:
    """n bits from shift on; the lowest 2^r - 1 of them carry a Hamming code (none if r is 0), the others are free."""

    shift: int
    n: int
    r: int
    t: int

    def value(self, fp: Column) -> Column:
        return F.shiftrightunsigned(fp, self.shift).bitwiseAND(F.lit((1 << self.n) - 1))

    def syndrome(self, value: Column) -> Column:
        """Parity checks of the coded bits: 0 for a word of the code, else the place (from 1) of the bit to turn."""
        out = F.lit(0)
        for j in range(self.r):
            mask = sum(1 << (p - 1) for p in range(1, 1 << self.r) if p >> j & 1)
            out = out + F.bit_count(value.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << j)
        return out

    def home(self, value: Column) -> Column:
        if not self.r:
            return value
        s = self.syndrome(value)
        return F.when(s == 0, value).otherwise(value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), s - 1)))

    @cached_property
    def turns(self) -> list[list[int]]:
        """By syndrome: the bits to turn to reach each anchor within radius + t."""
        reach = (1 if self.r else 0) + self.t
        out: list[list[int]] = [[] for _ in range(1 << self.r)]
        coded = (1 << self.r) - 1
        for weight in range(reach + 1):
            for places in combinations(range(self.n), weight):
                s = 0
                for p in places:
                    s ^= p + 1 if p < coded else 0
                out[s].append(sum(1 << p for p in places))
        return out

    def anchors(self, value: Column) -> Column:
        """Array of all anchors within radius + t."""
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in self.turns])
        return F.transform(F.get(table, self.syndrome(value).cast("int")), lambda x: value.bitwiseXOR(x))


def bands(threshold: int, many: bool) -> list[Band]:
    """A plan for any threshold from 0 to 14; for 4, one for many fingerprints and one for fewer."""
    if not 0 <= threshold <= 14:
        raise ValueError("threshold must be from 0 to 14")
    if threshold == 4:
        return [Band(0, 32, 5, 2), Band(32, 32, 5, 1)] if many else [Band(0, 21, 4, 1), Band(21, 21, 4, 1), Band(42, 22, 0, 0)]
    if threshold < 4:
        wants = [0] * (threshold + 1)
    else:
        wants = [1] * ((threshold + 1) // 2) + [0] * ((threshold + 1) % 2)
    cuts = [64 * k // len(wants) for k in range(len(wants) + 1)]
    return [Band(lo, min(hi - lo, 62), 3 if t and hi - lo >= 7 else 0, t) for lo, hi, t in zip(cuts, cuts[1:], wants, strict=False)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links a-b, at most one per node: node and least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _compare(home: np.ndarray, seen: np.ndarray, homes: np.ndarray, guests: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among cells: cell k has homes[k] entries of home and guests[k] of seen, in order."""
    h0, g0 = np.cumsum(homes) - homes, np.cumsum(guests) - guests
    per_home = np.repeat(guests, homes)  # guests each home fingerprint meets
    first = np.repeat(g0, homes)
    owner = np.arange(int(h0[0]) if len(h0) else 0, len(home))
    done = 0
    total = np.cumsum(per_home)
    while done < len(owner):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
        n = per_home[done:stop]
        if stop == done + 1 and n[0] > PAIRS:  # one home, very many guests
            g = seen[first[done] : first[done] + n[0]]
            near = (np.bitwise_count(g ^ home[done]) <= threshold) & (g != home[done])
            yield np.full(int(near.sum()), home[done]), g[near]
        else:
            i = np.repeat(np.arange(done, stop), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[done:stop], n)
            x, y = home[i], seen[j]
            near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
            yield x[near], y[near]
        done = stop


def _meet(threshold: int):
    """From rows (cell..., home, fp), sorted so, to links: a forest of each part of the comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell: tuple | None = None  # cell that the last batch ended in, and its home fingerprints
        kept = np.empty(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            band, anchor, salt, guest, fp = (np.asarray(batch.column(k)) for k in range(5))
            fp = fp.astype(np.int64).view(np.uint64)
            new = np.flatnonzero((np.diff(band) != 0) | (np.diff(anchor) != 0) | (np.diff(salt) != 0)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            cell = (band[0], anchor[0], salt[0])
            is_home = guest == 0
            homes = np.add.reduceat(is_home, starts, dtype=np.int64)
            guests = ends - starts - homes
            home, seen = fp[is_home], fp[~is_home]
            if kept_cell == cell and len(kept):
                home = np.concatenate([kept, home])
                homes[0] += len(kept)
            for a, b in _compare(home, seen, homes, guests, threshold):
                if len(a):
                    a, b = _forest(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            kept_cell, kept = (band[-1], anchor[-1], salt[-1]), home[len(home) - homes[-1] :].copy()

    return run


def links(fps: DataFrame, threshold: int = 4, plan: list[Band] | None = None, most: int = HOMES) -> DataFrame:
    """Links (a, b) that connect exactly what pairs within the threshold connect; not all such pairs.

    fps: distinct fingerprints in a column fp, checkpointed or cheap to read twice.
    """
    prepare(fps.sparkSession)
    plan = plan or bands(threshold, fps.count() > MANY)
    homes, guests, values = [], [], []
    for k, band in enumerate(plan):
        base = fps.select(F.lit(k).alias("band"), band.value(F.col("fp")).alias("v"), "fp")
        homes.append(base.select("band", band.home(F.col("v")).alias("anchor"), F.lit(0).alias("guest"), "fp"))
        guests.append(base.select("band", _seen(band).alias("anchor"), F.lit(1).alias("guest"), "fp"))
        values.append(base.groupBy("band", "v").count())
    rows = reduce(DataFrame.unionByName, homes + guests)
    hot = _hot(plan, values, most)
    n = hot.count()
    if not n:
        rows = rows.withColumn("salt", F.lit(0))
    else:  # the homes of a full anchor are dealt out into rows, its guests into columns, and each part meets each
        rows = rows.join(F.broadcast(hot) if n <= SENT else hot, ["band", "anchor"], "left")
        wide, high = F.coalesce("wide", F.lit(1)), F.coalesce("high", F.lit(1))
        own = F.xxhash64("fp")
        to_home = F.transform(F.sequence(F.lit(0), wide - 1), lambda j: F.pmod(own, high).cast("int") * wide + j)
        to_guest = F.transform(F.sequence(F.lit(0), high - 1), lambda i: i * wide + F.pmod(own, wide).cast("int"))
        rows = rows.withColumn("salt", F.explode(F.when(F.col("guest") == 0, to_home).otherwise(to_guest)))
    rows = rows.select("band", "anchor", "salt", "guest", "fp").repartition("band", "anchor", "salt").sortWithinPartitions("band", "anchor", "salt", "guest")
    return rows.mapInArrow(_meet(threshold), "a long, b long")


def _seen(band: Band) -> Column:
    return F.explode(band.anchors(F.col("v"))) if band.r or band.t else F.col("v")


def _hot(plan: list[Band], values: list[DataFrame], most: int) -> DataFrame:
    """band, anchor, high, wide: the parts into which homes and guests of anchors with over most of either are dealt.

    Counted by the values of a band, not by its rows. Values so rare that all that can reach an anchor add less than most
    together aren't spread over their anchors.
    """
    at_home, seen = [], []
    for band, counts in zip(plan, values, strict=True):
        counts = checkpoint(counts.filter(F.col("count") * sum(map(len, band.turns)) >= most)) if band.r or band.t else counts
        at_home.append(counts.select("band", band.home(F.col("v")).alias("anchor"), "count", F.lit(0).cast("long").alias("guests")))
        seen.append(counts.select("band", _seen(band).alias("anchor"), F.lit(0).cast("long").alias("count"), F.col("count").alias("guests")))
    size = reduce(DataFrame.unionByName, at_home + seen).groupBy("band", "anchor").agg(F.sum("count").alias("h"), F.sum("guests").alias("g")).filter((F.col("h") > most) | (F.col("g") > most))
    ways = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int")
    return checkpoint(size.select("band", "anchor", ways("h").alias("high"), ways("g").alias("wide")))


def _grouped(docs: DataFrame, key: str, text: str, threshold: int, width: int) -> DataFrame:
    """__k, __tk, fp, __root (the component's least fingerprint) and component_id of each row."""
    named = docs.select(F.col(f"`{key}`").alias("__k"), text_key(F.col(f"`{text}`")).alias("__tk"), F.col(f"`{text}`").alias("__body"))
    rows = checkpoint(fingerprints(named, "__body", ["__k", "__tk"], width))
    least = checkpoint(rows.groupBy("fp").agg(F.min("__k").alias("least")))
    roots = checkpoint(connected_components(links(least.select("fp"), threshold)))
    linked = least.join(roots, least["fp"] == roots["node"])
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # met over other forms of the keys: both sides are shuffled for these joins, so that Spark can split common ones
    reached = linked.select("fp", F.bitwise_not("root").alias("__r")).join(ids.withColumn("__r", F.bitwise_not("root")), "__r").select("fp", "root", "component_id")
    label = least.join(reached, "fp", "left").select("fp", F.coalesce("root", "fp").alias("__root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    rows, label = rows.withColumn("__f", F.bitwise_not("fp")), label.select(F.bitwise_not("fp").alias("__f"), "__root", "component_id")
    return rows.join(label, "__f").select("__k", "__tk", "fp", "__root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 4, width: int = 4) -> DataFrame:
    """One row per document: key, fp, component_id: the least key reachable over links, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other; very long ones are shingled whole, in parts. Null
    keys get a component but are never its id, unless all its keys are null. Repeated rows give repeated rows. An empty table
    gives an empty table. Other columns of docs may have any names.
    """
    return _grouped(docs, key, text, threshold, width).select(F.col("__k").alias(key), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 4, width: int = 4) -> DataFrame:
    """docs with one row of each component, with all its columns: the one with the least key (null keys last), of equal keys the
    least text key; of repeated rows one. Nulls, empty and very long texts and empty tables are as in near_duplicates()."""
    rows = _grouped(docs, key, text, threshold, width)
    rows = rows.groupBy("__k", "__tk", "__root").agg(F.count("*").alias("n"))
    order = F.struct(F.col("__k").isNull().alias("x"), F.col("__k").alias("k"), F.col("__tk").alias("t"), F.col("n").alias("n"))
    best = rows.groupBy("__root").agg(F.min(order).alias("b"))
    return keep_rows(docs, checkpoint(best.select(F.col("b.k").alias("__k"), F.col("b.t").alias("__tk"), F.col("b.n").alias("n"))), key, text)
