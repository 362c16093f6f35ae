"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters of other scripts, digits and signs that stand for letters), searched for all
entries at once by an Aho-Corasick automaton, and scored by the weight of what is found against the text's length.
Exception phrases take back the entries inside them. Entries are whole words or beginnings of words; beside a small fixed
list they and their weights are learned from labelled texts, as are exceptions.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import blocks, map_texts, prepare, worker_cache

# Common English insults, letters of other scripts that look like Latin ones, and signs used for letters.
INSULTS = ("disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless", "clown", "imbecile", "bastard")
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝкмтвнАЕОРСУХІЈЅКМТВНαεορτυχικνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdhlqwkmtbhaeopcyxijskmtbhaeoptuxikvabezhikmnoptyx",
        strict=True,
    )
)
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a"}
#: Phrases in which an entry means no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "circus clown", "clown fish", "pond scum", "soap scum")


#: Bytes of a text that are folded at a time.
BLOCK = 1 << 20
#: Least word hashes that two texts share to count as near copies in the sample.
SKETCH = 16


class _Fold(dict):
    """Translation table, filled as characters turn up: letters folded, signs read as letters, all else white space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = SIGNS.get(c) or LOOKALIKES.get(c)
        if out is None:
            out = unicodedata.normalize("NFKC", c).lower()
            out = "".join(LOOKALIKES.get(x, x) if x.isalnum() else "" if unicodedata.combining(x) or unicodedata.category(x) == "Cf" else " " for x in out)
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text: words one space apart, one space at either end."""
    return f" {' '.join(text.translate(_FOLD).split())} "


def pieces(data: bytes | None):
    """A whole text, folded, in bounded parts that end between words."""
    for block in blocks(data or b"", BLOCK):
        yield fold(block.decode("utf-8", "replace"))


@dataclass
class Lexicon:
    """entries: folded text with a leading space (and a trailing one if a whole word) to weight; exceptions: folded phrases."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for text, weight in self.entries.items():
            a.add_word(text, (len(text), weight))
            if "l" in text:  # 1 is read as i: entries with an l are also known by that reading
                a.add_word(text.replace("l", "i"), (len(text), weight))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if not len(a):
            a.add_word("\0", (1, 0.0))
        a.make_automaton()
        return a


def hits(parts: str | Iterable[str], automaton) -> tuple[int, float]:
    """Number and weight of entries found outside exception phrases, in a folded text or its parts one after the other; of
    entries that start at one place the weightiest. The automaton goes on from part to part, so phrases may span them."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    search = None
    for part in [parts] if isinstance(parts, str) else parts:
        if search is None:
            search = automaton.iter(part)
        else:
            search.set(part[1:])  # the space before it was the last part's end
        for end, (length, weight) in search:
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
    if not spared:
        return len(found), sum(found.values())
    spared.sort()
    n, total, at, reach = 0, 0.0, 0, -1
    for start in sorted(found):  # one sweep: reach is the farthest end of the phrases that begin up to here
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if start >= reach:
            n += 1
            total += found[start]
    return n, total


def measures(data: bytes | None, automaton) -> tuple[float, float]:
    """Weight found per hundred words and, damped, in all."""
    words = 0

    def counted():
        nonlocal words
        for text in pieces(data):
            words += max(0, text.count(" ") - 1)
            yield text

    weight = hits(counted(), automaton)[1]
    return math.log1p(100 * weight / max(words, 20)), math.log1p(weight)


def score_of(measured: np.ndarray, slope: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope[0] + slope[1] * measured[:, 0] + slope[2] * measured[:, 1], -30, 30)))


def beginnings(folded: str) -> set[str]:
    """Whole words and beginnings of 4 to 8 letters."""
    out: set[str] = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 24:
            out.add(f" {w} ")
        for n in range(4, min(8, len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


def sample_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn, most: int) -> DataFrame:
    """At most about most labelled rows of each label (y, body), near copies once: by the least hashes of their words."""
    named = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    counts = {r["__y"]: r["count"] for r in named.filter("__y in (0, 1)").groupBy("__y").count().collect()}
    part = F.lit(0)
    for y, n in counts.items():
        part = F.when(F.col("__y") == y, F.lit(min(1_000_000, int(1_000_000 * most / max(n, 1))))).otherwise(part)
    named = named.filter(F.abs(F.xxhash64(F.lit(5), "__id") % 1_000_000) < part)
    some = docs if learn is None else docs.filter(learn)
    # some thousand keys whatever the input's size: sent to every task, so that texts are sampled where they are read
    named = F.broadcast(named.limit(4 * most))
    rows = some.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__body")).join(named, "__id")

    def make():
        return lambda texts: [[sketch(t) for t in texts]]

    marked = map_texts(rows, F.col("__body"), ["__id", "__y", "__body"], [T.StructField("__sketch", T.StringType())], make)
    # of near copies the one with the smallest key and text stays: reruns agree
    first = F.min(F.struct("__id", "__body"))
    return marked.groupBy("__y", "__sketch").agg(first.alias("r")).select("__y", F.col("r.__body").cast("binary").alias("__body"))


def sketch(data: bytes | None) -> str:
    """The least hashes of a text's words: near copies mostly share all of them."""
    return ",".join(map(str, sorted({zlib.crc32(w) for w in set((data or b"").lower().split())})[:SKETCH]))


def _document_counts(rows: DataFrame, wanted=None) -> DataFrame:
    """(piece, n): in how many rows each beginning or word appears; wanted: a broadcast set, all if None."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found: set[str] = set()
                for text in pieces(t):
                    found |= beginnings(text)
                counts.update(found if wanted is None else found & wanted.value)
                if len(counts) > 500_000:
                    yield from emit(counts)
                    counts = Counter()
        yield from emit(counts)

    def emit(counts):
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    return rows.select("__body").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn=None, sample: int = 3000, entries: int = 2000) -> Lexicon:
    """A lexicon from the labelled documents for which learn holds.

    About sample labelled rows of each label are looked at: the bound of the sample. An entry is in at least 3 of the toxic
    ones, at least 20 times likelier there, and that not by chance; its weight is the log of that ratio. The shortest
    beginning that is as telling stands for the longer ones; words that begin so in clean texts become exceptions. Without
    toxic or clean rows the fixed list alone is the lexicon.
    """
    prepare(docs.sparkSession)
    rows = sample_of(docs, labels, key, text, label, learn, sample).persist()
    try:
        sizes = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
        bad, good = sizes.get(1, 0), sizes.get(0, 0)
        base = Lexicon({f" {fold(w).strip()} ": 3.0 for w in INSULTS}, tuple(fold(x).strip() for x in EXCEPTIONS))
        if not bad or not good:
            return base
        least = 3
        common = {r["piece"]: r["n"] for r in _document_counts(rows.filter("__y = 1")).filter(F.col("n") >= least).collect()}
        wanted = docs.sparkSession.sparkContext.broadcast(set(common))
        clean = {r["piece"]: r["n"] for r in _document_counts(rows.filter("__y = 0"), wanted).collect()}
        odds = {p: math.log(((n + 0.5) / (bad + 1)) / ((clean.get(p, 0) + 0.5) / (good + 1))) for p, n in common.items()}
        # by chance none of so many candidates would be as one-sided
        doubt = math.log(0.01 / max(1, len(common)))
        telling = {p: w for p, w in odds.items() if w >= math.log(20) and _chance(common[p], clean.get(p, 0), bad / (bad + good)) <= doubt}
        chosen: dict[str, float] = {}
        spared: set[str] = set(base.exceptions)
        for p in sorted(telling, key=lambda x: (len(x), x)):
            short = next((q for n in range(5, len(p)) if (q := p[:n]) in chosen), None)
            if short is None or common[p] > common[short]:
                chosen[p] = round(telling[p], 3)
        chosen = dict(sorted(chosen.items(), key=lambda x: (-x[1] * common[x[0]], x[0]))[:entries])
        for p, w in base.entries.items():
            if odds.get(p, 3.0) > 0:
                chosen.setdefault(p, w)
        for p, n in sorted(clean.items()):  # a whole word, common in clean texts, that a beginning among the entries would catch
            if p.endswith(" ") and p not in chosen and n >= 3 and odds[p] < 0 and any(p[:k] in chosen for k in range(2, len(p))):
                spared.add(p.strip())
        lexicon = Lexicon(chosen, tuple(sorted(spared)))
        measured = _measured(rows, lexicon).toPandas()
        lexicon.slope = _logistic(np.array(measured["m"].tolist(), float).reshape(-1, 2), measured["__y"].to_numpy(float))
        return lexicon
    finally:
        rows.unpersist()


def _chance(n: int, m: int, rate: float) -> float:
    """Log of the chance that of n + m rows drawn at the toxic ones' rate n or more are toxic (the first terms of the tail bound it)."""
    if n <= rate * (n + m):
        return 0.0
    total = n + m
    term = math.lgamma(total + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) + n * math.log(rate) + m * math.log(max(1 - rate, 1e-12))
    ratio = m / (n + 1) * rate / max(1 - rate, 1e-12)
    return term - math.log(max(1 - ratio, 1e-3))


def _measured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def make():
        a = _automaton(lexicon)
        return lambda texts: [[list(measures(t, a)) for t in texts]]

    return map_texts(rows.select("__y", F.col("__body").cast("string").alias("__t")), F.col("__t"), ["__y"], [T.StructField("m", T.ArrayType(T.DoubleType()))], make, _name(lexicon))


def _name(lexicon: Lexicon) -> str:
    return "toxicity:" + hashlib.sha256(repr((sorted(lexicon.entries.items()), lexicon.exceptions)).encode()).hexdigest()


def _automaton(lexicon: Lexicon):
    cache, name = worker_cache(), _name(lexicon)
    if name not in cache:
        cache[name] = lexicon.automaton()
    return cache[name]


def _logistic(x: np.ndarray, y: np.ndarray, reg: float = 0.02) -> tuple[float, float, float]:
    """Slopes by Newton's method, both labels of equal weight, no slope below 0: more findings never lower a score."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    z = np.column_stack([np.ones(len(x)), x])
    for use in ([0, 1, 2], [0, 1], [0, 2]):
        b, a = np.zeros(len(use)), z[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            grad = a.T @ (w * (y - p)) - reg * len(y) * np.r_[0, np.ones(len(use) - 1)] * b * 0.01
            hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.eye(len(use)) * reg * len(y) * 0.01
            step = np.linalg.solve(hess, grad)
            b += step
            if np.abs(step).max() < 1e-6:
                break
        out = np.zeros(3)
        out[use] = b
        if (out[1:] >= 0).all():
            break
    return tuple(map(float, out))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """docs' columns of keep (all by default), score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts have no findings and are scored so. Texts of any length are searched whole, in parts across whose
    borders the search goes on; the work grows in proportion to the length. Repeated rows are scored alike, an empty table
    gives an empty table. Columns with the names of the new ones are replaced.
    """

    def make():
        a = _automaton(lexicon)

        def work(texts):
            m = np.array([measures(t, a) for t in texts], float).reshape(len(texts), 2)
            s = score_of(m, lexicon.slope)
            return [s, (s >= threshold).astype(np.int32)]

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, fields, make, _name(lexicon))


def spans(text: str, lexicon: Lexicon) -> list[tuple[str, float]]:
    """Entries found in a text and their weights, for showing why it scores as it does."""
    a, out = lexicon.automaton(), []
    folded = fold(text)
    for end, (length, weight) in a.iter(folded):
        if weight is not None:
            out.append((folded[end - length + 1 : end + 1].strip(), weight))
    return out
