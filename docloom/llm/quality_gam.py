"""Quality by a generalised additive model with pairwise interactions.

Statistics of a text are cut into bins; cyclic boosting of shallow trees (two leaves for one statistic, four for a pair),
one statistic after the other in small steps, adds up to a lookup table per statistic and per pair. A text's score is the
sum of its bins' entries, so that scoring is one addition per table over whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import blocks, map_texts

NAMES = ("log_words", "word_bytes", "distinct", "repeat", "upper", "digit", "symbol", "shout", "bar", "punct", "dup_lines", "high", "longest_run")
#: Bytes of a text looked at together.
BLOCK = 1 << 22

_CLASS = np.zeros((256, 7), np.float32)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>^~=@{}[]\\_`+/", b"!?", b"|", b".,;:()'\"-", bytes(range(128, 256)))):
    _CLASS[list(_chars), _k] = 1


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES; null counts as empty."""
    data = text or b""
    if not data.strip():
        return [0.0] * len(NAMES)
    counts, words, distinct, repeats, size, run = np.zeros(256, np.int64), 0, 0.0, 0, 0, 1
    for block in blocks(data, BLOCK):
        counts += np.bincount(np.frombuffer(block, np.uint8), minlength=256)
        w = block.split()
        n = len(w)
        if not n:
            continue
        same = sum(map(bytes.__eq__, w, w[1:]))
        repeats += same
        if same:
            longest = now = 1
            for a, b in zip(w, w[1:], strict=False):
                now = now + 1 if a == b else 1
                longest = max(longest, now)
            run = max(run, longest)
        for at in range(0, n, 1000):
            distinct += len(set(w[at : at + 1000])) / min(1000, n - at) * min(1000, n - at)
        size += sum(map(len, w))
        words += n
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = (counts @ _CLASS) / max(1, size)
    return [
        np.log1p(words), size / words, distinct / words, repeats / words, *map(float, share[:6]), 1 - len(set(lines)) / max(1, len(lines)), float(share[6]), np.log1p(run - 1),
    ]


def featurise(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "stats") -> DataFrame:
    def make():
        return lambda texts: [[statistics(t) for t in texts]]

    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, [T.StructField(out, T.ArrayType(T.DoubleType(), False))], make)


@dataclass
class Model:
    """cuts: bin edges of each statistic; singles, pairs: lookup tables; base: log odds before them."""

    base: float
    cuts: list[np.ndarray]
    singles: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # two statistics, their coarse bins of bins, table

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        if not len(stats):
            return np.empty(0)
        bins = [np.searchsorted(c, stats[:, k], "right") for k, c in enumerate(self.cuts)]
        total = np.full(len(stats), self.base)
        for b, table in zip(bins, self.singles, strict=True):
            total += table[b]
        for i, j, ci, cj, table in self.pairs:
            total += table[ci[bins[i]], cj[bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(grad: np.ndarray, hess: np.ndarray, reg: float) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    left, right = g[:-1] ** 2 / (h[:-1] + reg), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + reg)
    k = int(np.argmax(left + right))
    return float((left + right)[k] - g[-1] ** 2 / (h[-1] + reg)), k + 1


def fit(stats: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, pairs: int = 6, coarse: int = 8, reg: float = 2.0) -> Model:
    """The model of rows of statistics and labels 0/1. With no rows or one label only, it gives that label's rate alone."""
    n, m = stats.shape if stats.size else (0, len(NAMES))
    rate1 = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(rate1 / (1 - rate1)))
    cuts = [np.unique(np.quantile(stats[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for k in range(m)]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    if n == 0 or y.min() == y.max():
        return model
    b = [np.searchsorted(c, stats[:, k], "right") for k, c in enumerate(cuts)]
    f = np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(m):
            size = len(cuts[k]) + 1
            if size < 2:
                continue
            g, h = slopes()
            grad, hess = np.bincount(b[k], g, size), np.bincount(b[k], h, size)
            gain, at = _best_cut(grad, hess, reg)
            if gain <= 1e-9:
                continue
            step = np.empty(size)
            step[:at] = grad[:at].sum() / (hess[:at].sum() + reg)
            step[at:] = grad[at:].sum() / (hess[at:].sum() + reg)
            model.singles[k] += rate * step
            f += rate * step[b[k]]
    fold = [np.minimum(np.arange(len(c) + 1) * coarse // max(1, len(c) + 1), coarse - 1) for c in cuts]
    g, h = slopes()
    found = []
    for i in range(m):
        for j in range(i + 1, m):
            at = fold[i][b[i]] * coarse + fold[j][b[j]]
            grad, hess = np.bincount(at, g, coarse * coarse), np.bincount(at, h, coarse * coarse)
            found.append((float((grad**2 / (hess + reg)).sum()), i, j))
    for _, i, j in sorted(found, reverse=True)[:pairs]:
        model.pairs.append((i, j, fold[i], fold[j], np.zeros((coarse, coarse))))
    for _ in range(rounds // 3):
        for i, j, ci, cj, table in model.pairs:
            g, h = slopes()
            at = ci[b[i]] * coarse + cj[b[j]]
            grad, hess = np.bincount(at, g, coarse * coarse).reshape(coarse, coarse), np.bincount(at, h, coarse * coarse).reshape(coarse, coarse)
            _, r = _best_cut(grad.sum(1), hess.sum(1), reg)
            step = np.zeros((coarse, coarse))
            for rows in (slice(0, r), slice(r, coarse)):
                gs, hs = grad[rows].sum(0), hess[rows].sum(0)
                _, c = _best_cut(gs, hs, reg)
                for cols in (slice(0, c), slice(c, coarse)):
                    step[rows, cols] = gs[cols].sum() / (hs[cols].sum() + reg)
            table += rate * step
            f += rate * step.ravel()[at]
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn=None, sample: int = 20_000, **options) -> Model:
    """A model of the labelled documents for which learn (a Column of docs, all by default) holds.

    At most about sample labelled rows are looked at, those with the smallest hash of their key: the bound of what
    reaches the driver. Rows without key or label teach nothing; repeated labels of a key count once, by the largest.
    """
    named = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    count = named.count()
    if count > sample:
        named = named.filter(F.abs(F.xxhash64(F.lit(11), "__id") % 1_000_000) < int(1_000_000 * sample / count))
    some = docs if learn is None else docs.filter(learn)
    # at most the sample's keys whatever the input's size: sent to every task, so that texts are sampled where they are read
    named = F.broadcast(named.limit(2 * sample))
    rows = some.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__body")).join(named, "__id")
    got = featurise(rows, "__body", ["__id", "__y"]).orderBy("__id").select("__y", "stats").toPandas()
    stats = np.array(got["stats"].tolist(), float).reshape(len(got), len(NAMES))
    return fit(stats, got["__y"].to_numpy(float), **options)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """docs' columns of keep (all by default), score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored by their statistics, all 0. Texts of any length count whole, in parts cut between words.
    Repeated rows are scored alike, an empty table gives an empty table. Columns named score or predicted are replaced.
    """

    def make():
        def work(texts):
            s = model.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES)))
            return [s, (s >= threshold).astype(np.int32)]

        return work

    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
