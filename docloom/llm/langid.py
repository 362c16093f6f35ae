"""Language by hierarchical discrimination: the family first, then the language within it.

Texts are vectors of hashed character n-grams. A linear support vector machine per family (one against the rest) picks the
family, one-versus-one linear support vector machines vote within it.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import blocks, map_texts, prepare

# Families of closely related languages by ISO 639-1 code. A language of none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sr", "hr", "sl", "mk"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "ne"),
}
UNKNOWN = "und"
#: Hashed dimensions, and bytes of a text that are looked at together.
DIM, BLOCK = 1 << 13, 1 << 20


def features(text: bytes | None, dim: int = DIM) -> np.ndarray | None:
    """Unit vector of root counts of hashed 1- to 4-grams of letters, words apart by one space; None without a letter.

    The whole text counts, in parts of bounded size.
    """
    total, letters, tail = np.zeros(dim, np.float64), False, np.array([32], np.uint64)  # the text is between two spaces

    def count(codes: np.ndarray, tail: np.ndarray) -> None:
        """Add the n-grams that end in codes; tail is what stands before."""
        gram = whole = np.concatenate([tail, codes])
        for n in range(1, 5):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x100000001B3) + whole[n - 1 :]
            mixed = gram[max(0, len(tail) - n + 1) :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            total[:] += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % dim, minlength=dim)

    count(tail, tail[:0])
    for block in blocks(text or b"", BLOCK):
        codes = np.frombuffer(block.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        keep = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
        if (high := codes >= 0xC0).any():  # signs and digits of other scripts aren't letters
            odd = np.unique(codes[high])
            bad = odd[[not chr(int(c)).isalpha() for c in odd]]
            if bad.size:
                keep &= ~np.isin(codes, bad)
        keep |= (codes == 0xAA) | (codes == 0xB5) | (codes == 0xBA)
        letters |= bool(keep.any())
        codes = np.where(keep, codes, np.uint64(32))
        before = np.concatenate([tail[-1:], codes[:-1]])
        codes = codes[(codes != 32) | (before != 32)]  # runs of other characters: one space
        if len(codes):
            count(codes, tail)
            tail = np.concatenate([tail, codes])[-3:]
    if not letters:
        return None
    if tail[-1] != 32:
        count(np.array([32], np.uint64), tail)
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


@dataclass
class Sparse:
    """Rows of features by their entries that aren't 0: places and values of row i are those from start[i] to start[i + 1]."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        start = np.cumsum([0, *(len(at) for at, _ in rows)])
        return Sparse(start, np.concatenate([np.empty(0, np.int32), *(at for at, _ in rows)]), np.concatenate([np.empty(0, np.float32), *(v for _, v in rows)]))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.start[i], self.start[i + 1])
        return self.at[s], self.value[s]

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.value * w[self.at], dtype=np.float64)])
        return sums[self.start[1:]] - sums[self.start[:-1]]


def linear_svm(x: Sparse, rows: np.ndarray, y: np.ndarray, dim: int = DIM, reg: float = 1e-4, passes: int = 12, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and scale (of the margin, for probabilities) of a linear SVM on some rows of x and their labels -1/1:
    squared hinge loss, dual coordinate descent. Labels weigh the same in sum. The last place of the weights is the bias."""
    n = len(rows)
    w, alpha = np.zeros(dim + 1), np.zeros(n)
    c = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) / (reg * n) / 1000
    some = [x.row(i) for i in rows]
    q = np.array([float(v @ v) for _, v in some]) + 1 + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(n):
            at, v = some[i]
            g = y[i] * (v @ w[at] + w[dim]) - 1 + alpha[i] * 0.5 / c[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[dim] += step
                alpha[i] = new
    margin = x.dot(w)[rows] + w[dim]
    scale = 1.0
    for _ in range(30):  # one-parameter logistic calibration
        p = 1 / (1 + np.exp(-np.clip(scale * margin * y, -30, 30)))
        grad, hess = ((1 - p) * margin * y).mean() - 1e-3 * scale, (p * (1 - p) * margin**2).mean() + 1e-3
        scale = min(20.0, max(0.1, scale + grad / hess))
    return w[:-1].astype(np.float32), float(w[-1]), float(scale)


@dataclass
class Model:
    families: dict[str, tuple[str, ...]]  # learned languages by family
    family: dict[str, tuple[np.ndarray, float, float]]  # one against the rest; empty if there is one family
    pair: dict[tuple[str, str], tuple[np.ndarray, float, float]]
    dim: int = DIM

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        n = len(x)
        names = sorted(self.families)
        if not names or not n:
            return [UNKNOWN] * n, np.zeros(n)
        p = np.ones((n, len(names)))
        if len(names) > 1:
            for k, name in enumerate(names):
                w, b, s = self.family[name]
                p[:, k] = 1 / (1 + np.exp(-np.clip(s * (x @ w + b), -30, 30)))
            p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        out, score = [""] * n, p[np.arange(n), best]
        for k, name in enumerate(names):
            at, langs = np.flatnonzero(best == k), self.families[name]
            wins, belief = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
            for i, j in combinations(range(len(langs)), 2):
                w, b, s = self.pair[langs[i], langs[j]]
                first = 1 / (1 + np.exp(-np.clip(s * (x[at] @ w + b), -30, 30)))
                belief[:, i] += first
                belief[:, j] += 1 - first
                wins[:, i] += first >= 0.5
                wins[:, j] += first < 0.5
            chosen = (wins + belief / (len(langs) + 1)).argmax(1)  # beliefs break ties of votes
            for r, row in enumerate(at):
                out[row] = langs[chosen[r]]
                if len(langs) > 1:
                    score[row] *= belief[r, chosen[r]] / (len(langs) - 1)
        return out, np.clip(score, 0.0, 1.0)


def fit(x: Sparse, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, dim: int = DIM) -> Model:
    """The model of rows of features and their languages."""
    y = np.array(langs, dtype=object)
    of = {code: name for name, codes in families.items() for code in codes}
    groups: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        groups.setdefault(of.get(code, code), []).append(code)
    model = Model({k: tuple(v) for k, v in groups.items()}, {}, {}, dim)
    if len(groups) > 1:
        for name, codes in groups.items():
            model.family[name] = linear_svm(x, np.arange(len(y)), np.where(np.isin(y, codes), 1, -1), dim)
    for codes in groups.values():
        for a, b in combinations(codes, 2):
            rows = np.flatnonzero((y == a) | (y == b))
            model.pair[a, b] = linear_svm(x, rows, np.where(y[rows] == a, 1, -1), dim)
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn=None, sample: int = 600, rows: int = 12_000, families: dict[str, tuple[str, ...]] = FAMILIES, dim: int = DIM) -> Model:
    """A model of the documents with a language for which learn holds.

    About sample documents of each language are looked at, fewer where there are so many languages that all would be over
    rows together, and one of each at least: these are the bounds of what reaches the driver. They are those with the smallest
    hash of their key, so that reruns agree. Rows without key, language or a letter teach nothing; of an empty table, or one
    without such rows, a model is learned that knows no language.
    """
    prepare(docs.sparkSession)
    some = docs if learn is None else docs.filter(learn)
    some = some.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{lang}`").cast("string").alias("y"), F.col(f"`{text}`").alias("__body"))
    some = some.filter(F.col("y").isNotNull() & (F.col("y") != UNKNOWN) & F.col("__id").isNotNull()).withColumn("__h", F.abs(F.xxhash64(F.lit(23), "__id") % 1_000_000))
    lettered = F.coalesce(F.col("__body").cast("string"), F.lit("")).rlike(r"\p{L}")
    counts = some.groupBy("y").agg(F.count("*").alias("n"), F.min(F.when(lettered, F.col("__h"))).alias("least")).collect()  # a row a language
    most = min(sample, max(1, rows // max(1, len(counts))))
    share = {r["y"]: max(min(1_000_000, 1_000_000 * most // r["n"]), (r["least"] if r["least"] is not None else -1) + 1) for r in counts}
    if not share:
        return fit(Sparse.of([]), [], families, dim)
    parts = docs.sparkSession.createDataFrame(sorted(share.items()), "y string, part long")
    chosen = some.join(F.broadcast(parts), "y").filter("__h < part")

    def make():
        def work(texts):
            found = [features(t, dim) for t in texts]
            return [[None if v is None else np.flatnonzero(v).astype("<i4").tobytes() for v in found], [None if v is None else v[v != 0].tobytes() for v in found]]

        return work

    got = map_texts(chosen, F.col("__body"), ["__id", "y"], [T.StructField("at", T.BinaryType()), T.StructField("v", T.BinaryType())], make).filter("at is not null").orderBy("__id", "y", "at", "v").toPandas()
    x = Sparse.of([(np.frombuffer(at, "<i4"), np.frombuffer(v, np.float32)) for at, v in zip(got["at"], got["v"], strict=True)])
    return fit(x, list(got["y"]), families, dim)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns of keep (all by default), lang_pred and score (0 to 1).

    lang_pred is und with score 0 for null texts and texts without a letter. Texts of any length count whole, in parts cut
    between words. Repeated rows are judged alike, an empty table gives an empty table. Of languages with equal votes and
    beliefs the first in order wins. Columns with these names are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for start in range(0, len(texts), 256):
                found = [(start + k, v) for k, t in enumerate(texts[start : start + 256]) if (v := features(t, shared.value.dim)) is not None]
                if found:
                    lang, score = shared.value.predict(np.stack([v for _, v in found]))
                    for (k, _), one, s in zip(found, lang, score, strict=True):
                        names[k], scores[k] = one, s
            return [pa.array(names, pa.string()), scores]

        return work

    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
