"""Model calls as pluggable functions, with deterministic defaults (Q1-Q7)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import ship

REGISTRY: dict[str, Callable] = {}


def register(name: str, function: Callable) -> None:
    """Q1: the function that stands for a model: embed, generate, judge, score or categorise."""
    REGISTRY[name] = function


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """Default embedding: signed feature hashing of words, of length 1; zeros for a text without words."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def embed(rows: DataFrame, text: str, dim: int = 64, embed_texts: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> DataFrame:
    """Q2: rows and vector, embedded in batches. A batch that fails gives null vectors, so that one doesn't fail all."""
    function = embed_texts or REGISTRY.get("embed") or (lambda texts: [hashed_embedding(t, dim) for t in texts])
    names = [c for c in rows.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            out: list = []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    out += function(part)
                except Exception:  # the model's fault, whatever it is
                    out += [None] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*names, "vector"])

    narrow = rows.select(*names)
    ship(narrow.sparkSession)
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def mapped(rows: DataFrame, text: str, extract: Callable[[str], str], tries: int = 2) -> DataFrame:
    """Q4: rows, status (ok, empty, failed) and extract of each document. Lost connections are tried again, all else fails."""
    names = [c for c in rows.columns if c not in ("status", "extract")]

    def one(t: str) -> tuple[str, str]:
        for left in range(tries, 0, -1):
            try:
                said = extract(t)
                return ("empty", "") if not said.strip() or "NO_RELEVANT_DATA" in said else ("ok", said)
            except ConnectionError as e:
                if left == 1:
                    return "failed", str(e)
            except Exception as e:
                return "failed", str(e)
        return "failed", ""

    def run(batches):
        for b in batches:
            made = [one(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], [*names, "status", "extract"])

    narrow = rows.select(*names)
    ship(narrow.sparkSession)
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, T.StructField("status", T.StringType()), T.StructField("extract", T.StringType())]))


# Kinds of question and the words that tell them, first match first.
QUERY_TYPES = (
    ("troubleshooting", r"\b(?:error|fails?|failing|not working|troubleshoot|symptom|alarm)\b"),
    ("procedure", r"\b(?:how (?:do|to|can)|procedure|steps|configure|install|upgrade)\b"),
    ("analytical", r"\b(?:average|total|sum|maximum|minimum|highest|lowest|how many|count of|per (?:month|year|grade))\b"),
    ("metadata", r"\b(?:which (?:files|documents)|list (?:files|documents)|how many (?:files|documents)|uploaded)\b"),
    ("cross_reference", r"\b(?:compare|versus|vs\.?|difference between|both)\b"),
    ("temporal", r"\b(?:latest|most recent|since|before|after|timeline)\b"),
    ("sweep", r"\b(?:all|every|each|list|summari[sz]e)\b"),
)
PROTECTED = ("analytical", "metadata")


def classify(question: Column) -> Column:
    """Q5: the kind of a question by its words; lookup if none tells."""
    out = F.lit("lookup")
    for name, pattern in reversed(QUERY_TYPES):
        out = F.when(F.lower(question).rlike(pattern), name).otherwise(out)
    return out


def overridden(questions: DataFrame, stats: DataFrame, least: int = 3, margin: float = 0.15) -> DataFrame:
    """Q5: the strategy that memory knows to be better for a question's pattern, if it has seen it often and clearly
    enough and the kind isn't protected. stats: pattern, strategy, n, margin."""
    best = stats.filter((F.col("n") >= least) & (F.col("margin") >= margin)).select("pattern", "strategy")
    met = questions.join(best, "pattern", "left")
    return met.withColumn("kind", F.when(F.col("kind").isin(*PROTECTED), F.col("kind")).otherwise(F.coalesce("strategy", "kind"))).drop("strategy")


def categorised(docs: DataFrame, categories: DataFrame, guess: str = "guess") -> DataFrame:
    """Q6: a guessed category in the spelling of the catalog, null if there is none of that name."""
    names = categories.select(F.lower("name").alias("__n"), F.col("name").alias("category"))
    return docs.withColumn("__n", F.lower(F.trim(guess))).join(names, "__n", "left").drop("__n")
