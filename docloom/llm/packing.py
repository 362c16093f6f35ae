"""Packing of documents into training windows by lexical retrieval.

A document's whole windows are sequences as they are. What is left of each document is a piece; pieces are dealt into shards,
each with a BM25 inverted index over token ids. A seed is the first piece that is unused; its unused neighbours, best first,
fill its window, the last one cut to fit, and the rest of that one is the next seed. What is left of a shard in the end is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import TEXT, _pieces, prepare, scratch, worker_cache
from docloom.llm.segments import BLANKS, LONG, ByteLevel, Segments

#: Tokens of a sequence, the id behind each document, pieces of a shard, and BM25's parameters.
WINDOW, END, SHARD, K1, B = 2048, 1, 512, 1.2, 0.75

#: Segments that are encoded as one text, and that a worker remembers of odd texts: those with white space beside a space or a
#: line feed, or at an end.
RUN, SEGMENTS = 1 << 16, 1 << 19
_BLANK = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(BLANKS))
ODD = f"(?:\\A|[ \n])(?:[{_BLANK}]|\\z)|[{_BLANK}](?:[ \n]|\\z)"
WHOLE, PIECE, FREQUENCY = 0, 1, 2


def load(spark: SparkSession, path: str, pattern: str) -> tuple[str, str]:
    """A byte-level tokenizer's JSON, read on the driver, as a vocabulary doesn't grow with the data; and the pattern whose
    matches it encodes separately."""
    with open(path, encoding="utf-8") as lines:
        return lines.read(), pattern


class Tokens:
    """Ids of whole texts as little-endian 32-bit numbers; a vocabulary's special tokens in a text are found as the library does.

    The texts of a batch are cut at single spaces and line feeds (safe cuts, see segments) in Arrow; each distinct part of a batch is
    encoded once, however often it stands there. Odd texts and long ones go by Segments.
    """

    def __init__(self, tokenizer: tuple[str, str]):
        self.tokenizer = ByteLevel(*tokenizer, special=True)
        self.size = len(self.tokenizer.bytes_of)
        self.segments = Segments(self._encode, spaced=False, most=SEGMENTS)

    def _encode(self, segments: list[str]) -> list[bytes]:
        ids, ends = self.tokenizer.each(segments)
        data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids(self, texts: pa.StringArray) -> list[bytes]:
        """texts: none is null."""
        if not len(texts):
            return []
        self.segments.trim()
        other = pc.or_(pc.match_substring_regex(texts, ODD), pc.greater(pc.binary_length(texts), LONG))
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(other, "", texts), "\n", " \n"), " ")
        starts, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        names, places = coded.dictionary, np.array(coded.indices)
        bare = pc.or_(pc.equal(names, ""), pc.starts_with(names, "\n"))
        segments = pc.if_else(bare, names, pc.binary_join_element_wise("", names, " "))
        first = parts.values.take(pa.array(starts[:-1]))  # no space before these
        alone = pa.array([array("I", self.tokenizer.ids(x)).tobytes() for x in first.to_pylist()], pa.binary())
        places[starts[:-1]] = np.arange(len(names), len(names) + len(first))
        values = pa.concat_arrays([*self._joined(segments), alone]).take(pa.array(places))
        data, ends = (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(values.buffers()[1], np.int32)[starts].tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for k, found in zip(np.flatnonzero(other).tolist(), self.segments.look(texts.filter(other).to_pylist()), strict=True):
            out[k] = b"".join(map(self.segments.values.__getitem__, found))
        return out

    def _joined(self, segments: pa.StringArray) -> Iterator[pa.BinaryArray]:
        """Ids of segments that can stand behind each other, a run of them as one text."""
        for at in range(0, len(segments), RUN):
            run = segments.slice(at, RUN)
            ids = np.array(self.tokenizer.ids("".join(run.to_numpy(zero_copy_only=False))), "<u4")
            ends = np.searchsorted(np.cumsum(self.tokenizer.sizes[ids]), np.cumsum(pc.binary_length(run)), side="right")
            yield pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(ids)])


class Index:
    """BM25 inverted index of a shard. idf: by token id, corpus-wide; ids in more than half of the documents weigh nothing."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, average: float):
        n = self.n = len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        key, tf = np.unique(np.concatenate(pieces).astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
        told = idf[key // n] > 0
        key, tf = key[told], tf[told]
        term, self.owner = key // n, key % n
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.owner] / average))
        self.first = np.concatenate([np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.array([], np.int64), [len(term)]])
        slot = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        by = np.argsort(self.owner, kind="stable")
        self.terms, self.at = slot[by], np.searchsorted(self.owner[by], np.arange(n + 1))

    def scores(self, piece: int) -> np.ndarray:
        """Of all pieces for the terms of one."""
        slots = self.terms[self.at[piece] : self.at[piece + 1]]
        start, n = self.first[slots], self.first[slots + 1] - self.first[slots]
        ends = np.cumsum(n)
        if not len(ends):
            return np.zeros(self.n)
        postings = np.arange(ends[-1]) + np.repeat(start - ends + n, n)
        return np.bincount(self.owner[postings], self.weight[postings], self.n)


def fill(pieces: list[np.ndarray], idf: np.ndarray, average: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset): a shard's pieces, each shorter than a window, in windows. Ties in the
    ranking go to the earlier piece."""
    index = Index(pieces, idf, average)
    used, out, sequence, unused = np.zeros(len(pieces), bool), [], 0, 0
    seed, start = (0, 0) if pieces else (None, 0)
    while seed is not None:
        used[seed] = True
        made, full, rest = [(seed, start, len(pieces[seed]) - start)], len(pieces[seed]) - start, None
        if full < window:
            scores = index.scores(seed)
            scores[used] = -1
            for q in np.argsort(-scores, kind="stable")[: len(pieces) - int(used.sum())].tolist():
                take = min(window - full, len(pieces[q]))
                made.append((q, 0, take))
                used[q], full = True, full + take
                if full == window:
                    rest = (q, take) if take < len(pieces[q]) else None
                    break
        while unused < len(pieces) and used[unused]:
            unused += 1
        seed, start = rest or ((unused, 0) if unused < len(pieces) else (None, 0))
        for run in [made] if full == window else _powers(made, full):
            at = 0
            for piece, begin, n in run:
                out.append((piece, begin, n, sequence, at))
                at += n
            sequence += 1
    return out


def _powers(made: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """The same run of parts, cut into runs whose lengths are the powers of two that make up the total, the largest first."""
    parts = iter(made)
    piece, begin, n = next(parts)
    for k in reversed(range(total.bit_length())):
        run, room = [], total & 1 << k
        while room:
            take = min(room, n)
            run.append((piece, begin, take))
            begin, n, room = begin + take, n - take, room - take
            if not n:
                piece, begin, n = next(parts, (0, 0, 0))
        if run:
            yield run


def _strings(texts: pa.BinaryArray) -> pa.StringArray:
    """Texts from their bytes: null is empty, and bytes that aren't UTF-8 are U+FFFD."""
    try:
        return texts.fill_null(b"").cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([(x or b"").decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


def pieces(docs: DataFrame, tokenizer: tuple[str, str], text: str, keep: list[str], window: int, end: int) -> DataFrame:
    """A table in the shared folder. kind WHOLE: a document's whole windows, with their sequence; PIECE: what is left of it, with
    its rarest id by the vocabulary's order (later merges are rarer) as sign; FREQUENCY: how many documents (n) of a task have
    an id (sign), and its number of documents as sign -1."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(tokenizer)
    name = "tokens:" + hashlib.sha256("".join(tokenizer).encode()).hexdigest()
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").cast("binary").alias(TEXT))
    own_names = [("__row", T.LongType()), ("sign", T.IntegerType()), ("n", T.LongType()), ("doc_tokens", T.LongType()), ("start", T.LongType()), ("ids", T.BinaryType()), ("sequence_id", T.LongType()), ("kind", T.IntegerType())]
    schema = T.StructType([*[T.StructField(c, narrow.schema[c].dataType, True) for c in keep], *[T.StructField(c, t) for c, t in own_names]])
    n_kept, mark = len(keep), array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        whole = to_arrow_schema(schema)
        cache = worker_cache()
        for other in set(cache) - {name}:
            del cache[other]
        if name not in cache:
            cache[name] = Tokens(shared.value)
        tokens = cache[name]
        frequency, n_docs, row = np.zeros(tokens.size, np.int32), 0, TaskContext.get().partitionId() << 32

        def table(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in whole], schema=whole)

        for big in batches:
            for batch in _pieces(big):
                owner, own = [], {c: [] for c, _ in own_names}
                for k, ids in enumerate(tokens.ids(_strings(batch.column(n_kept)))):
                    ids += mark
                    size, every = len(ids) // 4, np.frombuffer(ids, "<u4")
                    frequency[every] += 1  # once for an id, however often it is in every
                    n_docs += 1
                    for at in range(0, size, window):
                        whole_window = size - at >= window
                        owner.append(k)
                        values = (row, None if whole_window else int(every[at:].max()), None, size, at, ids[4 * at : 4 * (at + window)], 2 * row + 1 if whole_window else None, WHOLE if whole_window else PIECE)
                        for (c, _), v in zip(own_names, values, strict=True):
                            own[c].append(v)
                        row += 1
                at = pa.array(owner, pa.int64())
                yield table({c: batch.column(i).take(at) for i, c in enumerate(keep)} | own, len(owner))
        terms = np.flatnonzero(frequency)
        yield table({"sign": pa.array(np.append(terms, -1), pa.int32()), "n": pa.array(np.append(frequency[terms], n_docs).astype(np.int64)), "kind": [FREQUENCY] * (len(terms) + 1)}, len(terms) + 1)

    path = scratch(spark, "packing")
    narrow.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pack(docs: DataFrame, tokenizer: tuple[str, str], text: str = "text", keep: list[str] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece of a document: docs' columns of keep (all by default), start (its document's ids before it), length,
    ids (little-endian 32-bit numbers), doc_tokens, sequence_id and offset there. Each document ends with the id end.

    Null and empty texts have that id alone. Texts of any length are encoded and packed whole, repeated rows are documents of
    their own, an empty table gives an empty table; columns with the names of the new ones are replaced. Only what is left
    behind whole windows moves, less than a window of each document, so no row is large. Shards have about SHARD pieces: those
    of one rare id go to one shard, or are dealt over several by their rows if there are more. How many pieces an id has and
    how many documents have it is known for each id of the vocabulary, which is the bound of these tables.
    """
    spark = docs.sparkSession
    taken = {"__row", "sign", "n", "doc_tokens", "start", "ids", "sequence_id", "kind", "length", "offset", "shard"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    everything = pieces(docs, tokenizer, text, keep, window, end)
    loose = everything.filter(F.col("kind") == PIECE)
    frequency = {r.sign: r.n for r in everything.filter(F.col("kind") == FREQUENCY).groupBy("sign").agg(F.sum("n").alias("n")).collect()}  # a row for an id
    n_docs = frequency.pop(-1, 0)
    idf = np.zeros(1 + max(frequency, default=0))
    for term, n in frequency.items():
        idf[term] = max(0.0, np.log((n_docs - n + 0.5) / (n + 0.5)))
    average = loose.agg(F.avg(F.col("doc_tokens") - F.col("start"))).first()[0] or 1.0

    starts, at = [], 0
    for r in sorted(loose.groupBy("sign").count().collect()):  # a row for an id
        starts.append((r[0], at, r[1]))
        at += r[1]
    places = spark.createDataFrame(starts, "__sign int, __first long, __n long")
    share = F.pmod(F.xxhash64("__row"), F.lit(1 << 30)) / float(1 << 30)
    dealt = loose.join(F.broadcast(places), F.col("sign") == F.col("__sign")).withColumn("shard", F.floor((F.col("__first") + share * F.col("__n")) / SHARD))
    out = T.StructType([*[loose.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in ("start", "length")], T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]])
    shared = spark.sparkContext.broadcast(idf)

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("__row").combine_chunks()
        ids = [np.frombuffer(x.as_buffer(), "<u4") for x in group.column("ids").combine_chunks()]
        piece, begin, length, sequence, offset = np.array(fill(ids, shared.value, average, window), np.int64).reshape(-1, 5).T
        which = pa.array(piece)
        kept = [group.column(c).take(which).combine_chunks() for c in keep]
        parts = pa.array([ids[p][b : b + n].tobytes() for p, b, n in zip(piece, begin, length, strict=True)], pa.binary())
        first, whole = (group.column(c).to_numpy()[piece] for c in ("start", "doc_tokens"))
        number = 2 * ((group.column("shard")[0].as_py() << 32) + sequence)
        return pa.table([*kept, pa.array(first + begin), pa.array(length), parts, pa.array(whole), pa.array(number), pa.array(offset)], names=out.names)

    packed = dealt.select(*[F.col(f"`{c}`") for c in keep], "__row", "shard", "start", "doc_tokens", "ids").groupBy("shard").applyInArrow(shard, out)
    whole = everything.filter(F.col("kind") == WHOLE).select(*[F.col(f"`{c}`") for c in keep], "start", F.lit(window).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
