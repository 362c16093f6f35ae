"""Alignment of two tokenizers over a corpus: which ids of one share their bytes with which ids of the other, and how often.

Byte offsets at which tokens of both sides end cut a text into groups; every token of side A is linked with every token of
side B in its group. How many documents link a pair is counted over the corpus by a cogroup of postings: the documents of
each pair, with how often each holds it, are packed by blocks of documents, shuffled by ids, sorted, and met with the pairs'
counts, a sorted stream each, which spill; what comes of it is added up by document.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm._common import TEXT, _pieces, prepare, scratch, worker_cache
from docloom.llm.segments import ByteLevel, Segments

#: Segments of the documents in a block, at most, but for its last batch; and postings of an id that meet in one stream.
BLOCK, STREAM = 1 << 20, 1 << 24
#: Bytes of text that are cut up at a time.
PART = 4 << 20
#: Segments that a worker remembers.
SEGMENTS = 3 << 16
#: Links of a group above which its ids are counted first.
WIDE = 256
#: Times that a block uses a segment that is remembered longer.
OFTEN = 2

DOC = [("block", T.LongType()), ("doc", T.IntegerType())]
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
POSTING = [("a", T.IntegerType()), ("b", T.IntegerType()), ("n", T.IntegerType()), ("docs", T.ArrayType(T.IntegerType(), False))]
#: An entry of docs is a document's number in its block, of so many bits, and above it how often it holds the pair; what is more
#: than that has further entries.
DOC_BITS, TIMES = 20, (1 << 11) - 1


def load(spark: SparkSession, byte_level: str, pieces: str, pattern: str) -> tuple[str, bytes, str]:
    """Contents of a byte-level tokenizer (JSON) and of a piece model, read on the driver, as vocabularies don't grow with the
    data; and the pattern whose matches the first encodes separately."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return a.read(), b.read(), pattern


class Aligner:
    """Groups and links of segments. Side A takes a segment with its space, side B adds the space itself.

    A segment's value is its groups as text and its links as 64-bit numbers, by turns a pair's ids and how often it is linked (a
    pair may come again). figures has a row for each: numbers of A ids, B ids, groups and links, -1 if the bytes of a side aren't
    the segment's.
    """

    def __init__(self, vocabularies: tuple[str, bytes, str]):
        import sentencepiece

        self.a = ByteLevel(vocabularies[0], vocabularies[2], special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies[1])
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁") or "\n" in piece:
                raise ValueError("a piece goes on behind a space or over a line feed: texts can't be cut there")
            self.b_bytes.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.segments = Segments(self.encode, spaced=True, most=SEGMENTS)
        self.figures, self.more = np.zeros((0, 4), np.int64), []

    def trim(self, often: set[int]) -> None:
        self.settle()
        kept = self.segments.trim(often)
        if kept is not None:
            self.figures = self.figures[kept]

    def settle(self) -> None:
        if self.more:
            self.figures, self.more = np.concatenate([self.figures, *self.more]), []

    def encode(self, segments: list[str]) -> list[tuple[str, bytes]]:
        """Values of segments; their figures go to more."""
        data = [s.encode() for s in segments]
        a, _ = self.a.each(segments)
        b = [x if s[0] == " " else x[1:] for s, x in zip(segments, self.b.encode([s.removeprefix(" ") for s in segments], num_threads=1), strict=True)]
        sides = (self.a.bytes_of, a.tolist()), (self.b_bytes, list(chain.from_iterable(b)))
        if all(b"".join(map(of.__getitem__, ids)) == b"".join(data) for of, ids in sides):
            return self._aligned(list(map(len, data)), a, np.array(sides[1][1], np.int64))
        if len(segments) == 1:
            self.more.append(np.full((1, 4), -1, np.int64))
            return [("", b"")]
        half = len(segments) // 2  # some segment isn't what its tokens say: find it
        return self.encode(segments[:half]) + self.encode(segments[half:])

    def _aligned(self, sizes: list[int], a: np.ndarray, b: np.ndarray) -> list[tuple[str, bytes]]:
        """From the ids of segments of these sizes in bytes. Tokens of a group are next to each other on either side."""
        ends, ends_a, ends_b = np.cumsum(sizes), np.cumsum(self.a.sizes[a]), np.cumsum(self.b_sizes[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b, to_g = (1 + np.searchsorted(x, y) for x, y in ((ends_a, common), (ends_b, common), (common, ends)))
        from_a, from_b = (np.concatenate([[0], x[:-1]]) for x in (to_a, to_b))
        n_a, n_b = to_a - from_a, to_b - from_b
        n_links = n_a * n_b
        figures = np.stack([np.add.reduceat(x, np.concatenate([[0], to_g[:-1]])) for x in (n_a, n_b, np.ones_like(n_a), n_links)], 1)
        self.more.append(figures)

        wide = n_links > WIDE
        few = np.where(wide, 0, n_links)  # links of groups that aren't wide, one by one
        group = np.repeat(np.arange(len(few)), few)
        k = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few)
        links = np.stack([a[from_a[group] + k // n_b[group]] << 32 | b[from_b[group] + k % n_b[group]], np.ones(len(k), np.int64)], 1)
        starts = np.concatenate([[0], np.cumsum(few)[to_g - 1]]).tolist()
        data, more = memoryview(links.tobytes()), {}
        a_list, b_list = a.tolist(), b.tolist()
        for g in np.flatnonzero(wide).tolist():
            of, many = Counter(a_list[from_a[g] : to_a[g]]), Counter(b_list[from_b[g] : to_b[g]])
            segment = int(np.searchsorted(to_g, g, "right"))
            more[segment] = more.get(segment, b"") + array("q", [v for x, m in of.items() for y, n in many.items() for v in (x << 32 | y, m * n)]).tobytes()

        a_text, b_text = list(map(str, a_list)), list(map(str, b_list))
        texts = [f"{a_text[i]}|{b_text[k]}" if j == i + 1 and m == k + 1 else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True)]
        out, g = [], 0
        for s, to in enumerate(to_g.tolist()):
            out.append((";".join(texts[g:to]), bytes(data[16 * starts[s] : 16 * starts[s + 1]]) + more.get(s, b"")))
            g = to
        return out


class Block:
    """Documents whose postings are packed together."""

    def __init__(self, aligner: Aligner, number: int):
        self.aligner, self.number, self.docs, self.size, self.often = aligner, number, 0, 0, set()
        self.places: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def add(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """Figures (a row for each) and groups of these documents; their links are kept for postings()."""
        found = self.aligner.segments.look(texts)
        self.aligner.settle()
        value, n = self.aligner.segments.values.__getitem__, len(texts)
        places = np.concatenate([np.frombuffer(f, np.int32) for f in found]) if found else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(n), [len(f) for f in found])
        of = self.aligner.figures[places]
        void = np.bincount(owner[of[:, 0] < 0], minlength=n) > 0
        figures = np.stack([np.bincount(owner, c, n).astype(np.int64) for c in of.T], 1)
        figures[void] = 0
        self.places.append(places[~void[owner]])
        self.owners.append(owner[~void[owner]] + self.docs)
        self.docs += n
        self.size += len(places)
        return figures, ["" if v else ";".join([value(k)[0] for k in f]) for f, v in zip(found, void.tolist(), strict=True)]

    def postings(self) -> pa.RecordBatch | None:
        """Rows (a, b, n, docs, times) for the pairs that documents of this block hold: in n documents, so often in each."""
        places, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.places, self.owners))
        if not len(places):
            return None
        used, which, seen = np.unique(places, return_inverse=True, return_counts=True)
        self.often = set(used[seen >= OFTEN].tolist())
        links = [self.aligner.segments.values[p][1] for p in used]
        sizes = np.array(list(map(len, links)), np.int64) // 16
        pairs, times = np.frombuffer(b"".join(links), np.int64).reshape(-1, 2).T
        pairs, number = np.unique(pairs, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counts, ends = sizes[which], np.cumsum(sizes[which])
        at = np.arange(ends[-1]) - np.repeat(ends - counts - starts[which], counts)
        key = number[at] * self.docs + np.repeat(owners, counts)
        if (times == 1).all():
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, m = key[first], np.diff(np.append(first, len(key)))
        else:
            order = np.argsort(key)
            key, m = key[order], times[at][order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, m = key[first], np.add.reduceat(m, first)
        pair, doc = key // self.docs, key % self.docs
        documents = np.bincount(pair, minlength=len(pairs))
        entries = -(-m // TIMES)
        if (entries > 1).any():  # the last entry has what is left
            last = np.cumsum(entries) - 1
            rest = m - (entries - 1) * TIMES
            pair, doc, m = np.repeat(pair, entries), np.repeat(doc, entries), np.full(entries.sum(), TIMES)
            m[last] = rest
        offsets = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=len(pairs)))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(m << DOC_BITS | doc, pa.int32()))
        return pa.record_batch([pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(documents, pa.int32()), lists], [n for n, _ in POSTING])


def groups(docs: DataFrame, vocabularies: tuple[str, bytes, str], text: str = "text", keep: list[str] | None = None, digest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of an alignment, from one table in the shared folder.

    documents: docs' columns of keep (all by default), block and doc, which name a row, n_a, n_b, n_groups, n_links, and groups:
    `a1,a2|b1;a3|b2,b3`, the ids of each group in order. Null and empty texts, and texts that a side's tokens don't give back,
    have zeros and no groups. Texts of any length are encoded whole, repeated rows are rows of their own, an empty table gives
    empty tables; columns with the names of the new ones are replaced.
    With digest, the name of a hash, groups that aren't empty are in its hexadecimal form: they never leave the worker.
    postings: for each block and pair of ids (a, b) the n documents that hold it linked, and docs, which and how often each.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabularies)
    name = "align:" + hashlib.sha256(vocabularies[0].encode() + vocabularies[1]).hexdigest()
    fields = [T.StructField(n, t) for n, t in DOC] + [T.StructField(n, T.LongType()) for n in FIGURES] + [T.StructField("groups", T.StringType())]
    fields += [T.StructField(n, t) for n, t in POSTING]
    taken = {f.name for f in fields} | {"is_posting"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").cast("binary").alias(TEXT))
    kept = [T.StructField(c, narrow.schema[c].dataType, True) for c in keep]
    schema = T.StructType([*kept, *fields, T.StructField("is_posting", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        whole = to_arrow_schema(schema)
        for other in set(worker_cache()) - {name}:
            del worker_cache()[other]
        cache = worker_cache()
        if name not in cache:
            cache[name] = Aligner(shared.value)
        aligner = cache[name]
        number = TaskContext.get().partitionId() << 32

        def table(columns: dict, n: int, posting: bool) -> pa.RecordBatch:
            given = columns | {"is_posting": pa.array([posting] * n)}
            return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in whole], schema=whole)

        def packed(block: Block) -> Iterator[pa.RecordBatch]:
            rows = block.postings()
            if rows is not None:
                for k in range(0, rows.num_rows, 1 << 14):
                    part = rows.slice(k, 1 << 14)
                    yield table(dict(zip(part.schema.names, part.columns, strict=True)) | {"block": pa.array([block.number] * part.num_rows, pa.int64())}, part.num_rows, True)

        aligner.trim(set())
        block = Block(aligner, number)
        for big in batches:
            for batch in _pieces(big, PART):
                n = batch.num_rows
                if block.docs + n > 1 << DOC_BITS:
                    yield from packed(block)
                    aligner.trim(block.often)
                    block = Block(aligner, block.number + 1)
                before = block.docs
                figures, made = block.add([(x or b"").decode("utf-8", "replace") for x in batch.column(n_kept).to_pylist()])
                if digest:
                    made = [hashlib.new(digest, g.encode()).hexdigest() if g else "" for g in made]
                columns = dict(zip(keep, batch.columns[:n_kept], strict=True)) | {"block": pa.array([block.number] * n, pa.int64()), "doc": pa.array(range(before, before + n), pa.int32())}
                columns |= {c: pa.array(v, pa.int64()) for c, v in zip(FIGURES, figures.T, strict=True)} | {"groups": pa.array(made, pa.string())}
                yield table(columns, n, False)
                if block.size >= BLOCK:
                    yield from packed(block)
                    aligner.trim(block.often)
                    block = Block(aligner, block.number + 1)
        yield from packed(block)
        pa.default_memory_pool().release_unused()

    n_kept = len(keep)
    path = scratch(spark, "alignment")
    narrow.mapInArrow(run, schema).write.partitionBy("is_posting").parquet(path)
    everything = spark.read.schema(schema).parquet(path)
    documents = everything.filter("not is_posting").select(*[F.col(f"`{c}`") for c in keep], *[n for n, _ in DOC], *FIGURES, "groups")
    return documents, everything.filter("is_posting").select("block", *[n for n, _ in POSTING])


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, count, best, streams): documents that hold a pair linked, whether it is the highest of its a's counts, and the
    streams that its a's postings are dealt over. Counts are added up before the shuffle; an a has no more partners than
    side B has ids."""
    counts = postings.groupBy("a", "b").agg(F.sum("n").alias("count"))
    mine = Window.partitionBy("a")
    return counts.select("a", "b", "count", (F.col("count") == F.max("count").over(mine)).alias("best"), F.ceil(F.sum("count").over(mine) / STREAM).cast("int").alias("streams"))


def link_scores(postings: DataFrame) -> DataFrame:
    """(block, doc, n_best, count_sum): for each document with links the number of links whose count is their A id's highest,
    ties included, and the sum of all its links' counts.

    Postings meet their counts by ids. The postings of an A id with more than STREAM documents are dealt over several streams
    by block, each met by all counts of the id; how many is known for each id, of which there are no more than side A has.
    """
    counts = pair_counts(postings)
    hot = counts.filter("streams > 1").select(F.col("a").alias("__a"), "streams").distinct()
    dealt = postings.join(F.broadcast(hot), F.col("a") == F.col("__a"), "left")  # one row for an id of A's vocabulary
    dealt = dealt.withColumn("stream", F.when(F.col("streams").isNull(), 0).otherwise(F.pmod(F.xxhash64("block"), F.col("streams")).cast("int")))
    met = counts.withColumn("stream", F.explode(F.sequence(F.lit(0), F.col("streams") - 1))).drop("streams")
    both = dealt.select("a", "b", "stream", "block", "docs").hint("merge").join(met, ["a", "b", "stream"])
    entry = F.col("x")
    each = both.select("block", "count", "best", F.explode("docs").alias("x")).select("block", entry.bitwiseAND((1 << DOC_BITS) - 1).alias("doc"), F.shiftright(entry, DOC_BITS).cast("long").alias("times"), "count", "best")
    return each.groupBy("block", "doc").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))


def scored(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """documents with n_best and count_sum instead of block and doc; zeros for documents without links."""
    found = link_scores(postings).select(F.col("block").alias("__b"), F.col("doc").alias("__d"), "n_best", "count_sum")
    both = documents.join(found, (F.col("block") == F.col("__b")) & (F.col("doc") == F.col("__d")), "left")
    keep = [c for c in documents.columns if c not in ("block", "doc")]
    return both.select(*[F.col(f"`{c}`") for c in keep], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])


def align(docs: DataFrame, vocabularies: tuple[str, bytes, str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns of keep (all by default), n_a, n_b, n_groups, n_links, groups, n_best and count_sum; see groups() and
    link_scores(). Columns named n_best and count_sum are replaced as well."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_best", "count_sum")]
    return scored(*groups(docs, vocabularies, text, keep))
