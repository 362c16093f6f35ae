"""Phrase collocations: phrases whose parts meet more often than chance, mined from counts of all phrases up to a length.

Each shard of documents counts its phrases in a trie of limited depth, kept as sorted arrays, and serialises it as sorted runs,
one for each range of prefixes; a range's runs of all shards are merged, equal phrases summed up. The trie grows level by level: a phrase
can only be frequent if all phrases within it are, so deeper levels hold only phrases whose shorter phrases pass a Bloom filter
of the frequent ones; what the filter lets through by mistake is counted like anything else, so counts are exact. A walk over
the frequent phrases in order gives the counts of left parts, links from a phrase to itself without its first word those of
right parts.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm._common import TEXT, blocks, checkpoint, prepare

#: Words of a shard's trie, and bytes of a text whose words are listed at a time.
SHARD, BLOCK = 1 << 21, 1 << 20
#: A Bloom filter has BITS bits for each phrase, but no more than 2^MOST in all, and PROBES hashes.
BITS, MOST, PROBES = 16, 28, 6

#: A-Z in lower case, ends of pieces as full stops, tabs as spaces.
BREAKS = b".,;:!?\n\v\f\r"
TABLE = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"." * len(BREAKS) + b" ")

#: Phrases that a range of prefixes may have in all shards together, ranges at least, documents for each range of single words, and
#: words that the ranges of longer phrases are laid by.
RANGE, RANGES, DOCUMENTS, MARKS = 1 << 20, 64, 1 << 12, 1 << 12

FREQUENT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("f", T.LongType())])
#: A sorted run: its words, its length's phrases in order as compressed text, and their counts.
RUN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("range", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("phrases", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a hash in a filter of so many bits, a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (h + np.uint64(k) * step) & np.uint64(bits - 1)


class Words(dict):
    """Numbers of words in the order in which they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Trie:
    """Words of a shard in one language, and the counts of its phrases. longest: of any phrase in all passes."""

    def __init__(self, lang: str, longest: int):
        self.lang, self.longest = lang, longest
        self.start([])

    def start(self, before: list[bytes]) -> None:
        """before: words that were counted in an earlier run, but that phrases may still begin in."""
        self.words, self.counted = Words({b".": 0}), len(before)
        self.ids = array("i", map(self.words.__getitem__, before))

    def add(self, data: bytes) -> None:
        self.ids.extend(map(self.words.__getitem__, data.translate(TABLE).replace(b".", b" . ").split()))

    def runs(self, lengths: tuple[int, ...], known: np.ndarray | None, depth: int, marks: list[tuple[bytes, ...]] | int) -> Iterator[pa.RecordBatch]:
        """Runs of the phrases of these lengths, and a new start. known: the filter of frequent phrases of depth words. marks: where
        the ranges begin, in order, or how many there are by the words' hashes."""
        names = list(self.words)
        order = sorted(range(1, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int64)
        rank[order] = np.arange(1, len(names))
        ids, counted = rank[np.frombuffer(self.ids, np.int32)], self.counted
        spelt = [b"", *map(names.__getitem__, order)]
        words = pa.array(spelt, pa.binary())
        hashes = hashed(spelt)
        kept = [names[k] for k in self.ids[-(self.longest - 1) :]] if self.longest > 1 else []
        self.start(kept)

        at = np.flatnonzero(ids)  # where a phrase of the level's length begins; node: which one it is
        node, path = ids[at], []
        for length in range(1, max(lengths) + 1):
            if length > 1:
                ok = np.zeros(len(ids) + 1, bool)
                ok[at] = True
                go = ok[at + 1] & (at + length <= len(ids))  # the phrase's last words but one, too, begin one that may be frequent
                at, node = at[go], node[go]
                word = ids[at + length - 1]
                at, node, word = at[word > 0], node[word > 0], word[word > 0]
                key, node, n = np.unique(node * len(names) + word, return_inverse=True, return_counts=True)
                path.append((key // len(names), key % len(names)))
            else:
                n = np.bincount(ids, minlength=len(names))
                path.append((None, np.arange(len(names))))
            if length == depth:
                fine = self._passes(path, hashes, known)[node]
                at, node = at[fine], node[fine]
            if length in lengths:
                if counted:  # phrases within the words counted before are not new
                    fresh = at + length > counted
                    n = np.bincount(node[fresh], minlength=len(n))
                yield from self._batches(path, words, length, n, spelt, hashes, marks)

    def _passes(self, path: list, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        h = np.full(len(path[-1][1]), xxhash.xxh3_64_intdigest(self.lang), np.uint64)
        for word in _spelt(path):
            h = mixed(h ^ hashes[word])
        fine = np.ones(len(h), bool)
        for p in probes(h, len(known) * 64):
            fine &= (known[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return fine

    def _batches(self, path: list, words: pa.Array, length: int, n: np.ndarray, spelt: list[bytes], hashes: np.ndarray, marks: list[tuple[bytes, ...]] | int) -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(n[1:] if length == 1 else n) + (length == 1)
        if not len(there):
            return
        columns = [c[there] for c in _spelt(path)]
        if isinstance(marks, int):
            of = (hashes[columns[0]] % np.uint64(marks)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            columns, there, of = [c[order] for c in columns], there[order], of[order]
            cuts, ranges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), of
        else:
            place = [bisect.bisect_left(range(len(there)), m, key=lambda i: tuple(spelt[c[i]] for c in columns)) for m in marks]
            ranges = np.searchsorted(np.array(place), np.arange(len(there)), "right")
            cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(there)], strict=True):
            text = b"\n".join(pc.binary_join_element_wise(*[words.take(pa.array(c[a:b])) for c in columns], b" ").to_pylist())
            rows.append((self.lang, length, int(ranges[a]), int(n[there[a:b]].sum()), squeeze.compress(text), squeeze.compress(n[there[a:b]].tobytes())))
        yield pa.record_batch([pa.array(x, f) for x, f in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], RUN.names)


def _spelt(path: list) -> list[np.ndarray]:
    """The words of the last level's nodes, first word first."""
    out, at = [], None
    for parent, word in reversed(path):
        out.append(word if at is None else word[at])
        if parent is not None:
            at = parent if at is None else parent[at]
            if len(out) == len(path) - 1:  # nodes of the first level are the words themselves
                out.append(at)
                break
    return out[::-1]


def runs(docs: DataFrame, text: str, lang: str, lengths: tuple[int, ...], longest: int, known: Broadcast | None, depth: int, marks: list[tuple[bytes, ...]] | int) -> DataFrame:
    """The shards' runs of phrases of these lengths, see Trie.runs()."""
    narrow = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias(TEXT))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}
        filled = known.value if known is not None else None
        size = 0
        for batch in batches:
            texts = batch.column(1)
            for k, of in enumerate(batch.column(0).to_pylist()):
                trie = tries.get(of) or tries.setdefault(of, Trie(of, longest))
                for block in blocks(texts[k].as_py(), BLOCK):
                    before = len(trie.ids)
                    trie.add(block)
                    size += len(trie.ids) - before
                    if size >= SHARD:
                        for full in tries.values():
                            yield from full.runs(lengths, filled, depth, marks)
                        tries, size = {of: trie}, 0
                trie.ids.append(0)
        for full in tries.values():
            yield from full.runs(lengths, filled, depth, marks)
        pa.default_memory_pool().release_unused()

    return narrow.mapInArrow(count, RUN)


def unpacked(run: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The phrases and counts of all runs of a table, one run after the other."""
    expand = zstandard.ZstdDecompressor().decompress
    phrases = pa.concat_arrays([pa.array(expand(x.as_py()).split(b"\n"), pa.binary()) for x in run.column("phrases")])
    return phrases, np.concatenate([np.frombuffer(expand(x.as_py()), np.int64) for x in run.column("counts")])


def merged(found: DataFrame, least: int) -> DataFrame:
    """Phrases of the runs with their sums of at least least: a range's runs of one length and language are merged in one task."""

    def merge(group: pa.Table) -> pa.Table:
        lang, length = group.column("lang")[0].as_py(), group.column("length")[0].as_py()
        phrases, n = unpacked(group)
        both = pa.table({"phrase": phrases, "f": n}).group_by("phrase").aggregate([("f", "sum")])
        both = both.filter(pc.greater_equal(both.column("f_sum"), least)).sort_by("phrase")
        return pa.table([pa.array([lang] * both.num_rows, pa.string()), both.column("phrase").cast(pa.string()), pa.array(np.full(both.num_rows, length, np.int32)), both.column("f_sum")], names=FREQUENT.names)

    return found.groupBy("lang", "length", "range").applyInArrow(merge, FREQUENT)


def marks_of(frequent: DataFrame, ranges: int) -> list[tuple[bytes, ...]]:
    """Where so many ranges of phrases of two words and more begin, so that they weigh alike: by the counts of MARKS words, drawn
    by their hashes, as if words followed each other by chance. They decide where phrases meet, not what is counted."""
    some = frequent.groupBy("phrase").agg(F.sum("f").alias("f")).orderBy(F.xxhash64("phrase"), "phrase").limit(MARKS).collect()
    if not some:
        return []
    words, f = zip(*sorted((r.phrase.encode(), r.f) for r in some), strict=True)
    ends = np.cumsum(np.array(f, float)) / sum(f)

    def quantile(q: float) -> tuple[bytes, float]:
        k = min(int(np.searchsorted(ends, q, "right")), len(words) - 1)
        before = ends[k - 1] if k else 0.0
        return words[k], (q - before) / (ends[k] - before)

    out = set()
    for k in range(1, ranges):
        word, rest = quantile(k / ranges)
        out.add((word, quantile(min(rest, 1.0))[0]))
    return sorted(out)


def bloom(frequent: DataFrame) -> np.ndarray:
    """A Bloom filter of phrases: parts made by each task, joined by place, at most 2^MOST bits in all."""
    n = frequent.count()
    bits = 1 << min(MOST, max(10, (n * BITS).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column(0).to_pylist()], np.uint64)
            words = [hashed(list(w)) for w in zip(*(p.encode().split(b" ") for p in batch.column(1).to_pylist()), strict=True)]
            for w in words:
                h = mixed(h ^ w)
            p = np.concatenate(list(probes(h, bits)))
            place, which = np.unique(p >> np.uint64(6), return_inverse=True)
            word = np.zeros(len(place), np.uint64)
            np.bitwise_or.at(word, which, np.uint64(1) << (p & np.uint64(63)))
            yield pa.record_batch([pa.array(place.astype(np.int64)), pa.array(word.view(np.int64))], ["place", "word"])

    made = frequent.select("lang", "phrase").mapInArrow(part, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()  # 2^MOST / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[made.column(0).to_numpy()] = made.column(1).to_numpy().view(np.uint64)
    return out


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(frequent, totals): phrases of 1 to longest words that come at least least times (lang, phrase, length, f), and all words
    of each language (lang, n). Exact; null texts are empty, a null language is `und`."""
    spark = docs.sparkSession
    prepare(spark)
    levels = [x for x in ((1,), (2,), tuple(range(3, longest + 1))) if x and x[0] <= longest]
    found, known, totals, marks = [], None, None, RANGES + docs.count() // DOCUMENTS
    for depth, lengths in enumerate(levels):
        table = runs(docs, text, lang, lengths, longest, known, depth, marks)
        if not depth:
            table = checkpoint(table)
            totals = checkpoint(table.groupBy("lang").agg(F.sum("n").alias("n")))
        found.append(checkpoint(merged(table, least)))
        if depth + 1 < len(levels):
            known = spark.sparkContext.broadcast(bloom(found[-1]))
        if not depth:
            n = totals.agg(F.sum("n")).first()[0] or 0
            marks = marks_of(found[0], RANGES + n // RANGE)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def left_parts(frequent: DataFrame) -> DataFrame:
    """lang, phrase, f and lefts, the counts of the first 1, 2, ... words, of phrases of two words and more: a walk over the trie
    of phrases in order, by ranges of their first two words. All prefixes of a frequent phrase are frequent."""
    words = F.split("phrase", " ")
    deep = frequent.filter("length > 1").withColumn("words", words).withColumn("w1", F.col("words")[0]).withColumn("w2", F.col("words")[1])
    walked = deep.repartition("lang", "w1", "w2").sortWithinPartitions("lang", "words").select("lang", "phrase", "length", "f", "w1")
    fields = T.StructType([*[walked.schema[c] for c in ("lang", "phrase", "f", "length", "w1")], T.StructField("inner", T.ArrayType(T.LongType(), False))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_lang, way = None, []  # way: the phrases around the one at hand, from the second word on
        for batch in batches:
            inner = []
            langs, phrases, lengths, f = (batch.column(k).to_pylist() for k in range(4))
            for of, phrase, length, n in zip(langs, phrases, lengths, f, strict=True):
                if of != open_lang:
                    open_lang, way = of, []
                del way[length - 2 :]
                inner.append([c for _, c in way])
                way.append((phrase, n))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), batch.column(2), batch.column(4), pa.array(inner, pa.list_(pa.int64()))], fields.names)

    roots = frequent.filter("length = 1").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__w"), F.col("f").alias("__f"))
    both = walked.mapInArrow(walk, fields).join(roots, (F.col("lang") == F.col("__lang")) & (F.col("w1") == F.col("__w")))
    return both.select("lang", "phrase", "length", "f", F.concat(F.array("__f"), "inner").alias("lefts"))


def right_parts(frequent: DataFrame, longest: int) -> DataFrame:
    """lang, phrase and rights, the counts of what is left without the first 1, 2, ... words: a phrase's link leads to itself
    without its first word, whose links were followed in the step before."""
    one = frequent.filter("length = 1").select("lang", "phrase", "f", F.array().cast("array<bigint>").alias("rights"))
    out, below = None, one
    for length in range(2, longest + 1):
        to = below.select(F.col("lang").alias("__lang"), F.col("phrase").alias("link"), F.concat(F.array("f"), "rights").alias("rights"))
        level = frequent.filter(F.col("length") == length).withColumn("__link", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
        below = level.join(to, (F.col("lang") == F.col("__lang")) & (F.col("__link") == F.col("link"))).select("lang", "phrase", "f", "rights")
        out = below if out is None else out.unionByName(below)
    return out.select("lang", "phrase", "rights")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, cover: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first most phrases of 2 to longest words that come at least least
    times, by score descending, a descending, phrase ascending.

    score is the least floor(1000 a n / (l r)) over the cuts of a phrase into a left part, l times, and a right part, r times,
    in decimals that don't overflow; of equal scores the shortest left part counts. Phrases within a longer one of those that
    comes at least cover % as often are left out. Null and empty texts have no words, a null language is `und`; phrases don't
    cross `.,;:!?` and line ends. Texts of any length count whole, in runs that go on where the last one ended; repeated rows
    count again. An empty table gives an empty table. Columns of docs may have any names.
    """
    frequent, totals = counts(docs, text, lang, longest, least)
    lefts, rights = left_parts(frequent), right_parts(frequent, longest)
    both = lefts.join(rights.select(F.col("lang").alias("__l"), F.col("phrase").alias("__p"), "rights"), (F.col("lang") == F.col("__l")) & (F.col("phrase") == F.col("__p"))).drop("__l", "__p")
    n = totals.select(F.col("lang").alias("__l"), "n")
    told = both.join(n, F.col("lang") == F.col("__l")).drop("__l")
    told = told.withColumn("cut", F.expr("""
        array_min(transform(sequence(1, length - 1), k -> named_struct(
            'score', cast(1000 * f as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(lefts[k - 1] as decimal(19,0)) * cast(rights[k - 1] as decimal(19,0))),
            'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))"""))
    within = frequent.filter("length > 2").select("lang", "f", F.explode(F.expr("""
        array_distinct(flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))""")).alias("__p"))
    covered = within.groupBy(F.col("lang").alias("__l"), "__p").agg(F.max("f").alias("__f"))
    hidden = (F.col("lang") == F.col("__l")) & (F.col("phrase") == F.col("__p")) & (100 * F.col("__f") >= cover * F.col("f"))
    left = told.join(covered, hidden, "left_anti").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return left.withColumn("rank", place).filter(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, with the parameters above.
ORACLE_SQL = r"""
    with texts as (
        select row_number() over () as place, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
    lists as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as words from pieces),
    grams as (
        select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase
        from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from lists, (values (1), (2), (3), (4), (5)) as lengths(k) where len(words) >= k)),
    counted as (select lang, k, phrase, count(*)::bigint as f from grams group by all),
    totals as (select lang, sum(f)::bigint as n from counted where k = 1 group by lang),
    frequent as (select lang, k, phrase, f, string_split(phrase, ' ') as words from counted where f >= 100),
    cuts as (
        select p.lang, p.phrase, p.f as a, c as cut, l.f as l, r.f as r, t.n, (1000::hugeint * p.f * t.n) // (l.f::hugeint * r.f) as score
        from (select *, unnest(range(1, k)) as c from frequent where k > 1) p
        join frequent l on l.lang = p.lang and l.phrase = array_to_string(p.words[1 : c], ' ')
        join frequent r on r.lang = p.lang and r.phrase = array_to_string(p.words[c + 1 : p.k], ' ')
        join totals t on t.lang = p.lang),
    least as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
    inner_phrases as (
        select lang, f, array_to_string(words[i : i + m - 1], ' ') as phrase
        from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from frequent where k > 2))),
    hidden as (select lang, phrase, max(f) as f from inner_phrases group by all),
    ranked as (
        select l.*, row_number() over (partition by l.lang order by score desc, a desc, l.phrase) as rank
        from least l left join hidden h on h.lang = l.lang and h.phrase = l.phrase where h.f is null or 100 * h.f < 100 * l.a)
    select lang, rank::bigint as rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000"""
