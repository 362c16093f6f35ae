"""Byte-level BPE without merge loops.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours are compatible, that is, if BPE of
their two joined texts gives the two back. So the encoder walks over the bytes with the longest token that starts there
(an Aho-Corasick automaton over Latin-1 images of the tokens' bytes), takes the next shorter token if neighbours don't
fit, and steps back where none does; a place from which no end was reached is never tried again, which keeps it linear.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import map_texts, prepare, worker_cache

#: Entries of the memos of pieces and of neighbours in a worker; a full memo starts again.
PIECES, NEIGHBOURS = 1 << 19, 1 << 18
#: Characters of a text that are taken at a time.
LONG = 1 << 20
#: Safe cuts, and parts that lie between two of them.
CUT, EDGES = regex.compile(r"(?<=\S) (?=\S)"), regex.compile(r"\S(?:.*\S)?", regex.DOTALL)


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file, read on the driver: a vocabulary doesn't grow with the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder of one vocabulary. pattern: what is encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern)
        top = max(self.bytes_of) + 1
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(top)]
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens that merge into a token last
        self.shorter = [-1] * top  # longest token that is a proper prefix
        self.fits_memo: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}  # memos hold ids as the bytes of an array: small, and quickly joined
        self.known: dict[str, bytes] = {}  # by segment, a space before it
        self.older: dict[str, bytes] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._merge(token, rank) if len(token) > 1 else [rank, rank]
            if len(halves) == 2:  # else no merge leads here: never a token of an encoding, but for a piece as a whole
                self.parts[rank] = (halves[0], halves[1])
        self.automaton = ahocorasick.Automaton()
        for rank in self.parts:
            token = self.bytes_of[rank]
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
            self.shorter[rank] = next((r for k in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:k])) in self.parts), -1)
        self.automaton.make_automaton()

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain BPE with the ranks below one only, for setting up: tokens are short."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: undoing merges of either side, latest first, no merge across comes sooner."""
        ranks, bytes_of, parts = self.ranks, self.bytes_of, self.parts
        limit = 1 << 62
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], limit) < limit:
                return False
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def _ahead(self, image: str, start: int, longest: list[int]) -> int:
        """The longest token at start. Those behind it are filled in as well, up to a place where one is known: each place once."""
        at = start
        for end, (back, rank) in self.automaton.iter_long(image, start):
            if end - back != at:
                raise ValueError("the vocabulary lacks a byte")
            if longest[at] >= 0:
                return longest[start]
            longest[at] = rank
            at = end + 1
        if at != len(image):
            raise ValueError("the vocabulary lacks a byte")
        return longest[start]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:  # as the library does
            return (whole,)
        n, size, shorter, memo, image = len(data), self.size, self.shorter, self.fits_memo, data.decode("latin-1")
        longest = [-1] * n  # filled where the walk comes by
        dead: set[int] = set()  # places from which the end can't be reached
        out: list[int] = []
        at, last, token = 0, -1, self._ahead(image, 0, longest)
        while True:
            after = at + size[token]
            if after not in dead:
                if last < 0:
                    ok = True
                else:
                    pair = last << 32 | token
                    ok = memo.get(pair)
                    if ok is None:
                        if len(memo) >= NEIGHBOURS:
                            memo.clear()
                        ok = memo[pair] = self.fits(last, token)
                if ok:
                    out.append(token)
                    if after == n:
                        return tuple(out)
                    at, last, token = after, token, longest[after]
                    if token < 0:
                        token = self._ahead(image, at, longest)
                    continue
            token = shorter[token]
            if token < 0:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def _segment(self, segment: str) -> bytes:
        """Ids of a part of a text between two safe cuts, by its pattern matches. A match that begins with a space is
        remembered as the segment that it is elsewhere."""
        found = self.find.findall(segment) if len(segment) <= LONG else (m.group() for m in self.find.finditer(segment))
        ids: list[bytes] = []
        for piece in found:
            spaced = piece[0] == " " and len(piece) > 1
            memo = self.known if spaced else self.pieces
            name = piece[1:] if spaced else piece
            got = memo.get(name) or spaced and self.older.get(name)
            if not got:
                got = array("i", self.encode_piece(piece)).tobytes()
                if len(piece) < 64 and len(memo) < PIECES:
                    memo[name] = got
            ids.append(got)
        return b"".join(ids)

    def _window(self, text: str, first: bool) -> Iterable[bytes]:
        """Ids by segments. A single space between two characters that aren't white space is a safe cut: a match always
        begins with that space. So what stands between two such spaces is encoded once and remembered."""
        parts = text.split(" ")
        known, older = self.known, self.older
        got = list(map(known.get, parts))
        if first:
            got[0] = None
        for k in [k for k, ids in enumerate(got) if ids is None]:
            part = parts[k]
            ids = older.get(part)
            if k == 0 and first or ids is None:
                if not ("!" <= part[:1] <= "~" and "!" <= part[-1:] <= "~" or EDGES.fullmatch(part)):
                    parts = CUT.split(text)
                    return [self._segment(x if first and not k else " " + x) for k, x in enumerate(parts)]
                ids = self._segment(part if k == 0 and first else " " + part)
            if len(part) < 64 and not (k == 0 and first):
                if len(known) >= PIECES:  # what was seen since the last time stays at hand
                    self.older, self.known = known, {}
                    known, older = self.known, self.older
                known[part] = ids
            got[k] = ids
        return got

    def encode(self, data: bytes | None) -> array:
        """Ids of a whole text; null and empty give none. Bytes that aren't UTF-8 count as U+FFFD."""
        text = (data or b"").decode("utf-8", "replace")
        ids, start = array("i"), 0
        if len(text) <= LONG:
            ids.frombytes(b"".join(self._window(text, True)) if text else b"")
            return ids
        while start < len(text):  # windows from a safe cut to a safe cut
            cut = CUT.search(text, start + LONG)
            end = cut.start() if cut else len(text)
            ids.frombytes(b"".join(self._window(text[start:end], start == 0)))
            start = end + 1
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(shared, name: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary; a vocabulary that the worker has isn't unpacked again."""
    cache = worker_cache()
    if name not in cache:
        cache[name] = Codec(shared.value, pattern)
    return cache[name]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs' columns of keep (all by default) and out, an array of token ids of the whole text. Null and empty: no ids.

    Very long texts are encoded whole, in windows from one safe cut to the next. A cut is safe for patterns whose matches
    begin with the single space before a word, as those of the public vocabularies do. Repeated rows are encoded alike, an
    empty table gives an empty table.
    With decoded, a column of that name has the bytes that the ids decode to, from the same worker. Any columns with the
    new names are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    name = "bpe:" + hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def make():
        codec = _codec(shared, name, pattern)

        def work(texts):
            found, ends, back = array("i"), array("i", [0]), []
            for t in texts:
                ids = codec.encode(t)
                found.extend(ids)
                ends.append(len(found))
                if decoded:
                    back.append(codec.decode(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(found), pa.int32()))
            return [lists, pa.array(back, pa.binary())] if decoded else [lists]

        return work

    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, fields, make, name)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens and the bytes of its ids; null ids give null."""
    prepare(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    tokens = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c.lower() != out.lower()])

    def run(batches):
        name = shared.value.__getitem__
        for b in batches:
            made = [b"".join(map(name, x.values.to_numpy().tolist())) if x.is_valid else None for x in b.column(ids)]  # a row's ids at a time
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, out])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(tokens: DataFrame, key: str) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return tokens.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
