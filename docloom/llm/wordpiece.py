"""Greedy word-piece token counts by a linear automaton.

The vocabulary is a trie with failure links. Where no letter follows, the pieces that longest match would cut off are not
built: their number was computed beforehand, is added, and the failure link leads to the rest that is still open.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import blocks, map_texts, prepare, worker_cache

#: Bytes of a text whose words are listed at a time.
BLOCK = 1 << 22
#: Words whose counts a worker remembers, and the mark of pieces that begin a word.
WORDS, BEGIN = 1 << 18, "▁"


def load_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """Pieces of a sentencepiece model, without control and byte pieces, read on the driver: a vocabulary doesn't grow with the data."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]


class Automaton:
    """Trie of all pieces. A word is BEGIN and its letters; the first piece begins with BEGIN, the others don't."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends, depth, order = [False], [0], [0]
        for piece in pieces:
            node = 0
            for c in piece:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(False)
                    depth.append(depth[node] + 1)
                node = to
            self.ends[node] |= node > 0
        # fail[v]: where matching goes on after the pieces that longest match takes off v's text; pops[v]: how many those are
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        while order:
            wave: list[int] = []
            for u in order:
                for c, v in self.next[u].items():
                    wave.append(v)
                    if self.ends[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], n
            order = wave

    def count(self, word: str) -> int:
        """Pieces of longest match; 1, the unknown piece, if some letter is in none; 0 for an empty word."""
        if not word:
            return 0
        node, n = 0, 0
        nexts, fail, pops = self.next, self.fail, self.pops
        for c in BEGIN + word:
            while c not in nexts[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nexts[node][c]
        while node > 0:
            n += pops[node]
            node = fail[node]
        return 1 if node < 0 else n


class Counter(dict):
    """Counts of words, remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(self) >= WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns of keep (all by default), n_words and n_tokens of the whole text.

    Words end at ASCII white space; a word with a letter outside the vocabulary is one unknown token. Null and empty texts
    have none of either. Texts of any length are counted whole, in parts that never cut a word. Repeated rows count alike, an
    empty table gives an empty table. Columns with the names of the new ones are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    name = "wordpiece:" + hashlib.sha256("\n".join(pieces).encode()).hexdigest()

    def make():
        cache = worker_cache()
        if name not in cache:
            cache[name] = Counter(Automaton(shared.value))
        counts = cache[name]

        def work(texts):
            words, tokens = [], []
            for t in texts:
                n = total = 0
                for block in blocks(t or b"", BLOCK):
                    found = block.split()
                    n += len(found)
                    total += sum(map(counts.__getitem__, found))
                words.append(n)
                tokens.append(total)
            return [words, tokens]

        return work

    return map_texts(docs, F.col(f"`{text}`"), docs.columns if keep is None else keep, [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], make, name)
