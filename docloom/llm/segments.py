"""Token ids of texts by the segments between safe cuts, each segment encoded once and remembered.

A safe cut is before a single space or line feed between two characters that aren't white space: byte-level BPE with the
usual pattern begins a match there, and so do piece vocabularies in which no piece has its space mark behind a letter, or a
line feed. So what a segment encodes to doesn't depend on what is around it.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import regex

#: Segments that a worker remembers, and characters of a text that are cut up at a time.
SEGMENTS, LONG = 1 << 17, 1 << 20

#: White space by any definition, and as the inside of a character class.
BLANKS = frozenset(chr(c) for c in range(0x10000) if chr(c).isspace() or unicodedata.category(chr(c))[0] == "Z") | set("\u180e\u200b\ufeff")
BLANK = "".join(map(regex.escape, sorted(BLANKS)))
CUT = regex.compile(f"(?<=[^{BLANK}])(?=[ \n][^{BLANK}])")
SPACE = regex.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")


def windows(text: str, most: int = LONG) -> Iterator[str]:
    """Parts of a text of most characters or a little more, from one safe cut at a space to the next, without that space."""
    start = 0
    while len(text) - start > most:
        cut = SPACE.search(text, start + most)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:] if start else text


class Segments:
    """What each segment of a text encodes to. encode: values of a list of segments, each with the space that it begins with.

    spaced: whether the texts' first segments have such a space too, one that isn't part of the text.
    """

    def __init__(self, encode: Callable[[list[str]], list], spaced: bool, most: int = SEGMENTS):
        self.encode, self.spaced, self.most = encode, spaced, most
        self.places: dict[str, int] = {}
        self.values: list = []
        self.new: list[str] = []

    def trim(self, often: set[int] = frozenset()) -> list[int] | None:
        """If there are too many segments, forget all but those at these places, and give their places in order: each is now
        where it stands in that list. Else None, and nothing changes."""
        if len(self.places) <= self.most:
            return None
        kept = [(k, name) for k, name in enumerate(self.places) if k in often]
        self.places = {name: n for n, (_, name) in enumerate(kept)}
        self.values = [self.values[k] for k, _ in kept]
        return [k for k, _ in kept]

    def look(self, texts: list[str]) -> list[array]:
        """For each text the places of its segments in values, in order."""
        out = []
        for text in texts:
            found = array("i")
            if text:
                for k, part in enumerate(windows(text)):
                    found.extend(self._places(part, k == 0))
            out.append(found)
        if self.new:
            self.values.extend(self.encode(self.new))
            self.new = []
        return out

    def _places(self, text: str, first: bool) -> list[int]:
        """Names of segments: solid ones without a space, and those of a line feed and a solid rest, by themselves; others behind
        one space. A first segment that has no space before it has two more spaces in its name."""
        places, bare = self.places, first and not self.spaced
        parts = text.replace("\n", " \n").split(" ")
        got = list(map(places.get, parts))
        if bare:
            got[0] = places.get("  " + parts[0])
        missing = [k for k, g in enumerate(got) if g is None]
        if all(_solid(parts[k]) for k in missing):
            for k in missing:
                part = parts[k]
                got[k] = self._add("  " + part, part) if bare and not k else self._add(part, part if part[0] == "\n" else " " + part)
            return got
        cuts = [0, *(m.start() for m in CUT.finditer(text)), len(text)]
        got = []
        for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = text[start:end] if k or bare else " " + text[start:end]
            name = part[1:] if part[0] == " " and not (bare and k == 0) else part
            name = name if " " not in name and _solid(name) and (k or name[0] != "\n") else " " + part
            got.append(self._add("  " + name, part) if bare and not k else self._add(name, part))
        return got

    def _add(self, name: str, segment: str) -> int:
        place = self.places.get(name)
        if place is None:
            place = self.places[name] = len(self.places)
            self.new.append(segment)
        return place


def _solid(name: str) -> bool:
    first = name[1:2] if name[:1] == "\n" else name[:1]
    return first != "" and first not in BLANKS and name[-1] not in BLANKS


def joins(segment: str) -> bool:
    """Whether a segment can stand behind and before others like it: a space or a line feed, and something solid behind it."""
    return len(segment) > 1 and segment[0] in " \n" and segment[1] not in BLANKS and segment[-1] not in BLANKS


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer from its JSON. special: whether its special tokens are found in texts, else they are plain text.

    If the vocabulary's numbers go up in the order of its merges, they are ranks, and the faster of two libraries can encode
    with them: the ids are the same.
    """

    def __init__(self, content: str, pattern: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, byte = json.loads(content)["model"], byte_alphabet()
        names = {t["content"]: t["id"] for t in json.loads(content)["added_tokens"]}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in names}
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *names.values()]))
        for t, i in [*vocabulary.items(), *names.items()]:
            self.bytes_of[i] = t.encode() if t in names else bytes(map(byte.__getitem__, t))
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if all(vocabulary.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges)):
            import tiktoken

            ranks = {self.bytes_of[i]: i for i in vocabulary.values()}
            library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=names)
            self.ids = (lambda text: library.encode(text, allowed_special="all")) if special else library.encode_ordinary
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(content)
            tokenizer.encode_special_tokens = not special
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def each(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after the other, and the number of ids up to the end of each. Those that join are encoded as one
        text."""
        found, run = [], []
        for s in segments:
            if joins(s):
                run.append(s)
                continue
            if run:
                found.append(self.ids("".join(run)))
                run = []
            found.append(self.ids(s))
        if run:
            found.append(self.ids("".join(run)))
        ids = np.concatenate([np.array(x, np.int64) for x in found])
        return ids, 1 + np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) for s in segments]))
