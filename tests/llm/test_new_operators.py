"""Phrases, packing and alignment against plain versions of the same rules, and on awkward rows."""

import collections
import functools
import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import alignment, exact_dedup, mixing, packing, phrases, quality_gam, quality_rules, queries
from docloom.llm.segments import ByteLevel, Segments, windows
from docloom.session import checkpoint_folder
from tests.llm.helpers import DOCS, awkward, empty

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.lists(st.sampled_from([*"ab1é.,!'🙂", " ", " ", "\n", "\u00a0", "\u3000", "\x1c", "\u200b", "\u0301", "▁", "the", "<|endoftext|>", "<s>", "ﬁ"]), max_size=24).map("".join)


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.load(None, BYTE_LEVEL, PIECES, public_tokenizers.PATTERN)


@functools.cache
def plain_tokenizer(special):
    t = Tokenizer.from_file(BYTE_LEVEL)
    t.encode_special_tokens = not special
    return t


def aligned(aligner, tokenizer, model, text):
    """Groups, figures and links of one text by the rule itself."""
    if not text:
        return "", 0, 0, 0, 0, {}
    data = (" " + text).encode()
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    ab, bb = [aligner.a.bytes_of[i] for i in a], [aligner.b_bytes[i] for i in b]
    if b"".join(ab) != data or b"".join(bb) != data:
        return "", 0, 0, 0, 0, {}
    ends = [list(itertools.accumulate(map(len, x))) for x in (ab, bb)]
    groups, links, i, j = [], collections.Counter(), 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = [x for x, e in zip(a[i:], ends[0][i:], strict=True) if e <= end], [x for x, e in zip(b[j:], ends[1][j:], strict=True) if e <= end]
        i, j = i + len(p), j + len(q)
        groups.append(f"{','.join(map(str, p))}|{','.join(map(str, q))}")
        links.update(itertools.product(p, q))
    return ";".join(groups), len(a), len(b), len(groups), sum(links.values()), dict(links)


# segments


@functools.cache
def byte_level(special):
    return ByteLevel(open(BYTE_LEVEL, encoding="utf-8").read(), public_tokenizers.PATTERN, special)


@functools.cache
def one_aligner():
    return alignment.Aligner(alignment.load(None, BYTE_LEVEL, PIECES, public_tokenizers.PATTERN))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.integers(1, 8))
def test_segments_give_what_the_library_gives(texts, most):
    for special in (False, True):
        ours, library = byte_level(special), plain_tokenizer(special)
        s = Segments(lambda x, ours=ours: [ours.ids(y) for y in x], spaced=False, most=3)
        for text in texts:
            found = [i for p in s.look([text])[0] for i in s.values[p]]
            assert found == library.encode(text, add_special_tokens=False).ids
            s.trim({0, 1})
        ids, ends = ours.each([t for t in texts if t] or ["a"])
        assert ids[: ends[0]].tolist() == library.encode(next((t for t in texts if t), "a"), add_special_tokens=False).ids
    for text in texts:
        assert " ".join(windows(text, most)) == text


def test_vocabularies_that_are_not_ranks_go_to_the_other_library():
    content = json.loads(open(BYTE_LEVEL, encoding="utf-8").read())
    content["model"]["merges"] = content["model"]["merges"][:500][::-1]
    other = ByteLevel(json.dumps(content), public_tokenizers.PATTERN, special=True)
    assert other.ids("the other <|endoftext|>") == Tokenizer.from_str(json.dumps(content)).encode("the other <|endoftext|>", add_special_tokens=False).ids


# alignment


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([1, 256]), st.sampled_from([2, 2047]))
def test_groups_and_postings_of_a_text(text, wide, times):
    aligner = one_aligner()
    before = alignment.WIDE, alignment.TIMES
    alignment.WIDE, alignment.TIMES = wide, times
    try:
        aligner.segments.places.clear(), aligner.segments.values.clear()
        aligner.figures = aligner.figures[:0]
        block = alignment.Block(aligner, 0)
        figures, groups = block.add([text])
        rows = block.postings()
    finally:
        alignment.WIDE, alignment.TIMES = before
    want = aligned(aligner, plain_tokenizer(False), aligner.b, text)
    assert (groups[0], *figures[0].tolist()) == want[:5]
    links = {(a, b): sum(e >> alignment.DOC_BITS for e in d) for a, b, d in zip(*(rows[c].to_pylist() for c in ("a", "b", "docs")), strict=True)} if rows else {}
    assert links == want[5] and (rows is None or set(rows["n"].to_pylist()) == {1})


def corpus_links(docs):
    aligner, tokenizer = one_aligner(), plain_tokenizer(False)
    each = [(r, aligned(aligner, tokenizer, aligner.b, r.text)) for r in docs]
    counts = collections.Counter(k for _, x in each for k in x[5])
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(r.doc_id, *x[1:5], sum(m for k, m in x[5].items() if counts[k] == best[k[0]]), sum(m * counts[k] for k, m in x[5].items()), x[0]) for r, x in each]


@pytest.mark.parametrize("stream", [1 << 24, 2])
def test_alignment_of_a_corpus(spark, vocabularies, monkeypatch, stream):
    monkeypatch.setattr(alignment, "STREAM", stream)
    docs = awkward(spark)
    got = alignment.align(docs, vocabularies, keep=["doc_id"])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(corpus_links(docs.collect()), key=str)
    assert alignment.align(empty(spark), vocabularies).count() == 0


def test_alignment_query(spark, sf):
    got = {r.doc_id: r for r in queries.op13_alignment(spark, sf).collect()}
    for doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups in corpus_links(spark.read.parquet(f"{sf}/documents.parquet").collect()):
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


# packing


def check_sequences(rows, window):
    """Offsets without gaps; gives the padding."""
    sequences, padding = collections.defaultdict(list), 0
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def check_pieces(rows, docs):
    """rows: key, start, length, ids, doc_tokens; docs: key and text, each key once."""
    pieces = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append(r)
    assert set(pieces) == {k for k, _ in docs}
    for key, text in docs:
        parts, at = sorted(pieces[key], key=lambda r: r.start), 0
        for r in parts:
            assert r.start == at and r.doc_tokens == sum(p.length for p in parts)
            at += r.length
        ids = plain_tokenizer(True).encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == [*ids, 1]


@pytest.mark.parametrize("shard", [512, 3])
def test_packing_of_awkward_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD", shard)
    docs, tokenizer = awkward(spark).drop("fp").withColumnRenamed("Score", "Shard"), packing.load(None, BYTE_LEVEL, public_tokenizers.PATTERN)
    got = packing.pack(docs, tokenizer, keep=["doc_id", "lang"], window=64)
    rows, once = got.collect(), [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (2, None)]
    check_sequences(rows, 64)
    check_pieces([r for r in rows if r.doc_id not in (2, None)], once)
    twice = [r for r in rows if r.doc_id == 2]  # a repeated row is a document of its own
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    assert packing.pack(empty(spark), tokenizer).count() == 0


def test_packing_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokenizer = packing.load(None, BYTE_LEVEL, public_tokenizers.PATTERN)
    rows = packing.pack(docs, tokenizer, keep=["doc_id"]).collect()
    assert check_sequences(rows, packing.WINDOW) == 0
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
    short = {(r.doc_id, r.start): (r.length, r.ids_crc32, r.sequence_id, r.offset) for r in queries.op12_packing(spark, sf).collect()}
    assert short == {(r.doc_id, r.start): (r.length, zlib.crc32(r.ids), r.sequence_id, r.offset) for r in rows}


def test_tokens_of_plain_texts_are_looked_up_once_a_batch(monkeypatch):
    """Words are cut and counted in Arrow; text by text goes only what has blanks in odd places, or is long."""
    random.seed(9)
    words = ["the", "naïve", "Straße", "日本語", "🙂", "42", "!!!", "don't", "x<|endoftext|>y", "<|endoftext|>", "\x00", "a\tb", "e\u0301", "it\u00a0is", "z" * 70]
    plain = ["".join(random.choice(words) + random.choice("  \n") for _ in range(random.randint(0, 60))) + random.choice(words) for _ in range(200)]
    blanks = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " \t", "\r\n", "\u00a0", " \u3000", "\u200b ", "\ufeff", "\u180e", "\x85", "\x1c "]
    odd = ["", *blanks, *(f"{b}one two" for b in blanks), *(f"one two{b}" for b in blanks), *(f"one{b}two{b}  three" for b in blanks), "word " * 300 + "end"]
    monkeypatch.setattr(packing, "LONG", 1400)
    monkeypatch.setattr(packing, "RUN", 7)
    plain = [t for t in plain if len(t.encode()) <= 1400]
    walked, walk = [], packing.Segments._places
    monkeypatch.setattr(packing.Segments, "_places", lambda self, text, first: walked.append(text) or walk(self, text, first))
    tokens, tokenizer = packing.Tokens(packing.load(None, BYTE_LEVEL, public_tokenizers.PATTERN)), plain_tokenizer(True)
    want = {t: tokenizer.encode(t, add_special_tokens=False).ids for t in plain + odd}
    for texts in (plain, odd, plain[:20] + odd + plain[20:], [""], ["", ""], []):
        got = tokens.ids(packing._strings(pa.array([t.encode() for t in texts], pa.binary())))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want[t] for t in texts]
        assert len(plain) > 150 and set(walked) <= set(odd)
    assert packing._strings(pa.array([b"a\xffb", None, b"\xed\xa0\x80"], pa.binary())).to_pylist() == ["a\ufffdb", "", "\ufffd\ufffd\ufffd"]


def test_index_scores_are_bm25():
    random.seed(5)
    pieces = [np.array([random.randrange(12) for _ in range(random.randint(1, 30))], np.uint32) for _ in range(40)]
    df = np.array([sum(t in p for p in pieces) for t in range(12)])
    idf = np.maximum(0, np.log((len(pieces) - df + 0.5) / (df + 0.5)))
    idf[:6] = np.arange(1, 7)
    average = float(np.mean([len(p) for p in pieces]))
    index = packing.Index(pieces, idf, average)
    for q in range(len(pieces)):
        want = []
        for p in pieces:
            tf = collections.Counter(p.tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(p) / average)) for t in set(pieces[q].tolist()) if tf[t]))
        assert np.allclose(index.scores(q), want)


def test_windows_hold_neighbours():
    """Two kinds of pieces that share no term: windows are of one kind, but where one runs out."""
    pieces = [np.array([100 * (k % 2) + j for j in range(20)], np.uint32) for k in range(32)]
    made = packing.fill(pieces, np.ones(200), 20.0, window=80)
    kinds = collections.defaultdict(set)
    for piece, _, _, sequence, _ in made:
        kinds[sequence].add(piece % 2)
    assert sum(len(k) > 1 for k in kinds.values()) == 0 and sum(n for _, _, n, _, _ in made) == 640


# phrases


def mined(docs, least, longest=5, cover=100, most=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        hidden = collections.Counter()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    hidden[p[i : i + k]] = max(hidden[p[i : i + k]], a)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and not 100 * hidden[p] >= cover * a > 0:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def test_phrases_of_awkward_rows(spark):
    docs = awkward(spark)
    want = mined([(r.text, r.lang) for r in docs.collect()], 3)
    assert want and sorted(map(tuple, phrases.collocations(docs, least=3).collect())) == want
    assert phrases.collocations(empty(spark)).count() == 0
    few = mined([(r.text, r.lang) for r in docs.collect()], 3, longest=3, cover=50, most=7)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, longest=3, cover=50, most=7).collect())) == few


def test_phrases_by_chance(spark):
    random.seed(2)
    words = ["a", "b", "Ä", "the", "x\u0000y", "the\u0001", "é"]
    texts = [" ".join(random.choices(words, k=random.randint(0, 40))).replace("x", random.choice(["x", ".x", "\tx", "X"])) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, random.choice(["en", None, "fr"]), "s", 0, "", "") for i, t in enumerate(texts)], DOCS)
    assert sorted(map(tuple, phrases.collocations(docs, least=5).collect())) == mined([(r.text, r.lang) for r in docs.collect()], 5)


@pytest.mark.parametrize("lengths, depth", [((1,), 0), ((2,), 0), ((3, 4, 5), 0)])
def test_a_shard_that_is_cut_counts_each_phrase_once(lengths, depth):
    random.seed(4)
    text = " ".join(random.choices(["a", "b", "c", "d."], k=500)).encode()
    whole, cut, counts = phrases.Trie("en", 5), phrases.Trie("en", 5), collections.Counter()
    whole.add(text)

    def take(trie):
        for run in trie.runs(lengths, None, depth, 3 if lengths == (1,) else [(b"b", b"c"), (b"c", b"a")]):
            for k in range(run.num_rows):
                p, n = phrases.unpacked(pa.table(run.slice(k, 1).columns, names=run.schema.names))
                assert p.to_pylist() == sorted(p.to_pylist())
                counts.update(dict(zip(p.to_pylist(), n.tolist(), strict=True)))

    take(whole)
    want, counts = counts, collections.Counter()
    start = 0
    for end in (90, 96, 400, len(text)):
        end = len(text) if end == len(text) else text.rindex(b" ", 0, end) + 1
        cut.add(text[start:end])
        take(cut)
        start = end
    assert counts == want and sum(want.values()) > 0


def test_bloom_filter_has_no_false_negative(spark):
    rows = [("en", f"w{i} v{i}", 2, 100) for i in range(500)]
    known = phrases.bloom(spark.createDataFrame(rows, phrases.FREQUENT))
    trie = phrases.Trie("en", 5)
    trie.add(" . ".join(r[1] for r in rows).encode())
    found = sum(run["n"].to_pylist()[k] for run in trie.runs((2,), known, 2, 1) for k in range(run.num_rows))
    assert found == 500


def test_phrases_query(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries.op11_phrases(spark, sf).collect())) == sorted(c.sql(phrases.ORACLE_SQL).fetchall())


# the additive model of op8, in plain loops


def plain_boosting(stats, y, bins, rounds, rate, pairs, coarse, reg):
    """The steps of quality_gam.fit(), one number at a time; gives each row's sum."""
    n, m = len(stats), len(stats[0])
    rate1 = (sum(y) + 0.5) / (n + 1)
    f = [math.log(rate1 / (1 - rate1))] * n
    cuts = [sorted(set(np.quantile([r[k] for r in stats], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for k in range(m)]
    b = [[sum(c <= r[k] for c in cuts[k]) for r in stats] for k in range(m)]

    def sums(at, size):
        out = [[0.0, 0.0] for _ in range(size)]
        for row, x in enumerate(at):
            p = 1 / (1 + math.exp(-f[row]))
            out[x][0] += y[row] - p
            out[x][1] += p * (1 - p)
        return out

    def leaf(parts):
        return sum(g for g, _ in parts) / (sum(h for _, h in parts) + reg)

    def cut(parts):
        gain = [sum(g for g, _ in side) ** 2 / (sum(h for _, h in side) + reg) for k in range(1, len(parts)) for side in (parts[:k], parts[k:])]
        both = [gain[2 * k] + gain[2 * k + 1] for k in range(len(parts) - 1)]
        best = max(range(len(both)), key=lambda k: both[k])
        return both[best] - sum(g for g, _ in parts) ** 2 / (sum(h for _, h in parts) + reg), best + 1

    for _ in range(rounds):
        for k in range(m):
            if cuts[k]:
                parts = sums(b[k], len(cuts[k]) + 1)
                gain, at = cut(parts)
                if gain > 1e-9:
                    low, high = leaf(parts[:at]), leaf(parts[at:])
                    f = [v + rate * (low if x < at else high) for v, x in zip(f, b[k], strict=True)]
    fold = [[min(x * coarse // (len(cuts[k]) + 1), coarse - 1) for x in b[k]] for k in range(m)]
    found = []
    for i, j in itertools.combinations(range(m), 2):
        parts = sums([x * coarse + z for x, z in zip(fold[i], fold[j], strict=True)], coarse * coarse)
        found.append((sum(g * g / (h + reg) for g, h in parts), i, j))
    for _ in range(rounds // 3):
        for _, i, j in sorted(found, reverse=True)[:pairs]:
            parts = sums([x * coarse + z for x, z in zip(fold[i], fold[j], strict=True)], coarse * coarse)
            grid = [parts[x * coarse : (x + 1) * coarse] for x in range(coarse)]
            _, r = cut([(sum(g for g, _ in row), sum(h for _, h in row)) for row in grid])
            value = {}
            for rows in (range(r), range(r, coarse)):
                columns = [(sum(grid[x][z][0] for x in rows), sum(grid[x][z][1] for x in rows)) for z in range(coarse)]
                _, c = cut(columns)
                for zs in (range(c), range(c, coarse)):
                    value |= {(x, z): leaf([columns[k] for k in zs]) for x in rows for z in zs}
            f = [v + rate * value[x, z] for v, x, z in zip(f, fold[i], fold[j], strict=True)]
    return [1 / (1 + math.exp(-v)) for v in f]


def test_gam_against_plain_loops():
    rng = np.random.default_rng(3)
    stats = np.round(rng.random((70, len(quality_gam.NAMES))) * 4, 1)
    stats[:, 2] = 1.0  # a statistic that says nothing
    y = ((stats[:, 0] > 2) ^ (stats[:, 1] > 1.5) | (rng.random(70) < 0.1)).astype(float)
    options = dict(bins=7, rounds=6, rate=0.3, pairs=2, coarse=3, reg=1.5)
    model = quality_gam.fit(stats, y, **options)
    assert np.allclose(model.score(stats), plain_boosting(stats.tolist(), y.tolist(), **options))
    value = [model.base + sum(model.singles[k][int(np.searchsorted(model.cuts[k], row[k], "right"))] for k in range(len(row))) for row in stats]
    for i, j, ci, cj, table in model.pairs:
        for r, row in enumerate(stats):
            value[r] += table[ci[int(np.searchsorted(model.cuts[i], row[i], "right"))], cj[int(np.searchsorted(model.cuts[j], row[j], "right"))]]
    assert np.allclose(model.score(stats), 1 / (1 + np.exp(-np.array(value))))


# what round 2 left behind


def test_exact_dedup_leaves_no_tables_and_no_settings(spark):
    folder = checkpoint_folder(spark).removeprefix("file:")
    shown = {k: spark.conf.get(k, None) for k in exact_dedup.RUNTIME}
    rows = exact_dedup.exact_duplicates(awkward(spark)).collect()
    assert rows and not [d for d, _, _ in os.walk(folder) if "/pairs-" in d or "/odd-" in d]
    assert {k: spark.conf.get(k, None) for k in exact_dedup.RUNTIME} == shown


def test_keys_named_like_results(spark):
    docs = awkward(spark)
    assert "kept_key" in exact_dedup.exact_duplicates(docs.withColumnRenamed("doc_id", "kept"), key="kept").columns
    assert mixing.mix(docs.withColumnRenamed("doc_id", "size"), key="size").select("size_key", "size").count() == docs.count()
    found = quality_rules.apply_rules(docs.withColumnRenamed("doc_id", "n_words"), key="n_words")
    assert found.select("n_words_key", "n_words", "kept").count() == docs.count()
