import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from docloom.llm import bpe, exact_dedup, langid, mixing, quality_gam, quality_rules, sharding, simhash, toxicity, wordpiece
from docloom.llm._common import blocks, prepare
from docloom.llm.components import connected_components
from tests.llm.helpers import DOCS, PROSE, awkward, empty, named, rows

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


# 1 language


def test_langid_learns_families_and_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    assert set(model.families) == {"germanic", "romance"} and set(model.pair) == {("de", "en"), ("es", "fr")}
    got = langid.identify(docs, model, keep=["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_langid_edges(spark):
    docs = awkward(spark)
    model = langid.train(docs)
    got = langid.identify(docs, model)
    assert got.count() == len(rows()) and [c for c in got.columns if c.lower() == "score"] == ["score"]
    by = {r.text: (r.lang_pred, r.score) for r in got.collect()}
    assert by[None] == by[""] == by["1234 !!! ###"] == ("und", 0.0)
    assert by[PROSE][0] == "en"
    assert langid.identify(empty(spark), model).count() == 0
    untaught = langid.train(empty(spark))
    assert {r.lang_pred for r in langid.identify(docs, untaught).collect()} == {"und"}


def test_langid_blocks_agree_with_whole_text():
    assert np.allclose(langid.features(PROSE.encode()), langid.features(("  " + PROSE.upper() + "\n\n").encode()))
    assert langid.features("123 ٠".encode()) is None


def test_langid_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"{w}ä" for w in (PROSE.split() * 50)).encode()
    whole = langid.features(text)
    real = langid.blocks
    monkeypatch.setattr(langid, "blocks", lambda data, most: real(data, 97))
    assert np.allclose(whole, langid.features(text), atol=1e-6)


def test_langid_features_equal_brute_force():
    text = "Der Größe nach, 12 mal: ça va?"
    s = " " + re.sub("[^a-zß-ÿ]+", " ", text.lower()).strip() + " "
    total = np.zeros(langid.DIM)
    for n in range(1, 5):
        for i in range(len(s) - n + 1):
            gram = 0
            for k, c in enumerate(s[i : i + n]):
                gram = ord(c) if k == 0 else (gram * 0x100000001B3 + ord(c)) % (1 << 64)
            total[((gram * 0x9E3779B97F4A7C15 + n) % (1 << 64) >> 40) % langid.DIM] += 1
    assert np.allclose(langid.features(text.encode()), np.sqrt(total) / np.linalg.norm(np.sqrt(total)), atol=1e-6)


def test_langid_svm_is_near_the_optimum():
    """The dual's steps against plain gradient descent on the same squared hinge loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 * rng.normal(size=60) > 0, 1, -1)
    sparse = langid.Sparse.of([(np.arange(5, dtype=np.int32), r) for r in x])
    w, b, _ = langid.linear_svm(sparse, np.arange(60), y, dim=5, reg=1e-2, passes=400)
    c = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum())) / (1e-2 * 60) / 1000
    a = np.column_stack([x, np.ones(60)])
    loss = lambda v: v @ v / 2 + (c * np.maximum(0, 1 - y * (a @ v)) ** 2).sum()
    best = np.zeros(6)
    for _ in range(20_000):
        best -= 0.05 * (best - 2 * a.T @ (c * y * np.maximum(0, 1 - y * (a @ best))))
    assert loss(np.r_[w, b]) <= loss(best) * 1.001


def test_langid_learns_every_language(spark):
    """More languages than rows for them: each keeps one at least, and the sum is bounded."""
    text = lambda i: " ".join("".join(random.Random(100 * i + j).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for j in range(40))
    docs = spark.createDataFrame([(10 * i + k, text(i), f"x{i:03}", "s", 0, "x", "y") for i in range(30) for k in range(4)], DOCS)
    model = langid.train(docs, rows=40)
    assert len(model.families) == 30
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, model).collect())


def test_blocks_never_cut_words():
    rng = random.Random(2)
    for _ in range(200):
        data = "".join(rng.choices("ab\t\n\v\f\r é", k=rng.randint(0, 120))).encode()
        parts = list(blocks(data, rng.randint(1, 20)))
        assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


# 2 toxicity


def test_toxicity_folds_and_spares():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " trash ": 3.0, " lowei": 2.0, " loser ": 3.0}, ("trash can",))
    a = lexicon.automaton()
    for bad in ("you idiot.", "you 1d10t", "yоu ІDIOT", "i.d IDIOT!", "lo5er", "10ser", "loweischaft"):
        assert toxicity.hits(toxicity.fold(bad), a)[0] == 1, bad
    for good in ("put it in the trash can", "idiotic", "trashy", "halowei", ""):
        assert toxicity.hits(toxicity.fold(good), a)[0] == 0, good
    assert toxicity.hits(toxicity.fold("trash in the trash can"), a)[0] == 1


def brute_hits(folded, lexicon):
    places = {}
    for e, w in lexicon.entries.items():
        for i in range(len(folded)):
            if folded.startswith(e, i):
                places[i] = max(w, places.get(i, 0))
    spared = [(m.start(), m.start() + len(p) + 1) for p in lexicon.exceptions for m in re.finditer(f"(?=( {p} ))", folded)]
    left = {i: w for i, w in places.items() if not any(a <= i < b for a, b in spared)}
    return len(left), sum(left.values())


def test_toxicity_hits_equal_brute_force_across_parts(monkeypatch):
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({" aa ": 3.0, " ab": 2.0, " abc": 2.5, " cab ": 1.0}, ("aa bb", "bb cab aa", "abc"))
    a = lexicon.automaton()
    for most in (4, 9, 1 << 20):
        monkeypatch.setattr(toxicity, "BLOCK", most)
        for _ in range(150):
            text = " ".join(rng.choices(["aa", "bb", "abc", "abcd", "cab", "x", "ab"], k=rng.randint(0, 14))) + rng.choice(["", " ", "\n"])
            assert toxicity.hits(toxicity.pieces(text.encode()), a) == pytest.approx(brute_hits(toxicity.fold(text), lexicon))


def test_toxicity_long_texts_take_time_in_proportion():
    a = toxicity.Lexicon({" trash ": 3.0}, ("trash can",)).automaton()
    began = time.perf_counter()
    assert toxicity.measures(b"trash can " * 200_000, a) == (0.0, 0.0)
    assert time.perf_counter() - began < 10


def test_toxicity_exceptions_are_words_that_an_entry_catches(spark, sf):
    lexicon = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    built_in = {toxicity.fold(x).strip() for x in toxicity.EXCEPTIONS}
    for phrase in set(lexicon.exceptions) - built_in:
        assert any(f" {phrase} ".startswith(e) for e in lexicon.entries)


def test_toxicity_sample_does_not_depend_on_order(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.train(docs, labels) == toxicity.train(docs.repartition(7), labels.repartition(3))


def test_toxicity_learns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.train(docs, labels)
    got = toxicity.score(docs, lexicon, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    assert got[got.toxic == 0].predicted.mean() < 0.05


def test_toxicity_edges(spark):
    lexicon = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score(awkward(spark), lexicon).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.score(empty(spark), lexicon).count() == 0
    bad = toxicity.score(named(spark, ["you worthless pathetic idiot, you stupid moron", PROSE]), lexicon).orderBy("doc_id").collect()
    assert bad[0].score > bad[1].score and bad[0].predicted == 1


# 3 sharding


def brute_shards(sizes, limit):
    """(key, size) to depth and prefix, by splitting buckets one by one."""
    h = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k, _ in sizes}
    out, open_ = {}, [(0, 0)]
    while open_:
        depth, prefix = open_.pop()
        inside = [(k, n) for k, n in sizes if h[k] >> (60 - depth) == prefix]
        if sum(n for _, n in inside) <= limit or len(inside) == 1:
            out |= {k: (depth, prefix) for k, _ in inside}
        else:
            open_ += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    return out


def test_sharding_matches_brute_force(spark):
    random.seed(4)
    texts = ["x" * random.choice([0, 10, 100, 900, 1500]) for _ in range(300)]
    got = {r.doc_id: (r.depth, r.prefix) for r in sharding.assign(named(spark, texts), limit=1000).collect()}
    assert got == brute_shards([(i, len(t)) for i, t in enumerate(texts, 1)], 1000)


def test_sharding_goes_deeper_where_the_first_look_is_not_enough(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPARE", 0)
    monkeypatch.setattr(sharding, "STEP", 1)
    texts = ["x" * 100 for _ in range(60)]
    got = {r.doc_id: (r.depth, r.prefix) for r in sharding.assign(named(spark, texts), limit=250).collect()}
    assert got == brute_shards([(i, 100) for i in range(1, 61)], 250)


def test_sharding_edges(spark):
    got = sharding.assign(awkward(spark), limit=100_000).collect()
    assert len(got) == len(rows())
    sums = Counter()
    for r in got:
        sums[r.shard_id] += r.n_bytes
    big = max(len((t or "").encode()) for _, t, *_ in rows())
    assert all(n <= 100_000 or n == big for n in sums.values())
    assert sharding.assign(empty(spark)).count() == 0


def test_sharding_repeated_rows_overflow_to_pages(spark):
    docs = spark.createDataFrame([(1, "x" * 40, "en", "s", 0, "x", "y")] * 10 + [(2, "y" * 30, "en", "s", 0, "x", "y")], DOCS)
    got = sharding.assign(docs, limit=100).collect()
    sums = Counter()
    for r in got:
        sums[r.shard_id] += r.n_bytes
    assert len(got) == 11 and max(sums.values()) <= 100


def test_write_shards(spark, tmp_path):
    docs = named(spark, ["x" * 50 for _ in range(40)])
    sharding.write_shards(docs, str(tmp_path / "out"), limit=500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.groupBy("shard_id").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 500


def test_write_shards_keeps_to_the_limit_and_to_names(spark, tmp_path):
    same = [(1, "x" * 40, "en", "s", 0, "x", "y")] * 10 + [(1, "z" * 40, "en", "s", 0, "x", "y")] * 3 + [(2, "y" * 30, "en", "s", 0, "x", "y"), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(same, DOCS).withColumn("shard_id", F.lit("mine")).withColumn("__k", F.lit(1)).withColumn("n_bytes", F.lit("a"))
    name = sharding.write_shards(docs, str(tmp_path / "out"), limit=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_id_1" and sorted(back.columns) == sorted([*docs.columns, name])
    sums = {r[0]: r[1] for r in back.groupBy(name).agg(F.sum(F.octet_length("text"))).collect()}
    assert max(v or 0 for v in sums.values()) <= 100
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), limit=100)


# 4 token counts


def greedy(text, pieces):
    text, n, at = wordpiece.BEGIN + text, 0, 0
    while at < len(text):
        for end in range(len(text), at, -1):
            if text[at:end] in pieces:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_wordpiece_matches_greedy():
    random.seed(2)
    for _ in range(60):
        pieces = {wordpiece.BEGIN, *("".join(random.choices("abc", k=random.randint(1, 4))) for _ in range(8)), *(wordpiece.BEGIN + "".join(random.choices("abc", k=2)) for _ in range(4))}
        a = wordpiece.Automaton(sorted(pieces))
        for _ in range(60):
            w = "".join(random.choices("abcd", weights=[5, 5, 5, 1], k=random.randint(1, 12)))
            assert a.count(w) == greedy(w, pieces), (w, pieces)


def test_wordpiece_counts_documents(spark):
    pieces = wordpiece.load_vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    got = wordpiece.count_tokens(awkward(spark), pieces).collect()
    known = set(pieces)
    for r in got:
        w = Counter(words(r.text))
        assert (r.n_words, r.n_tokens) == (sum(w.values()), sum(n * greedy(x, known) for x, n in w.items()))
    assert wordpiece.count_tokens(empty(spark), pieces).count() == 0


def test_wordpiece_counts_very_long_texts(spark):
    pieces = wordpiece.load_vocabulary(spark, public_tokenizers.path("piece_bpe_32k.model"))
    known = set(pieces)
    many, long = "\t".join(f"w{i % 10}x" for i in range(1_250_000)), "ab" * 2_500_000
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_tokens(named(spark, [many, long]), pieces).collect()}
    assert len(many) > 4 * wordpiece.BLOCK / 4 and got[1] == (1_250_000, 125_000 * sum(greedy(f"w{i}x", known) for i in range(10)))
    start = greedy("ab" * 1000, known)
    assert got[2] == (1, start + (len(long) - 2000) // 2000 * (greedy("ab" * 2000, known) - start))


# 5 mixing


def optimum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {x + n * k for x in sums for k in range(c + 1)}
    return min(abs(x - budget) for x in sums)


def test_fit_budget_against_the_optimum():
    random.seed(6)
    worse = 0
    for _ in range(400):
        lengths = sorted(random.sample(range(1, 30), random.randint(1, 6)))
        counts = [random.randint(1, 6) for _ in lengths]
        budget = random.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 5)
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        gap = abs(sum(n * t for n, t in zip(lengths, take)) - budget)
        worse += gap > optimum(lengths, counts, budget)  # the proportional part may stand in the way of the last word
        assert gap <= optimum(lengths, counts, budget) + min(lengths)
        rest = random.randint(1, 60)
        got = mixing._subset(lengths, counts, rest)
        assert abs(sum(n * t for n, t in zip(lengths, got)) - rest) == optimum(lengths, counts, rest)
    assert worse < 40
    assert sum(n * t for n, t in zip([1, 7, 50], mixing.fit_budget([1, 7, 50], [100, 100, 100], 3333))) == 3333
    assert mixing.fit_budget([10], [5], 4) == [0] and mixing.fit_budget([10], [5], 6) == [1]


def test_fit_budget_is_even_over_lengths_at_any_size():
    x = np.maximum(1, np.random.default_rng(0).lognormal(5.5, 1.1, 400_000).astype(int))
    u, c = (list(map(int, v)) for v in np.unique(x, return_counts=True))
    budget = int(x.sum() * 0.37)
    take = mixing.fit_budget(u, c, budget)
    assert sum(n * k for n, k in zip(u, take)) == budget
    for part in np.array_split(np.arange(len(u)), 10):
        assert abs(sum(take[i] for i in part) / sum(c[i] for i in part) - 0.37) < 0.03


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if level * w[s] > most * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_fit_budget_takes_a_long_document_if_that_is_nearer():
    assert mixing.fit_budget([200_000], [1], 180_000) == [1] and mixing.fit_budget([200_000], [1], 90_000) == [0]
    assert mixing.fit_budget([200_000, 300_000], [1, 1], 120_000) == [1, 0]
    assert mixing.fit_budget([10_000_000, 7_000_001], [3, 3], 20_000_001) == [2, 0]


def test_mixing(spark):
    random.seed(1)
    data = [(i, " ".join(["w"] * random.choice([1, 2, 3, 5, 8, 40, 41])), "en", random.choice(["a", "b", "ä", "c", "d", None]), 0, "x", "y") for i in range(800)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).toPandas()
    sizes = Counter()
    for _, t, _, s, *_ in data:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g["source_size"].unique() == [sizes[s]] and abs(g["target"].iloc[0] - want[s]) < 1e-6
        assert abs(g["taken"].sum() - want[s]) <= 1
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(spark.createDataFrame(data, DOCS).repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def test_mixing_slices_agree(spark, monkeypatch):
    """A length with many documents: slices give the same count as one ordered list."""
    docs = named(spark, ["one two three"] * 500)
    monkeypatch.setattr(mixing, "SLICE", 16)
    got = mixing.mix(docs, weights=(1,), share=1.25).toPandas()
    assert got.taken.sum() == 1875 and set(got.times) == {1, 2}


def test_mixing_edges(spark):
    got = mixing.mix(awkward(spark)).toPandas()
    assert len(got) == len(rows()) and (got.taken <= 2 * got["size"]).all()
    assert mixing.mix(empty(spark)).count() == 0
    nothing = mixing.mix(named(spark, [None, "", " "])).toPandas()
    assert (nothing.target == 0).all() and (nothing.taken == 0).all()
    docs = awkward(spark)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    assert whole.count() == int(mixing.mix(docs).agg(F.sum("times")).first()[0])


# 6 BPE


@pytest.fixture(scope="module")
def multi(spark):
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(multi, monkeypatch):
    ranks, library = multi
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    random.seed(3)
    parts = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "é", "é", "🙂", "の", "1", "23", "'s", "'S", "the", "aaaa", " ", "​", "٣", "\t", "###", "x" * 50, "日本語", "ß"]
    for _ in range(3000):
        s = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        assert list(codec.encode(s.encode())) == library.encode_ordinary(s), s
    monkeypatch.setattr(bpe, "LONG", 50)
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "NEIGHBOURS", 20)
    small = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for s in (PROSE * 5, "a" * 3000, " " * 300, "ab" * 700, "x " * 99):
        assert list(small.encode(s.encode())) == library.encode_ordinary(s)
        assert small.decode(small.encode(s.encode())) == s.encode()


def test_bpe_with_another_vocabulary():
    """A toy vocabulary in which a longest match misleads, so that the encoder has to step back."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"cd": 258, b"abc": 259, b"bcd": 260}
    library = tiktoken.Encoding("toy", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, r"[\s\S]+")
    random.seed(9)
    for _ in range(2000):
        s = "".join(random.choices("abcd", k=random.randint(1, 14)))
        assert list(codec.encode(s.encode())) == library.encode_ordinary(s), s


def test_bpe_longest_tokens_where_they_are_asked_for(multi):
    """Longest tokens are found from any place on, each place once; the end of a piece never makes all matches be listed."""
    codec = bpe.Codec(multi[0], public_tokenizers.PATTERN)
    tokens = {codec.bytes_of[r] for r in codec.parts}
    random.seed(7)
    for _ in range(300):
        data = "".join(random.choice(["tion", "th", "é", "の", " ", "x", "ing", "\n", "0"]) for _ in range(random.randint(1, 12))).encode()
        image, longest = data.decode("latin-1"), [-1] * len(data)
        for at in random.sample(range(len(data)), len(data)):
            want = next(k for k in range(len(data), 0, -1) if data[at : at + k] in tokens)
            assert codec.bytes_of[longest[at] if longest[at] >= 0 else codec._ahead(image, at, longest)] == data[at : at + want]
        assert -1 not in longest
    toy = bpe.Codec({b"a": 0, b"b": 1}, r"[\s\S]+")
    for lacking in ("abc", "cab", "acb"):
        with pytest.raises(ValueError):
            toy.encode_piece(lacking)


def test_bpe_documents(spark, multi):
    ranks, library = multi
    tokens = bpe.encode(awkward(spark), ranks, public_tokenizers.PATTERN)
    apart = {(r.doc_id, r.text): r.decoded for r in bpe.decode(tokens, ranks).collect()}
    got = bpe.encode(awkward(spark), ranks, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert len(got) == len(rows())
    for r in got:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() == bytes(apart[r.doc_id, r.text])
    one = bpe.digests(bpe.encode(named(spark, ["the dog"]), ranks, public_tokenizers.PATTERN, decoded="decoded"), "doc_id").first()
    ids = ",".join(map(str, library.encode_ordinary("the dog")))
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"the dog").hexdigest())
    assert bpe.encode(empty(spark), ranks, public_tokenizers.PATTERN).count() == 0


# 7 SimHash


def brute_fingerprint(text, width=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, threshold):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= threshold:
                root[find(a)] = find(b)
    return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for text in (PROSE, "One TWO three", "", None, "a b c d", "É é a b c d e f g h i j k l m n o p"):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("threshold,many,homes", [(4, False, 1 << 16), (4, True, 1 << 16), (4, False, 3), (4, True, 2), (3, False, 100), (0, False, 100), (6, False, 100)])
def test_links_connect_what_brute_force_connects(spark, threshold, many, homes):
    rng = random.Random(threshold + many)
    fps = set()
    for _ in range(25):  # chains and clouds around centres, and strangers
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randint(0, 12)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, threshold + 2)))
            fps.add(f)
    fps |= {0, (1 << 64) - 1, 0b1111, 0b11111}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    found = simhash.links(frame, threshold, simhash.bands(threshold, many), homes).collect()
    u = lambda x: x & ((1 << 64) - 1)
    assert all((u(r.a) ^ u(r.b)).bit_count() <= 64 for r in found)
    groups = connected_components(spark.createDataFrame(found, "a long, b long") if found else spark.createDataFrame([], "a long, b long")).collect()
    parts = {}
    for r in groups:
        parts.setdefault(r.root, set()).add(u(r.node))
    linked = {frozenset(p) for p in parts.values()}
    assert linked == {c for c in brute_components(fps, threshold) if len(c) > 1}


def test_near_duplicates(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(rows())
    want = {t: brute_fingerprint(t) for _, t, *_ in rows()}
    u = {(r.doc_id, r.fp & ((1 << 64) - 1)) for r in got}
    assert all((i, want[t]) in u for i, t, *_ in rows() if t in want)
    by = {}
    for r in got:
        by.setdefault(r.component_id, set()).add(r.doc_id)
    assert {4, 5, 6} <= by[4]  # no words: fingerprint 0
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.drop_near_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({r.component_id for r in got}) and 4 in ids and 5 not in ids


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


# 8 quality


def test_gam_learns_single_and_paired_effects():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_gam.NAMES)))
    y = ((x[:, 0] > 0.6) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000], rounds=60)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (0, 1) in {(i, j) for i, j, *_ in model.pairs} or (1, 2) in {(i, j) for i, j, *_ in model.pairs}


def test_gam_on_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.train(docs, labels)
    got = quality_gam.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_gam_edges(spark):
    docs = awkward(spark)
    model = quality_gam.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = quality_gam.score(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_gam.score(empty(spark), model).count() == 0
    assert [c for c in quality_gam.score(docs, model).columns if c.lower() == "score"] == ["score"]
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_gam.train(docs, one).base > 0
    assert quality_gam.statistics(None) == quality_gam.statistics(b" \n ") == [0.0] * len(quality_gam.NAMES)


# 9 exact duplicates


def test_fingerprints_compose():
    rng = random.Random(5)
    for _ in range(50):
        data = rng.randbytes(rng.randint(0, 500))
        assert len({exact_dedup.composed(data, c) for c in (1, 7, 64, 1000)}) == 1
        cut = rng.randint(0, len(data))
        assert exact_dedup.combine(exact_dedup.composed(data[:cut]), exact_dedup.composed(data[cut:]), len(data) - cut) == exact_dedup.composed(data)


def is_prime(n):
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    return all(pow(a, d, n) == 1 or any(pow(a, d << k, n) == n - 1 for k in range(s)) for a in range(2, 60))


def test_fingerprints_weigh_every_place():
    """256 has a prime order of 126 bits, so no two places weigh the same; permuted records and swapped bytes differ."""
    p = exact_dedup.PRIME
    assert is_prime(p) and is_prime((p - 1) // 2) and pow(256, (p - 1) // 2, p) == 1 != pow(256, 2, p)
    rng = random.Random(9)
    a, b, c = (rng.randbytes(127) for _ in range(3))
    assert len({exact_dedup.composed(b"".join(x)) for x in ((a, b, c), (b, a, c), (c, b, a), (a, c, b), (b, c, a), (c, a, b))}) == 6
    data = bytearray(rng.randbytes(4000))
    data[5], data[132] = 1, 2
    other = bytearray(data)
    other[5], other[132] = 2, 1
    assert exact_dedup.composed(bytes(data)) != exact_dedup.composed(bytes(other))


@pytest.mark.parametrize("chunk,huge", [(1 << 20, 64 << 20), (64, 128)])
def test_exact_duplicates(spark, chunk, huge):
    got = exact_dedup.exact_duplicates(awkward(spark), chunk=chunk, huge=huge).collect()
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows())
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {keep}
        assert [r.doc_id for r in mine if r.kept] == [keep]
    kept = exact_dedup.drop_exact_duplicates(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_duplicates(empty(spark), chunk=chunk, huge=huge).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """Every text has the same fingerprint: the comparison alone tells them apart, whatever the digest."""
    docs = named(spark, ["aa", "bb", "aa", "cc", "cc", "d"])
    monkeypatch.setattr(exact_dedup, "_packed", lambda v: b"same")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, chunk=1).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}
    again = named(spark, ["aa", "bb", "aa", "bb"]).unionByName(named(spark, ["aa", "bb", "aa", "bb"]))
    got = exact_dedup.exact_duplicates(again, chunk=1).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted(
        [(1, 3, 4, False)] * 2 + [(2, 4, 4, False)] * 2 + [(3, 3, 4, False), (3, 3, 4, True), (4, 4, 4, False), (4, 4, 4, True)]
    )


def test_rows_survive_columns_of_any_name(spark):
    docs = awkward(spark)
    for c in ("n", "__k", "__tk", "__row", "_0", "size", "target", "times", "h", "len", "sha", "keep", "copy", "band", "guest", "names"):
        docs = docs.withColumn(c, F.lit(c))
    for made in (exact_dedup.drop_exact_duplicates(docs), simhash.drop_near_duplicates(docs), mixing.mixed(docs)):
        got = made.collect()
        assert made.columns == docs.columns and got and all(r["n"] == "n" and r["__k"] == "__k" and r["_0"] == "_0" for r in got)
    for made in (exact_dedup.exact_duplicates(docs), simhash.near_duplicates(docs), mixing.mix(docs), sharding.assign(docs), quality_rules.apply_rules(docs)):
        assert made.count() == len(rows())
    for name in ("n", "len", "size", "fp", "h", "keep"):  # the key itself may have such a name
        keyed = awkward(spark).select(F.col("doc_id").alias(name), "text", "source")
        assert exact_dedup.drop_exact_duplicates(keyed, key=name).count() == exact_dedup.drop_exact_duplicates(awkward(spark)).count()
        if name != "fp":
            assert simhash.drop_near_duplicates(keyed, key=name).columns == keyed.columns
        assert mixing.mixed(keyed, key=name).columns == keyed.columns


def test_a_folder_of_the_driver_is_never_used_on_a_cluster():
    class Elsewhere:
        master = "spark://elsewhere"
        _docloom_shipped = True

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()

        class conf:
            get = staticmethod(lambda key, default="10000": None if "checkpoint" in key else default)
            set = staticmethod(lambda key, value: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        prepare(Session())


# 10 rules


def brute_statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_rules_statistics(spark):
    random.seed(8)
    texts = [" ".join(random.choices("ab", k=random.randint(0, 40))) for _ in range(120)]
    texts += ["\n".join(random.choices(["x y", "", " ", "x  y", "# |z"], k=9)) for _ in range(30)] + [None, "", PROSE + " " + PROSE, "a b c d e f g h a b c d e f g h"]
    docs = named(spark, texts)
    got = docs.select("text", *[c.alias(n) for n, c in quality_rules.statistics(F.col("text")).items()]).collect()
    for r in got:
        assert tuple(r)[1:] == brute_statistics(r.text), r.text


def test_rules_long_texts_are_measured_as_rows(spark, monkeypatch):
    """Every text by the way of long ones, cut into parts of a few characters: the same statistics."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "c", "#d", "é|", "long" * 5], k=rng.randint(1, 60))).replace(" c ", rng.choice([" \n", "\t", "\n\n"])) for _ in range(12)] + [PROSE * 3, " \n ", "x"]
    want = {r.doc_id: r for r in quality_rules.apply_rules(named(spark, texts)).collect()}
    monkeypatch.setattr(quality_rules, "LONG", 1)
    monkeypatch.setattr(quality_rules, "PART", 7)
    got = quality_rules.apply_rules(named(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [r[c] for c in quality_rules.STATISTICS] == [want[r.doc_id][c] for c in quality_rules.STATISTICS] and r.kept == want[r.doc_id].kept


def test_rules_reject_outliers(spark):
    random.seed(3)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(random.choices(vocabulary, k=random.randint(60, 400))) for _ in range(300)]
    junk = [" ".join(w + "$$$" for w in random.choices(vocabulary, k=150)) for _ in range(20)]
    got = quality_rules.apply_rules(named(spark, clean + junk)).toPandas().set_index("doc_id")
    assert got.loc[1:300].kept.mean() > 0.99 and not got.loc[301:320].kept.any() and not got.base_failed.any()


@pytest.mark.parametrize("share,change", [(1 / 3, 0), (1 / 3, 1), (0.6, 0)])
def test_rules_reject_many_copies_of_one_junk_text(spark, share, change):
    """Copies, or near copies that differ in a few words, of a symbol-ridden text that passes the base rules."""
    random.seed(5)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(random.choices(vocabulary, k=random.randint(60, 400))) for _ in range(240)]
    junk = [w + "$$$" for w in random.choices(vocabulary, k=150)]
    copies = [" ".join(junk + change * random.choices(vocabulary, k=random.randint(1, 5))) for _ in range(round(240 * share / (1 - share)))]
    got = quality_rules.apply_rules(named(spark, clean + copies)).toPandas().set_index("doc_id")
    assert not got.base_failed.any() and not got.loc[241:].kept.any() and got.loc[:240].kept.all()


def test_rules_judge_small_groups(spark):
    """A rare source by its language, a rare language by all rows, and a small table by itself."""
    random.seed(6)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(400)]

    def texts(n, sign):
        return [" ".join(w + sign for w in random.choices(vocabulary, k=random.randint(60, 400))) for _ in range(n)]

    # in "xx" signs are common, so that its rare source is normal there and would not be among all rows
    groups = [("en", "big", 90, ""), ("xx", "big", 40, "$$$"), ("xx", "rare", 9, "$$$"), ("en", "rare", 9, ""), ("en", "rare", 3, "$$$"), ("yy", None, 3, "$$$"), (None, "z", 3, "")]
    data = [(t, lang, source, n) for lang, source, n, sign in groups for t in texts(n, sign)]
    docs = spark.createDataFrame([(i, t, lang, source, 0, "x", "y") for i, (t, lang, source, _) in enumerate(data)], DOCS)
    got = quality_rules.apply_rules(docs).toPandas().set_index("doc_id")
    bad = {("en", "rare", 3), ("yy", None, 3)}
    assert len(got) == len(data) and not got.base_failed.any() and got.d2.notna().all()
    assert all(got.kept[i] == ((lang, source, n) not in bad) for i, (_, lang, source, n) in enumerate(data))
    small = quality_rules.apply_rules(named(spark, texts(20, "") + texts(4, "$$$"))).toPandas().set_index("doc_id")
    assert small.loc[1:20].kept.all() and not small.loc[21:].kept.any()


def test_rules_brute_force_mahalanobis(spark):
    """The last estimate's distance, computed with a matrix inverse."""
    names = list(quality_rules.VECTOR)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, len(names))) * 2
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{n} double" for n in names))
    m = quality_rules._moments(frame, names, 1.3)
    got = sorted(r.d2 for r in quality_rules._distance(frame, m, names, True).collect())
    scatter = np.cov(x.T, bias=True) * 1.3 + np.diag([quality_rules.VECTOR[n] ** 2 for n in names])
    want = sorted(np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(scatter), x - x.mean(0)))
    assert np.allclose(got, want)
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def test_rules_edges(spark):
    got = quality_rules.apply_rules(awkward(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.n_words < 20:
            assert r.base_failed and not r.kept
    assert quality_rules.apply_rules(empty(spark)).count() == 0
