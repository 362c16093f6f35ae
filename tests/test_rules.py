"""Rules that users see, case by case: linkage, titles, envelopes, citations, reconciliation, recognised pages."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docloom.operators import editions, evidence, graph, linkage, scans, views
from docloom.queries import QUERIES
from docloom.streaming import citations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, texts, column):
    """column(text) for each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


# complete linkage and titles


def sequential(edges):
    earlier = {}
    for a, b in edges:
        earlier.setdefault(b, set()).add(a)
        earlier.setdefault(a, set())
    homes, out = [], {}
    for node in sorted(earlier):
        home = next((h for h in homes if earlier[node].issuperset(h)), None)
        if home is None:
            homes.append(home := [])
        home.append(node)
        out[node] = home[0]
    return out


@pytest.mark.parametrize("local", [0, linkage.LOCAL])
def test_complete_linkage(spark, local):
    """Components by themselves: a dense and a sparse random graph, a clique, a star; in rounds and in one task each."""
    rng = random.Random(7)
    edges = [(a, b) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.7]
    edges += [(a, b) for a, b in itertools.combinations(range(100, 110), 2) if rng.random() < 0.25]
    edges += list(itertools.combinations(range(200, 230), 2)) + [(300, k) for k in range(301, 320)]
    got = linkage.complete_linkage(spark.createDataFrame(edges, "a long, b long"), local)
    assert {r.node: r.family for r in got.collect()} == sequential(edges)


def test_alike_titles_meet(spark):
    """Every pair with a likeness of 0.8 shares a key, over titles of all lengths; of those that are no such pairs most don't."""
    rng = random.Random(3)
    words, titles = ["router", "guide", "install", "manual", "switch", "user", "setup", "admin", "config", "port"], {"ab", "abc", "b", "zabc", "abcdefghijkl", "abcdefghijklm"}
    for _ in range(110):
        t = " ".join(rng.choice(words) + rng.choice(["", "s", str(rng.randint(1, 99))]) for _ in range(rng.randint(1, 7)))
        titles |= {t, t[: len(t) // 2] + rng.choice("xyz") + t[len(t) // 2 + 1 :], t + rng.choice([" a", "b", ""])}
    titles |= {"long " * 30 + f"{i}" for i in range(3)} | {"other words of some length " * 5 + f"{i}" for i in range(2)}
    ids = {f"d{i:04d}": t.strip() for i, t in enumerate(sorted(titles)) if t.strip()}
    keys = {}
    for r in linkage.title_keys(spark.createDataFrame(list(ids.items()), "doc_id string, title string")).collect():
        keys.setdefault(r.doc_id, set()).add(r.k)
    pairs = [(a, b) for a, b in itertools.combinations(sorted(ids), 2)]
    alike = {(a, b) for a, b in pairs if SequenceMatcher(None, ids[a], ids[b]).ratio() >= 0.8}
    assert len(alike) > 100 and not [(ids[a], ids[b]) for a, b in alike if not keys[a] & keys[b]]


@pytest.mark.parametrize("side", [5, linkage.SIDE if hasattr(linkage, "SIDE") else 0])
def test_near_titles(spark, side, monkeypatch):
    """Every pair with a likeness of 0.8 is there once, however titles are laid out and their characters counted; random letters give next to none."""
    rng = random.Random(8)
    some = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 30))) for _ in range(25)] + ["ÄÖ\U0001f600 title", "aa " * 80]
    titles = {*some, *(t + "s" for t in some), *(t[:-1] + "x" for t in some), *(t[3:] for t in some)} - {""}
    monkeypatch.setattr(linkage, "AT_ONCE", 7)
    got = [tuple(r) for r in linkage.near_titles(spark.createDataFrame([(t,) for t in titles], "title string"), side).collect()]
    alike = {(a, b) for a, b in itertools.combinations(sorted(titles), 2) if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.8}
    assert len(alike) > 30 and len(got) == len({*got}) and alike <= {*got}
    far = ["".join(rng.choice("ghijklmnopabcdef") for _ in range(32)) for _ in range(60)]
    assert len(linkage._near(sorted(far), sorted(far), True)) <= 2


def _manuals(spark, rows):
    """(doc_id, text) as documents with identity, and their distinct ones."""
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("filename", F.concat("doc_id", F.lit(".txt"))).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    return editions.identity(docs)


def test_one_title_of_many_products(spark):
    """Manuals of one title whose numbers and products differ don't meet; one that lacks a product, or supersedes another, does."""
    rows = [(f"d{i:03d}", f"# Manual\nDocument ID: M-{i}\nProduct: P{i}\n") for i in range(100)]
    profiles = editions._profiles(_manuals(spark, rows))[0]
    assert editions.compared(profiles).count() == 0
    rows = [("a", "# Manual\nProduct: P\n"), ("b", "# Manual\n"), ("c", "# Manual\nDocument ID: M 7\n"), ("d", "# Manual\nDocument ID: X\nSupersedes: m 7 of old\n"), ("e", "# Manual\nProduct: Q\n")]
    got = {(r.a, r.b): r.reason for r in editions.pairs(editions._profiles(_manuals(spark, rows))[0]).collect()}
    assert got == {p: "supersession" if p == ("c", "d") else "possible" for p in itertools.combinations("abcde", 2) if p != ("a", "e")}


def test_facts_are_told_once(spark):
    """Families come from facts that were written down, not from texts read again."""
    plan = editions.families(_manuals(spark, [(str(i), f"# Manual {i % 3}\nDocument ID: M-{i % 3}\n") for i in range(6)]))._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower()


@pytest.mark.parametrize("common", [2, 64])
def test_candidates_against_all_pairs(spark, monkeypatch, common):
    """Titles of shared sections, common or not: the same candidates as the rule over all pairs."""
    monkeypatch.setattr(editions, "COMMON", common)
    rng = random.Random(4)
    title = lambda: rng.choice(["Router guide", "Router guides", "Ruoter guide", "Switch", "Swtich", "x"]) + rng.choice(["", " 1", " 12"])
    rows = [(f"d{i:02d}", f"# {title()}\n" + rng.choice(["", f"Product: P{rng.randint(1, 2)}\n"]) + rng.choice(["", "", f"Document ID: M-{i}\n"]) + "## Setup\n## Safety\n" + f"## S{rng.randint(1, 3)}\n") for i in range(45)]
    docs = _manuals(spark, rows)
    got = sorted((r.a, r.b, r.confidence) for r in editions.candidates(docs).collect())
    p = editions._profiles(docs)[0]
    x, y = p.select(F.col("doc_id").alias("a"), F.col("d").alias("x")), p.select(F.col("doc_id").alias("b"), F.col("d").alias("y"))
    every = x.crossJoin(y).filter("a < b").withColumn("alike", editions._likeness("x.normalized_title", "y.normalized_title"))
    want = every.select("a", "b", editions.related(F.col("x"), F.col("y"), F.col("alike")).alias("r")).filter("r.confidence >= 0.5 and r.confidence < 0.9")
    assert len(got) > 20 and got == sorted((r.a, r.b, r.r.confidence) for r in want.collect())


def test_families_are_found_once_for_several_questions(spark, sf, monkeypatch):
    asked, plain = [], editions.complete_linkage
    monkeypatch.setattr(editions, "complete_linkage", lambda links: asked.append(1) or plain(links))
    assert QUERIES["l5_asked_editions"](spark, sf).count() > 0 and len(asked) == 1


def test_few_titles_are_compared(spark, sf, monkeypatch):
    """Documents that all share their sections: the pairs whose titles are compared are no more than five times the pairs found,
    and what is found is what all pairs give."""
    from docloom.queries.plans import _family_docs

    monkeypatch.setattr(editions, "COMMON", 8)
    profiles = editions._profiles(_family_docs(spark, sf))[0].persist()
    asked, found = editions.compared(profiles).filter("ask").count(), editions.pairs(profiles).collect()
    assert asked <= 5 * len(found)
    x, y = profiles.select(F.col("doc_id").alias("a"), F.col("d").alias("x")), profiles.select(F.col("doc_id").alias("b"), F.col("d").alias("y"))
    every = x.crossJoin(y).filter("a < b").withColumn("alike", editions._likeness("x.normalized_title", "y.normalized_title"))
    want = every.withColumn("r", editions.related(F.col("x"), F.col("y"), F.col("alike"))).select("a", "b", "r.confidence", "r.reason").filter("confidence > 0")
    assert sorted(map(tuple, found)) == sorted(map(tuple, want.collect()))


# answers


def test_reasoning(spark):
    long = "* Task: " + "x" * 200
    said = ["The user must log in first.\nWait ten seconds.", "* Wait, no\nyes", "* Constraint 1: short\n  * *Final check\nkept", long + "\nyes", "* Plan: a\nb\n* Did I miss it\n", None, ""]
    assert each(spark, said, evidence.without_reasoning) == ["The user must log in first.\nWait ten seconds.", "yes", "kept", long + "\nyes", "b", None, ""]


def test_envelopes(spark):
    cases = {
        "STATUS: answer\nIt is open.": ("answer", "It is open.", []), "Answer: STATUS: answer\nyes": ("answer", "yes", []), "<think>x\ny</think>\nSTATUS: answer\nyes": ("answer", "yes", []),
        "STATUS: answer": ("invalid", None, []), "STATUS: perhaps\nx": ("invalid", None, []), "So STATUS: answer\nx": ("invalid", None, []),
        "STATUS: insufficient_evidence\nbut I guess so": ("insufficient_evidence", None, []), "STATUS: clarification\nsite, platform,": ("clarification", None, ["site", "platform"]),
        '{"status": "insufficient_evidence"}': ("insufficient_evidence", None, []), '{"status": "answer", "answer": "two\nlines"}': ("answer", "two\nlines", []), '{"status": "answer", "answer": "x"': ("invalid", None, []),
        '{"answer": "x"}': ("invalid", None, []), '```json\n{"status": "clarification", "missing_details": ["site"]}\n```': ("clarification", None, ["site"]), "[1, 2]": ("invalid", None, []),
        "[E1] says so": ("plain", "[E1] says so", []), "status: none\nx": ("plain", "status: none\nx", []), "": ("plain", "", []),
    }
    got = each(spark, list(cases), evidence.envelope)
    assert {t: (g.status, g.answer, g.missing_details) for t, g in zip(cases, got, strict=True)} == cases
    assert each(spark, ["OUR_STATUS: answer\nyes", None], lambda t: evidence.envelope(t, "OUR_STATUS").status) == ["answer", "invalid"]


ANSWER = "a `[E1]` [t [E1]](x) ![i](y) [E1][E2] [E9] \\[E1] [E1], [2]\n````\n[E1]\n```\n[E1]\n````\nafter [E2]\n~~~\n[E1]\n```\n~~~~\nend [E1]"
RENDERED = "a `[E1]` [t [1]](x) ![i](y) [E1][E2] [E9] \\[E1] [1], [2]\n````\n[E1]\n```\n[E1]\n````\nafter [7]\n~~~\n[E1]\n```\n~~~~\nend [1]"


def test_citations_leave_code_and_links_alone(spark):
    text = ANSWER.replace("[t [E1]](x)", "[t](E1)")
    pieces = spark.createDataFrame([(1, 1, text[30:]), (1, 0, text[:30])], "answer_id long, n int, text string")
    ids = spark.createDataFrame([(1, "E1", 1), (1, "E2", 7)], "answer_id long, evidence_id string, number int")
    lines = views.rendered_citations(views.streamed_lines(pieces), ids).orderBy("line_no").collect()
    assert "\n".join(r.line for r in lines) == RENDERED.replace("[t [1]](x)", "[t](E1)")


def test_every_cut_of_a_stream_gives_the_same_lines():
    _, _, whole = citations.whole_lines("", "", ANSWER, True)
    for cut in range(len(ANSWER) + 1):
        rest, fence, first = citations.whole_lines("", "", ANSWER[:cut], False)
        assert [*first, *citations.whole_lines(rest, fence, ANSWER[cut:], True)[2]] == whole
    assert [code for _, code in whole] == [False, True, True, True, True, True, False, True, True, True, True, False]


def test_streamed_lines_in_micro_batches(spark, tmp_path):
    """Pieces in files, a batch for each; a piece that comes again; a restart from the checkpoint folder."""
    cuts = [0, 5, 61, 90, len(ANSWER)]
    rows = [(7, n, ANSWER[a:b], b == len(ANSWER)) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    schema, folder, got = "answer_id long, n long, text string, final boolean", str(tmp_path / "in"), []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = citations.stream_lines(stream).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()

    for part in ([rows[0]], [rows[1], rows[0]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    for part in ([rows[2]], [rows[3]], [rows[3]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    pieces = spark.createDataFrame([r[:3] for r in rows], "answer_id long, n long, text string")
    assert sorted(got) == sorted(map(tuple, views.streamed_lines(pieces).collect()))


def test_images_follow_markers_only(spark):
    text = "`[E1]` and [t](E1) \\[E1]\n\nhere [E1] more\nand on\n\nend [E2]"
    pieces = spark.createDataFrame([(1, 0, text)], "answer_id long, n int, text string")
    images = spark.createDataFrame([(1, "E1", "d", "1"), (1, "E2", "d", "1"), (1, "E2", "d", "2"), (1, "E3", "d", "3")], "answer_id long, evidence_id string, doc_id string, figure_id string")
    got = {r.line_no: r.images for r in views.placed_images(views.streamed_lines(pieces), images).collect()}
    assert got == {3: ["d/1"], 5: ["d/2"]}


# job states


def test_job_states_in_a_stream(spark, tmp_path):
    """Micro-batches with late, repeated and disordered events, and a restart: the last state of each job is that of the batch query
    over all events, and ended jobs are evicted when event time has passed their time to live."""
    from docloom.streaming import jobs

    folder, got = str(tmp_path / "in"), []
    batches = [
        [("a", "queued", 0), ("a", "parsing", 10), ("b", "queued", 5)], [("a", "complete", 20), ("a", "parsing", 10), ("b", "failed", 30), ("b", "graph", 30)],
        [("c", "queued", 400)], [("c", "parsing", 401), ("c", "queued", 400)], [("d", "queued", 500)], [("d", "queued", 501)],
    ]

    def feed(rows):
        df = spark.createDataFrame(rows, "job_id string, state string, s long").select("job_id", "state", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema("job_id string, state string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        out = jobs.job_states(stream, ttl_seconds=60, delay="10 seconds")
        sink = lambda df, n: got.extend((r.job_id, r.state, int(r.s), r.evicted) for r in df.withColumn("s", F.unix_timestamp("ts")).collect())
        out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()

    for rows in batches[:3]:
        feed(rows)
    run()
    for rows in batches[3:]:
        feed(rows)
    run()
    log = spark.createDataFrame([r for b in batches for r in b], "job_id string, state string, s long").select("job_id", "state", F.timestamp_seconds("s").alias("ts"))
    want = {r.job_id: r.state for r in jobs.latest_state(log).collect()}
    last = {}
    for job, state, ts, gone in got:
        if not gone:
            last[job] = (ts, state)
    assert {j: s for j, (_, s) in last.items()} == want == {"a": "complete", "b": "failed", "c": "parsing", "d": "queued"}
    assert sorted((j, s) for j, s, _, gone in got if gone) == [("a", "complete"), ("b", "failed")]
    assert len([g for g in got if g[0] == "b" and not g[3]]) == 2 and len(got) == len(set(got))


# reconciliation


def firms(rng, n):
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(n)]
    out = []
    for s in stems:
        t = rng.choice(stems)
        out += [s, f"{s} Corporation", f" {s.upper()} ", f"{s} {t} Group", f"{s}{rng.choice('aeiou')}", f"The {s} Corporation", f"{s} Marine Trading Company", f"{s[0]}MTC"]
    return out


def judge(a, b, kind):
    x, y = (" ".join(w for w in n.lower().split() if w not in ("the", "corporation")) for n in (a, b))
    if "boom" in (x, y):
        raise ConnectionError("gone")
    initials = lambda n: "".join(w[0] for w in n.split())
    if x == y:
        return {"is_same": True, "confidence": 0.95, "reason": "same words"}
    if SequenceMatcher(None, x, y).ratio() >= 0.85 or x == initials(y) or y == initials(x):
        return {"is_same": True, "confidence": 0.75, "reason": "near"}
    return {"is_same": False, "confidence": 1.0}


def test_reconciliation_against_all_pairs(spark, monkeypatch):
    """What a judge says about all pairs of a type and about those that meet in blocks: of the pairs that it would join, at least
    0.9 are proposed, with the status that it gives them."""
    monkeypatch.setattr(graph, "HOT", 12)
    names = [*firms(random.Random(1), 25), "boom", "Boom Ltd"]
    rows = [(f"n{i:03d}", n, "org") for i, n in enumerate(dict.fromkeys(names))] + [("x1", names[0], "person")]
    df = spark.createDataFrame(rows, "node string, name string, entity_type string")
    got = {(r.keep, r.remove): (r.status, r.confidence) for r in graph.reconciled(df, judge).collect()}
    want = {}
    for (a, x, s), (b, y, t) in itertools.combinations(rows, 2):
        if s != t or abs(len(x) - len(y)) > 0.7 * max(len(x), len(y)):
            continue
        if x.strip().lower() == y.strip().lower():
            want[a, b] = ("auto_merged", 1.0)
        elif "boom" not in (x, y):
            said = judge(x, y, s)
            if said["is_same"]:
                want[a, b] = ("auto_merged" if said["confidence"] >= 0.9 else "pending", said["confidence"])
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.9 * len(want) > 50
    met, all_pairs = graph.merge_candidates(df).count(), len(rows) * (len(rows) - 1) // 2
    assert met < 0.5 * all_pairs
    before = spark.createDataFrame([(k[0], k[1]) for k in list(got)[:10]], "keep string, remove string")
    again = {(r.keep, r.remove) for r in graph.reconciled(df, judge, before).collect()}
    assert again == set(got) - {(r.keep, r.remove) for r in before.collect()}


def test_common_endings_and_initials_are_no_pairs(spark):
    """Firms that share Ltd, an ending and their initials don't meet for that; the acronym of all of them meets each."""
    rng = random.Random(6)
    firms = sorted({"S" + "".join(rng.choice("ghijklmnop") for _ in range(8)) + "a Ltd" for _ in range(200)})
    rows = [(f"n{i:03d}", x, "t") for i, x in enumerate(firms)] + [("sl", "SL", "t"), ("same", firms[0].upper(), "t")]
    met = {(r.keep, r.remove): r.outcome for r in graph.merge_candidates(spark.createDataFrame(rows, "node string, name string, entity_type string"), most_difference=0.9).collect()}
    assert len(met) < 5 * len(rows) and met[("n000", "same")] == "auto"
    assert {(f"n{i:03d}", "sl") for i in range(len(firms))} <= {*met}


def test_all_candidates_of_a_type(spark, tmp_path):
    """Without blocks each two spellings of a type meet, those with nothing in common too; the query takes them all, for a judge or not."""
    rows = [("n1", " Acme", "org"), ("n2", "acme\t", "org"), ("n3", "Zyx 9", "org"), ("n4", "Zyx 9", "org"), ("n5", "--", "org"), ("n6", "Acme", "person"), ("n7", "x" * 40, "org"), ("n8", None, "org")]
    df = spark.createDataFrame(rows, "node string, name string, entity_type string")
    got = {(r.keep, r.remove): r.outcome for r in graph.merge_candidates(df, blocked=False).collect()}
    assert got == {("n1", "n2"): "auto", ("n1", "n3"): "judge", ("n2", "n3"): "judge", ("n1", "n5"): "judge", ("n2", "n5"): "judge", ("n3", "n5"): "judge"}
    assert {(r.node, r.keep) for r in graph.name_classes(df).collect() if r.node != r.keep} == {("n4", "n3")}
    parts = [(k, "Acme#1" if k < 8 else "Other", "T") for k in range(12)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    kinds = [r.outcome for r in QUERIES["m6_merge_candidates"](spark, str(tmp_path)).collect()]
    # Acme-1, Acme 1, ACME 1, acme.1; Other (twice), OTHER, other
    assert sorted(kinds) == ["auto"] * 4 + ["judge"] * 17


# recognised pages


def test_tokens(spark):
    garbled = {"ab": True, "": True, "x|y]z": True, "brrt": True, "b4rt": False, "Overlay Net Overlay Net": True, "a b cde": True, "TACACS": False, "a1": True}
    assert dict(zip(garbled, each(spark, list(garbled), scans.is_garbled), strict=True)) == garbled
    telling = {"https://a.b/c": True, "10.0.0.1/24": True, "db.corp": True, "TLS 443": True, "VRF": True, "XYZ": False, "ABCDE": True, "Okta": True, "Okta ee": False, "Core Router": True, "a word": False, "Firmware-2": True, "tiny": False}
    assert dict(zip(telling, each(spark, list(telling), scans.is_telling), strict=True)) == telling
    assert each(spark, ["see http://x.io/a, then 10.1.1.1 at\nCore Switch\nplain."], scans.tokens)[0][:2] == ["http://x.io/a", "10.1.1.1"]


def test_kept_tokens(spark):
    rows = [(1, "Core Router\n10.1.1.1\nVRF", "a core router at 10.1.1.1"), (2, "Accelerator\n", "acelerator, of course"), (3, None, None)]
    got = scans.kept_tokens(spark.createDataFrame(rows, "i int, text string, description string")).orderBy("i").collect()
    assert [r.kept for r in got] == [["VRF"], [], []]
    merged = lambda d, k: one(spark, scans.merged_description(F.lit(d), F.array(*map(F.lit, k)).cast("array<string>")))
    assert merged("[Figure]\nx\n[/Figure]", ["VRF"]) == "[Figure]\nx\nAlso visible (OCR identifiers not in description):\n- VRF\n[/Figure]" and merged("x", []) == "x"


def test_addresses_stand_number_by_number(spark):
    """The digits of an address in a host's number are no address; other signs between its numbers are."""
    rows = [(1, "10.0.5.7/24 by bgp", "BGP at https://h1005724.example.com/x"), (2, "10.0.5.7/24", "net 10-0-5-7 / 24"), (3, "10.0.5.7", "rack 10 057"), (4, "SD-WAN", "an SDWAN")]
    got = scans.kept_tokens(spark.createDataFrame(rows, "i int, text string, description string")).orderBy("i").collect()
    assert [r.kept for r in got] == [["10.0.5.7/24"], [], ["10.0.5.7"], []]


def test_box_regions_against_all_pairs(spark):
    rng = random.Random(5)
    boxes = [(d, 1, f"b{i:03d}", x := rng.uniform(0, 400), y := rng.uniform(0, 400), x + rng.uniform(1, 150), y + rng.uniform(1, 30), f"w{i}") for d in (1, 2) for i in range(40)]
    boxes += [(1, 1, "copy", *boxes[0][3:7], "again"), (1, 2, "b000", *boxes[0][3:7], "elsewhere")]
    got = scans.box_regions(spark.createDataFrame(boxes, "doc_id int, page int, box_id string, x0 double, top double, x1 double, bottom double, text string"), 6.0).collect()
    root = {b[:3]: b[2] for b in boxes}
    while True:
        before = dict(root)
        for a, b in itertools.combinations(boxes, 2):
            if a[:2] == b[:2] and max(b[3] - a[5], a[3] - b[5]) <= 6 and max(b[4] - a[6], a[4] - b[6]) <= 6:
                root[a[:3]] = root[b[:3]] = min(root[a[:3]], root[b[:3]])
        if root == before:
            break
    sizes = {}
    for (d, p, _), r in root.items():
        sizes[d, p, r] = sizes.get((d, p, r), 0) + 1
    assert {(r.doc_id, r.page, r.region): r.n for r in got} == sizes
    assert sorted(w for r in got for w in r.text.split()) == sorted(b[7] for b in boxes)


def test_lines_of_sheared_letters(spark):
    def letters(line, text, shear, advance=0.5, gaps=()):
        out, x = [], 0.0
        for i, c in enumerate(text):
            x += 4.0 if i in gaps else 0.0
            out.append((1, 1, line, i, c, text, True, 10.0, 0.0, shear, 10.0, x, advance, 10.0))
            x += 5.0
        return out

    rows = letters(1, "hotrod", 2.0, gaps=(3,)) + letters(2, "hotrod", 0.0, gaps=(3,)) + letters(3, "hotrod", 2.0, advance=None, gaps=(3,)) + letters(4, "ab", 2.0)
    schema = "doc_id int, page int, line_id int, place int, char string, text string, upright boolean, a double, b double, c double, d double, e double, advance double, size double"
    got = {r.line_id: r.text for r in scans.line_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "hot rod", 2: "hotrod", 3: "hotrod", 4: "ab"}


# relations of texts


def test_block_chunks_of_many_documents(spark):
    """Documents share a task's batches, and a document goes on from batch to batch: no group is made for each."""
    from docloom.functions import chunking

    rows = [(d, 1, i, "heading" if i == 0 else "paragraph", f"h{d}" if i == 0 else f"t{d} {i}", None, None) for i in (3, 1, 0, 2) for d in (*range(40), None)]
    schema = "doc_id int, page int, body_index int, kind string, text string, section_path array<string>, rows array<array<string>>"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = chunking.block_chunks(spark.createDataFrame(rows, schema).repartition(5), 400)
        said = {(r.doc_id, r.chunk_index): (r.section_path, r.start_char, r.locator, r.chunk) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = lambda d, k: sum(len(f"t{d} {i}") for i in range(1, k + 1))
    assert said == {(d, k): (f"h{d}", at(d, k), f"page 1, body block {k + 1}; h{d}", f"t{d} {k + 1}") for d in (*range(40), None) for k in range(3)}
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_block_chunks_and_statements_take_nulls(spark):
    from docloom.functions import chunking
    from docloom.plans import sqlguard

    schema = "doc_id int, page int, body_index int, kind string, text string, section_path array<string>, rows array<array<string>>"
    rows = [(1, None, 0, "paragraph", None, None, None), (1, None, 1, "heading", " Top ", None, None), (1, None, 2, "table", None, None, [["h"]]), (1, None, 3, "table", None, None, []), (1, None, 4, "paragraph", "a\n# In\nb", [], None), (1, None, 5, "paragraph", "c", None, None), (2, 3, 0, "figure", "x", None, None)]
    got = chunking.block_chunks(spark.createDataFrame(rows, schema), 400).orderBy("chunk_index").collect()
    assert [(r.chunk, r.section_path, r.page, r.locator) for r in got] == [("h", "Top", None, "body block 2; Top"), ("a\n", "Top", None, "body block 4; Top"), ("# In\nb", "In", None, "body block 4; In"), ("c", "In", None, "body block 5; In")]
    assert chunking.block_chunks(spark.createDataFrame([], schema), 400).count() == 0
    said = sqlguard.examined(spark.createDataFrame([(1, None), (2, "select 1")], "i int, text string"), allowed=[]).orderBy("i").collect()
    assert [(r.statement, r.ours, r.theirs) for r in said] == [("", False, False), ("select 1", True, True)]
