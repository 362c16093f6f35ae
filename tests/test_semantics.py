"""Operators on small inputs with expected values, refusals and invariants."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import chunking, text as X, vectors as V
from docloom.operators import access, aggregates, editions, evidence, graph, models, retrieval as R, sets, tabular
from docloom.plans import sqlguard
from docloom.queries import sqlsurface
from docloom.sources import readers
from docloom.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("cell,kind,number", [
    (None, "empty", None), ("", "empty", None), ("   ", "empty", None), ("5", "number", 5.0), ("3.14", "number", 3.14), ("86415", "number", 86415.0), ("$86,415", "number", 86415.0),
    ("12%", "number", 12.0), ("GS-12", "text", None), ("N/A", "text", None), ("nan", "number", None), ("inf", "number", None), ("-inf", "number", None), ("1_0", "number", 10.0), (".5", "number", 0.5), ("1e3", "number", 1000.0),
])
def test_cells(spark, cell, kind, number):
    assert one(spark, X.cell_kind, cell) == kind and one(spark, X.to_number, cell) == number


def test_column_names():
    assert X.column_names(["Unit Weight", None, "Unit-weight!", "7 days", "(%)", "unit weight"]) == ["unit_weight", "col_1", "unit_weight_1", "c_7_days", "col_4", "unit_weight_2"]


@pytest.mark.parametrize("query,pattern", [
    ("What contracts did the Army award on March 5th, 2024?", "contracts [ORG] award on [DATE]"), ("Show me $5 million awards by DHA", "[AMOUNT] awards [ORG]"), ("list document 12345 and 67890", "document [ID] and [ID]"), ("find 1234 5678", "[ID]"), ("", ""),
])
def test_query_pattern(spark, query, pattern):
    assert one(spark, X.query_pattern, query) == pattern


def test_versions_and_dates(spark):
    order = ["1", "1.0.1", "1.2", "1.2b", "1.10", "2"]
    df = spark.createDataFrame([(v,) for v in random.Random(1).sample(order, len(order))], "v string")
    assert [r.v for r in df.orderBy(X.version_key(F.col("v"))).collect()] == order
    assert one(spark, X.version_key, "draft") is None
    for said, iso in (("2024-03-05", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("Mar 5, 2024", "2024-03-05"), ("5 march 2024", "2024-03-05"), ("03/05/2024", None), ("soon", None)):
        assert one(spark, X.source_date, said) == iso


def test_roles_and_repairs(spark):
    assert one(spark, X.evidence_roles, "Warning: service impact.\n1. Configure the port") == ["prerequisites"][:0] + ["steps", "warnings"]
    assert one(spark, X.repair_record, "entity<|#|>Acme<|#|>a firm") == "entity<|#|>Acme<|#|>category<|#|>a firm"
    assert one(spark, X.repair_record, "relation<|#|>A<|#|>B<|#|>knows") == "relation<|#|>A<|#|>B<|#|>related<|#|>knows"
    assert one(spark, X.repair_record, "plain line") == "plain line"
    assert one(spark, lambda c: X.parse_model_json(c, "a int"), "<think>no</think>```json\n{\"a\": 3}\n```").a == 3


def test_strip_furniture(spark):
    page = "Skip to main content\n* [News](http://x)\n\nReal text stays here.\n---\n![pic](a.png)\nfollow on facebook.com/x"
    assert one(spark, X.strip_furniture, page) == "Real text stays here."
    assert one(spark, X.strip_furniture, "Share\n" * 200) == "Share\n" * 200


def test_url_decode(spark):
    assert one(spark, X.url_decode, "a%20b+c%2Bd") == "a b+c+d" and one(spark, X.url_decode, "100%") == "100%"


# access


def test_access(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["b", None]), (3, []), (4, ["ALL"]), (5, None), (6, ["a'b"])], "doc_id int, acl_groups array<string>")
    ids = lambda *g, **k: {r.doc_id for r in access.acl_filter(df, list(g), **k).collect()}
    assert ids() == set() and ids("ALL") == {1, 2, 3, 4, 5, 6} and ids("ALL", literal_all=True) == {4} and ids("ALL", strict=True) == set()
    assert ids("a") == {1} and ids("b") == {2} and ids("a'b") == {6} and ids("c") == set()
    assert ids("a") | ids("b") == ids("a", "b")
    rows = df.withColumn("chunk_size_tier", F.lit("small"))
    assert access.scope_filter(rows, ["ALL"], doc_ids=None).count() == 6 and access.scope_filter(rows, ["ALL"], doc_ids=[]).count() == 0 and access.scope_filter(rows, ["ALL"], doc_ids=[1, 2]).count() == 2
    assert one(spark, access.parse_groups, " a, b ,") == ["a", "b"] and one(spark, access.parse_groups, "") == ["ALL"] == one(spark, access.parse_groups, "a,ALL")


# ranking


def test_cosine_guards(spark):
    q = [1.0, 0.0]
    f = lambda v: one(spark, lambda c: V.cosine(c, V.literal(q)), v, "array<double>")
    assert f([2.0, 0.0]) == 1.0 and f([0.0, 0.0]) == 0.0 and f([1.0]) == 0.0 and f([float("nan"), 1.0]) == 0.0


def test_rrf_does_not_depend_on_the_order_of_lists(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id int, rank int")
    x, y = ({r.id: round(r.score, 9) for r in R.rrf(order).collect()} for order in ([a, b], [b, a]))
    assert x == y and x[2] == round(1 / 61 + 1 / 62, 9)


def test_cuts(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 0.5, 0.3, 0.29, 0.0])], "id int, score double")
    kept = R.relative_cut(rows)
    assert {r.id for r in kept.collect()} == {0, 1, 2} == {r.id for r in R.relative_cut(kept).collect()}
    low = rows.withColumn("score", F.col("score") - 2)
    assert R.relative_cut(low).count() == 5
    assert {r.relevance for r in R.normalised(low).collect()} == {0.0}


def test_rerank(spark):
    rows = spark.createDataFrame([(i, float(10 - i), i == 3) for i in range(6)], "id int, score double, synthetic boolean")
    got = R.rerank(rows, F.col("id").cast("double"), 3, synthetic="synthetic")
    assert [r.id for r in got.collect()] == [2, 3, 1, 0, 4, 5]  # the tail's best is 6: the head begins at 6.01
    assert {r.id: r.score for r in got.collect()}[3] == 7.0
    assert R.rerank(rows.filter("id = 0"), F.lit(9.0), 3).first().score == 10.0


def test_neighbours_and_budget(spark):
    chunks = spark.createDataFrame([(i, "d", i, "medium", "text", f"t{i}", 0.0) for i in range(6)], "id int, doc_id string, chunk_index int, chunk_size_tier string, content_type string, text string, score double")
    seeds = chunks.filter("id = 0").withColumn("score", F.lit(0.9))
    assert [(r.id, r.score) for r in R.neighbours(seeds, chunks, 2).collect()] == [(0, 0.9), (1, 0.4), (2, 0.4)]
    rows = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (1, 2, 40), (1, 3, 11), (1, 4, 10)], "g int, o int, n int")
    assert sorted(r.o for r in R.greedy_budget(rows, ["g"], ["o"], "n", 100).collect()) == [0, 2, 4]
    secs = chunks.withColumn("section_id", F.when(F.col("id") < 3, "s").otherwise("t"))
    assert {r.id for r in R.section_expansion(secs.filter("id = 1").withColumn("score", F.lit(0.8)), secs, budget=5).collect()} == {0, 1}


def test_keyed_union_and_pages(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "b"), (2, "a")], "k int, v string")
    assert sorted(map(tuple, R.keyed_union(a, b, ["k"], ["v"]).collect())) == [(1, "x"), (2, "a")]
    got = R.page_of(spark.range(10), ["id"], 6, 3).collect()
    assert [r.id for r in got] == [6, 7, 8] and all(r.has_more for r in got)
    assert not R.page_of(spark.range(10), ["id"], 7, 3).first().has_more


# chunks


def test_paragraph_chunks():
    assert list(chunking.paragraphs("short text", 512, 50)) == [("short text", 0)]
    assert list(chunking.paragraphs("a\n\nb\n\nc", 4, 1)) == [("a\n\nb", 0), ("b\n\nc", 5)]
    long = list(chunking.paragraphs("Word " * 200, 100, 20))
    assert all(len(c) <= 126 for c, _ in long) and long[1][0].startswith(long[0][0][-20:])
    assert list(chunking.paragraphs("\n\n \n\n", 10, 2)) == []


def test_sections(spark):
    doc = "# Guide\nintro\n## Setup\nProcedure:\n1. do it\nWarnings\nmind the gap\n2.1 Check\nverify it\n"
    got = list(chunking.sections(doc, 1000))
    assert [s.path for s in got] == ["Guide", "Guide > Setup", "Guide > Procedure:", "Guide > Warnings", "Guide > 2.1 Check"]
    assert "".join(s.text for s in got) == doc and got[2].section_id == got[3].section_id == got[0].section_id
    frame = spark.createDataFrame([(1, doc), (2, ""), (3, None)], "doc_id int, text string")
    assert chunking.technical_chunks(frame, 1000).count() == 5 and chunking.paragraph_chunks(frame, 20, 5).filter("doc_id > 1").count() == 0
    assert list(chunking.sheet_chunks([["h", "i"], ["1", None], ["2", "3"]], 0, 9)) == ["h | i\n1 | ", "h | i\n2 | 3"]


# sheets


def sheet(spark, rows, name="s"):
    return spark.createDataFrame([("d", name, i, r) for i, r in enumerate(rows)], "doc_id string, sheet string, row_idx int, cells array<string>")


@pytest.mark.parametrize("rows,route,header,reason", [
    ([["grade", "step"], ["a", "1"], ["b", "2"], ["c", "3"]], "clean", 0, "clean table"),
    ([["Title", None], [None, None], ["grade", "step"], ["a", "1"], ["b", "2"], ["c", "3"]], "clean", 2, "clean table"),
    ([["1", "2"], ["3", "4"], ["5", "6"]], "messy", -1, "no header detected"),
    ([["grade", "step"], ["a", "1"]], "messy", 0, "too few data rows"),
    ([["a", "b"], ["x", "1"], ["y"], ["z"], ["w", "1"]], "messy", 0, "not rectangular"),
    ([["a", "b"], ["x", "1"], ["y", "n"], ["z", "2"], ["w", "m"]], "messy", 0, "column 1 not type-consistent"),
])
def test_classify(spark, rows, route, header, reason):
    got = tabular.classify(sheet(spark, rows)).first()
    assert (got.route, got.header_row, got.reason) == (route, header, reason)


def test_typed_table_and_narratives(spark):
    grid = sheet(spark, [["grade", "salary"], ["GS-1", "$1,000"], ["GS-2", "N/A"], ["GS-3"]])
    table = tabular.typed_table(grid, 0, ["grade", "salary"], ["text", "number"])
    assert table.dtypes == [("grade", "string"), ("salary", "double")] and [r.salary for r in table.collect()] == [1000.0, None, None]
    said = [r[0] for r in table.select(tabular.narrative(table, ["grade"], ["salary"], context="pay")).collect()]
    assert said[1] == "pay: grade=GS-2; salary is (not specified)"


def test_regions(spark):
    rows = [["Pay table"], ["grade", "step", "pay"], ["a", "1", "10"], ["b", "2", "20"], ["c", "3", None], ["note: see below", None, None], ["x", "y", "z"], ["q", "1", "2"]]
    got = tabular.regions(sheet(spark, rows)).first()
    assert (got.header_row, got.end_row) == (1, 5)
    assert tabular.regions(sheet(spark, [["only", "text"], ["x", "y"]])).count() == 0


def test_regions_of_any_number_of_rows(spark):
    """More rows than a file format's sheet has; and small blocks against one walk over the sheet."""
    n = (1 << 20) + 5
    long = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row_idx"), F.when(F.col("id") == 0, F.array(F.lit("k"), F.lit("v"))).otherwise(F.array(F.lit("x"), F.col("id").cast("string"))).alias("cells"))
    assert [tuple(r) for r in tabular.regions(long).collect()] == [("d", "s", 0, n)]

    def plain(rows):
        best = (0, -1, -1)
        for h in range(min(len(rows) - 1, tabular.SCAN)):
            if tabular.looks_like_header(rows[h]):
                end, tally = len(rows), [[0, 0] for _ in rows[h]]
                for at in range(h + 1, len(rows)):
                    k = [tabular._kind(c) for c in rows[at]]
                    tally = [[t[0] + (x == "number"), t[1] + (x == "text")] for t, x in zip(tally, k + ["empty"] * len(tally))]
                    if len(k) > len(tally) or len(k) - k.count("empty") <= 1 or any(max(t) < tabular.CONSISTENT * sum(t) for t in tally):
                        end = at
                        break
                best = max(best, (end - h - 1, -h, end)) if end - h - 1 >= tabular.LEAST_ROWS else best
        return () if best[2] < 0 else (-best[1], best[2])

    rng, want, made = random.Random(9), {}, []
    for d in range(30):
        cell = lambda c: rng.choice([None, "", "t", "7"]) if rng.random() < 0.12 else ["t", "7", "t"][c % 3]
        rows = [["a", "b", "c"][: rng.choice([2, 3, 3])] if rng.random() < 0.1 else [cell(c) for c in range(rng.choice([2, 3, 3, 3]))] for _ in range(rng.randint(1, 40))]
        want[str(d)] = plain(rows)
        made += [(str(d), "s", 3 * i, r) for i, r in enumerate(rows)]
    odd = spark.createDataFrame(made, "doc_id string, sheet string, row_idx int, cells array<string>")
    for block in (1, 7, 40):
        assert {r.doc_id: (r.header_row, r.end_row) for r in tabular.regions(odd, block).collect()} == {d: w for d, w in want.items() if w}


def test_stitch_and_normalise(spark):
    grids = spark.createDataFrame([("d", "s", g, r, c) for g, h in enumerate(["H", "H", "K"]) for r, c in enumerate([[h], [f"v{g}"]])], "doc_id string, sheet string, grid_no int, row_idx int, cells array<string>")
    assert sorted((r.island, r.cells[0]) for r in tabular.stitch(grids).collect()) == [(1, "H"), (1, "v0"), (1, "v1"), (2, "K"), (2, "v2")]
    got = tabular.normalise_grid(sheet(spark, [["a", None, " b "], [None, None, None], ["c"]])).orderBy("row_idx").collect()
    assert [list(r.cells) for r in got] == [["a", "b"], ["c", ""]]


# SQL


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; DROP TABLE t", "select * from secret", "select * from t, secret", "select * from t join secret on true", "select * from (select * from secret)",
    "select * from read_csv('x')", "with c as (select 1) select * from c, secret", "select * from parquet.`/etc/x`", "select * from t where x in (select y from \"secret\")", "select java_method('a','b')", "select * from t -- \n, secret",
    "select * from default.secret", "update t set x = 1", "",
])
def test_guard_refuses(sql):
    with pytest.raises(sqlguard.Refused):
        sqlguard.checked(sql, {"t"})


@pytest.mark.parametrize("sql", [
    "select * from t;", "WITH c AS (SELECT * FROM t) SELECT * FROM c", "select extract(year from d), count(*) from t group by 1", "select a, b from t x where a in (1, 2) order by a, b", "select * from t a join t b on a.x = b.x, t c", "select * from T where x = 'from secret'",
    "with recursive r(n) as (select 1 union all select n + 1 from r) select * from r", "select trim(both ' ' from x) from t",
])
def test_guard_lets_through(sql):
    sqlguard.checked(sql, {"t"})


def test_run_sees_given_views_only(spark):
    spark.range(3).createOrReplaceTempView("hidden")
    with pytest.raises(sqlguard.Refused):
        sqlguard.run(spark, "select * from hidden", {"t": spark.range(2)})
    assert sqlguard.run(spark, "select count(*) as n from t", {"t": spark.range(2)}).first().n == 2
    assert not spark.catalog.tableExists("t") and spark.table("hidden").count() == 3


def test_extract_sql():
    assert sqlguard.extract_sql("Well.\n```sql\nSELECT 1\n```\nor\n```\nthen WITH a AS (SELECT 2) SELECT * FROM a\n```") == "WITH a AS (SELECT 2) SELECT * FROM a"
    assert sqlguard.extract_sql("no query") == "" and sqlguard.extract_sql("Use select x from t") == "select x from t"


def test_repair_loop():
    answers = iter(["nothing", "select bad", "select empty", "select good"])

    def execute(sql):
        if "bad" in sql:
            raise ValueError("no such column")
        return [] if "empty" in sql else [{"x": 1}]

    t = sqlguard.repaired(lambda p: next(answers), execute, "q", attempts=4)
    assert t.verdict == "satisfactory" and [a[1] for a in t.attempts] == ["no_sql", "error", "empty", "satisfactory"] and not t.error
    assert sqlguard.repaired(lambda p: "prose", execute, "q").verdict == "skipped"
    assert sqlguard.repaired(lambda p: "select bad", execute, "q").verdict == "error"
    assert sqlguard.verdict([{"a": None}]) == "degenerate" and sqlguard.verdict([{"a": "x" * 200_000}]) == "too_large"


# editions


def manuals(spark, *facts):
    """A table of documents with the given facts about each."""
    base = dict(identifier="M-1", product_normalized="p", headings=[], normalized_title="m", title_source="explicit", revision=None, publication_date=None, effective_date=None, environment=None, supersedes=[], applicability=[], conflicts=[])
    kinds = ", ".join(f"{k}: {'array<string>' if isinstance(v, list) else 'string'}" for k, v in base.items())
    rows = [(f.get("doc_id", f"d{i}"), f.get("content_hash", f"h{i}"), tuple((base | f)[k] for k in base)) for i, f in enumerate(facts)]
    return spark.createDataFrame(rows, f"doc_id string, content_hash string, identity struct<{kinds}>")


def pairs_of(spark, *facts):
    return {(r.a, r.b): (r.confidence, r.reason) for r in editions.pairs(editions._profiles(manuals(spark, *facts))[0]).collect()}


def test_relations(spark):
    got = pairs_of(spark, {}, dict(revision="2"), dict(identifier="M-2"), dict(identifier="M-3", supersedes=["M-1 rev 1.2"]), dict(product_normalized="q"))
    assert got == {("d0", "d1"): (0.99, "same identifier"), ("d0", "d3"): (0.98, "supersession"), ("d1", "d3"): (0.98, "supersession")}
    sections = ["setup", "safety", "cabling", "faults"]
    alike = [dict(identifier=None, normalized_title="campus router installation guide" + s, headings=sections) for s in ("", "s")]
    assert pairs_of(spark, *alike) == {("d0", "d1"): (0.65, "possible")}
    assert pairs_of(spark, alike[0], alike[0] | {"headings": sections[:3]}) == {("d0", "d1"): (0.93, "same title, product and sections")}
    nameless = [dict(identifier=None, product_normalized=p, normalized_title="network guide", headings=sections) for p in ("", "", "p")]
    assert pairs_of(spark, *nameless[:2]) == {("d0", "d1"): (0.65, "possible")} == pairs_of(spark, nameless[0], nameless[2])  # a product has to be stated
    assert pairs_of(spark, alike[0], alike[1] | {"headings": ["other"]}) == {}
    assert pairs_of(spark, dict(identifier=None, content_hash="x", normalized_title="a"), dict(content_hash="x", normalized_title="b")) == {("d0", "d1"): (1.0, "same bytes")}


def test_pairs_against_all_pairs(spark):
    """Blocking loses no related pair: the same conditions over all pairs of random documents give the same."""
    rng = random.Random(3)
    facts = [
        dict(
            identifier=rng.choice([None, None, f"M-{rng.randint(1, 12)}"]), content_hash=f"h{rng.randint(1, 40)}", product_normalized=rng.choice(["", "p", "q"]), normalized_title=rng.choice(["router guide", "router guides", "switch book", "a b"]),
            title_source=rng.choice(["explicit", "filename"]), headings=rng.sample(["a1", "b2", "c3", "d4", "e5", "f6"], rng.randint(0, 6)), supersedes=rng.choice([[], [f"M-{rng.randint(1, 12)} rev 1"]]),
        )
        for _ in range(40)
    ]
    profiles = editions._profiles(manuals(spark, *facts))[0]
    x, y = profiles.select(F.col("doc_id").alias("a"), F.col("d").alias("x")), profiles.select(F.col("doc_id").alias("b"), F.col("d").alias("y"))
    every = x.crossJoin(y).filter("a < b").withColumn("alike", editions._likeness("x.normalized_title", "y.normalized_title"))
    want = every.withColumn("r", editions.related(F.col("x"), F.col("y"), F.col("alike"))).select("a", "b", "r.confidence", "r.reason").filter("confidence > 0")
    assert sorted(map(tuple, editions.pairs(profiles).collect())) == sorted(map(tuple, want.collect()))


def test_newer(spark):
    def sign(a, b):
        d = manuals(spark, a, b).select("doc_id", "identity")
        x, y = d.filter("doc_id = 'd0'").select(F.col("identity").alias("x")), d.filter("doc_id = 'd1'").select(F.col("identity").alias("y"))
        return x.crossJoin(y).select(editions.newer(F.col("x"), F.col("y"))).first()[0]

    old, new = dict(revision="1.2", effective_date="2020-01-01"), dict(revision="1.10", effective_date="2021-01-01")
    assert sign(new, old) == 1 and sign(old, new) == -1 and sign(old, old) is None
    assert sign(old | {"effective_date": "2022-01-01"}, new) is None and sign(old, new | {"conflicts": ["revision"]}) is None
    assert sign(dict(supersedes=["M-1 revision 3"]), dict(revision="3")) == 1 and sign(dict(supersedes=["M-1 revision 4"]), dict(revision="3")) is None


@pytest.mark.parametrize("facts,asked,fits", [
    (dict(applicability=["2.0 - 2.9"]), "2.4", True), (dict(applicability=[">= 3"]), "2.4", False), (dict(applicability=["2.4"]), "2.4.1", True), (dict(applicability=["all models"]), "2.4", None),
    ({}, "2.4", None), (dict(environment="lab"), "2.4", False), (dict(environment="Prod"), "2.4", None), (dict(applicability=["1.0 to 1.5", "at least 2.0"]), "2.4", True),
])
def test_applicability(spark, facts, asked, fits):
    c = editions.request_context(f"we run firmware {asked} in prod")
    assert c["software_version"] == asked and c["environment"] == "production"
    assert manuals(spark, facts).select(editions.applicable(F.col("identity"), c)).first()[0] is fits


def test_families_of_a_long_chain(spark):
    """Nine manuals, each superseding the one before: complete linkage pairs them off, however long the chain."""
    facts = [dict(identifier=f"M-{i}", normalized_title=f"t{i}", supersedes=[f"M-{i - 1}"] if i else [], doc_id=f"{i:02}") for i in range(9)]
    got = {r.doc_id: r.family for r in editions.families(manuals(spark, *facts)).collect()}
    assert got == {f"{i:02}": f"{i - i % 2:02}" for i in range(9)}


def test_select_editions(spark):
    def text(rev, date, extra=""):
        return f"# Manual\nDocument ID: M-7\nProduct: Router\nRevision: {rev}\nEffective date: {date}\n{extra}"

    rows = [("a", text("1.0", "2020-01-01")), ("b", text("2.0", "2021-01-01")), ("c", text("3.0", "2999-01-01")), ("x", "Document ID: Z-9\nother")]
    docs = editions.identity(spark.createDataFrame(rows, "doc_id string, text string").withColumn("filename", F.concat("doc_id", F.lit(".txt"))).withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)))
    pick = lambda q: {r.doc_id for r in editions.select_editions(docs, q, today="2024-01-01").filter("selected").collect()}
    assert pick("how to set it up") == {"b", "x"} and pick("compare editions") == {"a", "b", "c", "x"} and pick("what does revision 1.0 say") == {"a"}
    assert pick("state as of 2020-06-01") == {"a", "x"}


# graph, sets, aggregates


def test_entities(spark):
    m = spark.createDataFrame([("U.S. Army", "org", 3), ("u.s. army", "org", 1), ("U-S Army", "org", 2), ("AB", "org", 1), ("ab", "org", 2), ("A.B", "org", 3)], "name string, entity_type string, doc_id int")
    got = {r.canonical: (r.name, r.first_doc, r.n_mentions) for r in graph.resolve_entities(m).collect()}
    assert got["u s army"] == ("U.S. Army", 1, 3) and "ab" in got and "a b" in got


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "s"), ("e", "e", "r")], "source string, target string, relation_type string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hop) for r in graph.k_hop(e, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.node, r.hop) for r in graph.k_hop(e, seeds, 3, ["r"]).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    mapping = spark.createDataFrame([("b", "a")], "remove string, keep string")
    assert {(r.source, r.target) for r in graph.merged(e, mapping).collect()} == {("a", "c"), ("c", "a"), ("c", "d")}


def test_theta_join_is_whole(spark, tmp_path):
    """Pairs of a nation, however far apart their keys are and whichever is larger."""
    for t in sqlsurface.TABLES:
        spark.createDataFrame([(1, 1, 5.0), (2, 1, 9.0), (900, 1, 7.0), (901, 2, 8.0), (902, 1, 5.0)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/{t}.parquet")
    got = {(r.lo, r.hi) for r in sqlsurface.QUERIES["n_theta_join"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (1, 900), (900, 2), (902, 2), (902, 900)}


def test_sets(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert sorted(r.v for r in sets.replace_document(t, t.limit(0), "k", 1).collect()) == ["b", "c"]
    assert {(r.k, r.v) for r in sets.upsert(t, spark.createDataFrame([(2, "z"), (9, "n")], t.schema), ["k"]).collect()} == {(1, "a"), (2, "z"), (None, "c"), (9, "n")}
    none = spark.createDataFrame([], "doc_id int")
    some = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert sets.purge_plan(none, some, False).first().status == "refused_empty_metadata" and sets.purge_plan(some, some, True).first().status == "refused_active"
    assert sets.purge_plan(some.limit(1), some, False).first().n_orphans == 1
    assert [r.v for r in sets.keep_first(t.unionAll(t), ["v"], ["k"]).orderBy("v").collect()] == ["a", "b", "c"]


def test_medians_and_precision(spark):
    assert one(spark, aggregates.upper_median, [3, 1, 2, 4], "array<int>") == 3
    df = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(aggregates.precision(F.col("a"), F.col("b"))).collect()] == [0.333, 0.0]


# evidence


def test_evidence():
    assert evidence.evidence_id(("d", "small", 1, 0, None, "o'x"), "t") != evidence.evidence_id(("d", "small", 1, 0, None, "ox"), "t")
    chunks = [dict(text="x" * 60, score=1.0), dict(text="y" * 60, score=0.9), dict(text="z" * 30, score=0.1), dict(text="d", score=9.0, derived=True)]
    assert [c["text"][0] for c in evidence.pack(chunks, 95)] == ["x", "z", "d"]
    assert len(evidence.rows_that_fit([{"a": "x" * 10}] * 100, 600)) == 25
    assert evidence.batches(["aa", "bb", "cccccc", "d"], 4) == [["aa", "bb"], ["cccccc"], ["d"]]
    assert evidence.reduced(["a", "b", "c", "d", "e"], "".join, 2) == "abcde" and evidence.reduced([], "".join, 2) == ""


def test_quotes(spark):
    valve, made = ("Ev", "Close valve 7 5 before DO NOT START is lit.", "valve.pdf", "document"), ("Em", "Document: a.pdf\nSummary: Safe at any speed.\n\nSlow down.", "", "document")
    cases = [  # answer, question, evidence, unsupported, quoted
        ('It says "Close\n valve" [Ev].', "", valve, [], True), ('It says "close valve" [Ev].', "", valve, ["close valve"], True), ('"DO NOT START" [Ev]', "", valve, [], True), ('"do not start" [Ev]', "", valve, ["do not start"], True),
        ('"DO NOT START" [Ex]', "", valve, ["DO NOT START"], True), ('"valve 75" [Ev]', "", valve, ["valve 75"], True), ('"DO NOT\u00ad START" [Ev]', "", valve, [], True), ('"lamp." [Ev]', "what is the lamp?", valve, [], True),
        ('"lamp" [Ev]', "what is the lamp?", valve, [], False), ("`lamp` [Ev]", "what is the lamp?", valve, ["lamp"], False), ("`valve.pdf` [Ev]", "", valve, [], False), ('```mermaid\na["x y"]\n```\n"Close valve" [Ev]', "", valve, [], True),
        ('```\n"x y"\n```\nplain [Ev]', "", valve, ["x y"], False), ('"Safe at any speed" [Em]', "", made, ["Safe at any speed"], True), ('"Slow down" [Em]', "", made, [], True), ('"Slow down" [Em]', "", (*made[:3], "derived"), ["Slow down"], True),
        ("plain", "", made, [], False), ("`Slow down` [Em]", "", made, [], True), ("`Hurry` [Em]", "", made, ["Hurry"], False), ('"b" then “a” and "b"\n\n[Em]', "", made, ["b", "a", "b"], True), ('a " b `c\nd` "" e', "", made, [" b `c\nd` "], True), (None, None, made, [], False),
    ]
    answers = spark.createDataFrame([(i, a, q) for i, (a, q, *_) in enumerate(cases)], "answer_id int, answer string, question string")
    held = spark.createDataFrame([(i, *c[2]) for i, c in enumerate(cases)], "answer_id int, evidence_id string, text string, filename string, kind string")
    got = {r.answer_id: (r.unsupported, r.quoted) for r in evidence.quote_checks(answers, held).collect()}
    assert [(c[0], *got[i]) for i, c in enumerate(cases)] == [(c[0], *c[3:]) for c in cases]


# files


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Budget" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Dept</t></si><si><t>Spent</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>IT</t></is></c><c r="C3"><v>7.5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def docx():
    out, w = io.BytesIO(), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Top', 'Heading1')}{p('body')}{p('Sub', 'Heading2')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook())
    (tmp_path / "w.csv").write_bytes(workbook())  # a workbook under another name
    (tmp_path / "d.docx").write_bytes(docx())
    (tmp_path / "broken.docx").write_bytes(b"PK no zip")
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\"x\ty\"\n")
    (tmp_path / "n.bin").write_bytes(b"a\0b")
    (tmp_path / "m.md").write_text("# T\nSkip to main content\ntext")
    files = readers.read_binary(spark, str(tmp_path)).filter("filename != 'w.csv' or format = 'ooxml'").cache()
    grid = readers.sheets(files)
    rows = {(r.path.split("/")[-1], r.row_idx): r.cells for r in grid.collect()}
    assert rows["b.xlsx", 0] == ["Dept", None, "Spent"] and rows["b.xlsx", 1] == [] and rows["b.xlsx", 2] == ["IT", None, "7.5"] == rows["w.csv", 2] and rows["t.tsv", 1] == ["1", "x\ty"]
    assert "Sheet: Budget\nDept |  | Spent" in {r.path.split("/")[-1]: r.text for r in readers.flat_sheets(grid).collect()}["b.xlsx"]
    parts = readers.blocks(files)
    got = [(r.block_type, r.text, r.section_path) for r in parts.filter(F.col("path").endswith("/d.docx")).orderBy("body_index").collect()]
    assert got == [("heading", "Top", "Top"), ("paragraph", "body", "Top"), ("heading", "Sub", "Top > Sub"), ("table", "a | b", "Top > Sub")]
    assert parts.filter("block_type = 'error'").count() == 1 and readers.rendered(parts).count() == 1
    assert readers.plain_text(files.filter("kind = 'text'")).count() == 0
    assert readers.markdown(files.filter("kind = 'markdown'")).first().text == "# T\ntext"


def test_html_and_links(spark):
    html = '<html><body><nav>menu</nav><main><h2>T</h2><p>one <b>two</b> <a href="/x#y">l</a></p><script>s()</script></main><a href="http://o.org/z">o</a></body></html>'
    assert readers.html_to_markdown(html) == "## T\n\n\none **two** [l](/x#y)" or "## T" in readers.html_to_markdown(html) and "menu" not in readers.html_to_markdown(html)
    pages = spark.createDataFrame([("http://a.org/d/i.html", html), ("http://a.org/x", '<a href="../d/i.html">b</a><a href="q?k=1">c</a>')], "url string, html string")
    assert {(r.url, r.target) for r in readers.links(pages).collect()} >= {("http://a.org/d/i.html", "http://a.org/x"), ("http://a.org/x", "http://a.org/q?k=1")}
    assert {(r.url, r.hop) for r in readers.crawl(pages, "http://a.org/d/i.html", 2, 10).collect()} == {("http://a.org/d/i.html", 0), ("http://a.org/x", 1)}
    assert one(spark, readers.clean_url, "http://a.org/x//?q=1#f") == "http://a.org/x?q=1"


def test_transcript_and_graphml(spark):
    docs = spark.createDataFrame([("p", "Meeting: weekly\nDate: today\n---\n\nAnn: shall we?\nBob: yes\njust text")], "path string, text string")
    assert [(r.kind, r.speaker, r.text) for r in readers.transcript(docs).orderBy("position").collect()] == [("header", "Meeting", "weekly"), ("header", "Date", "today"), ("question", "Ann", "shall we?"), ("statement", "Bob", "yes"), ("text", None, "just text")]
    nodes, edges = readers.graphml(spark.createDataFrame([('<node id="A"/><node id="B"/><edge source="A" target="B"><data key="d">knows&lt;SEP&gt;likes</data></edge>',)], "text string"))
    assert {r.id for r in nodes.collect()} == {"A", "B"} and tuple(edges.first()) == ("A", "B", "knows")
    log = spark.createDataFrame([(i, v) for i, v in enumerate(['{"a": 1}', "broken", '{"a": 3}'])], "position int, value string")
    assert [(r.position, r.a) for r in readers.audit_log(log, "a int").collect()] == [(2, 3), (0, 1)]


# models and streams


def test_models(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.vector for r in models.embed(rows, "t", dim=8).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and sum(map(abs, got[2])) == 0

    def extract(t):
        if not t:
            raise ValueError("nothing")
        return "NO_RELEVANT_DATA" if "beta" in t else t

    assert {r.id: r.status for r in models.mapped(rows, "t", extract).collect()} == {1: "empty", 2: "failed", 3: "failed"}
    q = spark.createDataFrame([("p", "lookup"), ("p", "metadata"), ("r", "lookup")], "pattern string, kind string")
    stats = spark.createDataFrame([("p", "sweep", 5, 0.3), ("r", "sweep", 2, 0.9)], "pattern string, strategy string, n int, margin double")
    assert sorted(map(tuple, models.overridden(q, stats).collect())) == [("p", "metadata"), ("p", "sweep"), ("r", "lookup")]
    assert one(spark, models.classify, "How do I configure it?") == "procedure" and one(spark, models.classify, "Bob's phone") == "lookup"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"h{i % 3}") for i in range(9)], "id int, content_hash string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    jobs.ingest(jobs.deduplicated_stream(stream), lambda df, n: seen.extend(r.content_hash for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["h0", "h1", "h2"]
    known = spark.createDataFrame([("h1",)], "content_hash string")
    assert sorted(r.content_hash for r in jobs.new_content(rows, known).collect()) == ["h0", "h2"]


def test_jobs(spark):
    log = spark.createDataFrame([("a", "queued", 1), ("a", "complete", 5), ("b", "queued", 2), ("b", "parsing", 2), ("c", "failed", 0)], "job_id string, state string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    states = jobs.latest_state(log)
    assert {r.job_id: r.state for r in states.collect()} == {"a": "complete", "b": "parsing", "c": "failed"}
    assert jobs.active(states).first().active
    now = F.timestamp_seconds(F.lit(8))
    assert {r.job_id for r in jobs.evicted(states, now, 5).collect()} == {"a", "b"} and {r.job_id for r in jobs.evicted(states, now, 3, terminal_only=False).collect()} == {"a"}
