"""Quality rules: fixed limits on a text's statistics, then robust multivariate outliers per language and source.

The statistics are transformed to a vector; location and scatter of each (language, source) come from a minimum covariance
determinant estimate by concentration steps: the half nearest to the present estimate gives the next one, from several
starts until no determinant falls, and the least determinant counts. Equal vectors count once, so copies of a text weigh no
more than the text. Texts whose Mahalanobis distance exceeds the cut-off are rejected. DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm._common import SPACE, WORD, apart, checkpoint

SYMBOL = r"[#*$%&|<>]"
#: Words of a window, least words of a text, and most per cent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Chance to reject a text of a normal source, and distinct vectors, six times their dimension, from which a (language,
#: source) or language has an estimate of its own. Steps go on while a log determinant falls by more than FALL.
CHANCE, OWN, FALL = 1e-9, 30, 1e-3
#: Vector: names, and the least standard deviation that counts in each (most texts have no symbols at all).
VECTOR = {"v_words": 0.5, "v_length": 0.08, "v_symbols": 0.35, "v_lines": 0.5, "v_repeat": 0.5}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes of a text from which its words are rows, not an array, and characters of the parts that it is cut into then.
LONG, PART = 16 << 20, 1 << 20
#: Groups whose estimates are sent to every task; with more they are joined by key.
SENT = 5000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated_words(words: Column) -> Column:
    """Words in windows that are found twice or more in the text, the first one included."""

    def of_hashes(h: Column) -> Column:
        last = F.size(h) - WINDOW
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(last > 0, let(windows, of_windows)).otherwise(F.lit(0).cast("long"))

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of_sorted)
        )

    def of_sorted(s: Column) -> Column:
        def twin(i: Column) -> Column:
            x = F.get(s, i)["x"]
            return F.coalesce(x == F.get(s, i - 1)["x"], F.lit(False)) | F.coalesce(x == F.get(s, i + 1)["x"], F.lit(False))

        places = F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda i: F.get(s, i)["i"])
        return let(F.sort_array(places), covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k) - F.get(p, k - 1), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as Columns; null counts as empty."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    words = F.filter(F.split(body, f"{SPACE}+"), lambda w: w != "")
    return {
        "n_words": F.regexp_count(body, F.lit(WORD)).cast("long"),
        "word_chars": (F.char_length(body) - F.regexp_count(body, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(words),
    }


def long_statistics(rows: DataFrame, part: int | None = None) -> DataFrame:
    """The statistics of texts that are too long for arrays of their words: __uid, the statistics. rows: __uid, __body.

    A text is cut into parts of equal length, tokens are numbered through all parts, and what a cut parts has one number and
    is joined again. Then words, lines and windows are rows, counted as rows are.
    """
    part = part or PART
    last = F.floor((F.char_length("__body") - 1) / part).cast("int")
    parts = rows.select("__uid", "__body", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).alias("c"))
    parts = checkpoint(parts.select("__uid", "c", F.expr(f"substring(__body, c * {part} + 1, {part})").alias("part")).repartition("__uid", "c"))

    def tokens(separator: str) -> DataFrame:
        pieces = parts.select("__uid", "c", F.split("part", separator).alias("p"))
        before = Window.partitionBy("__uid").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        first = pieces.select("__uid", "c", F.coalesce(F.sum(F.size("p") - 1).over(before), F.lit(0)).alias("first"))
        found = pieces.join(first, ["__uid", "c"]).select("__uid", "c", "first", F.posexplode("p").alias("i", "t"))
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]), "")
        return found.groupBy("__uid", (F.col("first") + F.col("i")).alias("no")).agg(whole.alias("t"))

    words = checkpoint(tokens(SPACE).filter("t != ''").select("__uid", "no", F.xxhash64("t").alias("h"), F.char_length("t").alias("size")))
    order = Window.partitionBy("__uid").orderBy("no")
    ahead = [F.lead("h", k).over(order) for k in range(WINDOW)]
    windows = words.select("__uid", F.row_number().over(order).alias("at"), *[x.alias(f"h{k}") for k, x in enumerate(ahead)]).filter(f"h{WINDOW - 1} is not null")
    windows = checkpoint(windows.select("__uid", "at", F.xxhash64(*[f"h{k}" for k in range(WINDOW)]).alias("w")))
    twice = windows.groupBy("__uid", "w").agg(F.count("*").alias("n")).filter("n > 1").select("__uid", "w")
    covered = windows.join(twice, ["__uid", "w"], "left_semi").select("__uid", F.explode(F.sequence(F.col("at"), F.col("at") + WINDOW - 1)).alias("at")).distinct()
    counts = [
        words.groupBy("__uid").agg(F.count("*").alias("n_words"), F.sum("size").alias("word_chars")),
        parts.groupBy("__uid").agg(F.sum(F.regexp_count("part", F.lit(SYMBOL))).alias("n_symbols")),
        tokens("\n").filter(F.col("t").rlike(WORD)).groupBy("__uid").agg((F.count("*") - F.count_distinct(F.sha2(F.col("t").cast("binary"), 256))).alias("n_dup_lines")),
        covered.groupBy("__uid").agg(F.count("*").alias("n_repeat_words")),
    ]
    out = rows.select("__uid")
    for c in counts:
        out = out.join(c, "__uid", "left")
    return out.select("__uid", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in STATISTICS])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> dict[str, Column]:
    """Transformed statistics, near to normal for ordinary prose."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "v_words": F.log1p("n_words"),
        "v_length": F.log((F.col("word_chars") + 1) / n),
        "v_symbols": F.log1p(F.lit(1000.0) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "v_lines": F.log1p("n_dup_lines"),
        "v_repeat": F.log1p(F.lit(100.0) * F.col("n_repeat_words") / n),
    }


def chi2_cdf(x: float, d: int) -> float:
    """The chi-squared distribution by its series."""
    a, h = d / 2, x / 2
    term = math.exp(-h + a * math.log(h) - math.lgamma(a + 1)) if h > 0 else 0.0
    total, n = term, 1
    while term > 1e-18 * max(total, 1e-300) and n < 10_000:
        term *= h / (a + n)
        total += term
        n += 1
    return total


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-squared distribution by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return (lo + hi) / 2


def half(n: Column) -> tuple[Column, Column]:
    """Of n vectors the size of the subset with the highest breakdown, and what corrects its scatter at the normal."""
    d = len(VECTOR)
    h = F.least(n, F.floor((n + d + 1) / 2)).cast("long")
    grow = [k / 100 / chi2_cdf(chi2_quantile(k / 100, d), d + 2) for k in range(50, 100)] + [1.0]
    return h, F.get(F.array(*map(F.lit, grow)), (F.round(100 * h / n) - 50).cast("int"))


def _moments(rows: DataFrame, names: list[str], grow: float | Column) -> DataFrame:
    """Mean and Cholesky factor of the scatter of each group g; grow, a number or an aggregate, corrects the scatter of a concentrated subset."""
    sums = [F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in names]]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    grow = grow if isinstance(grow, Column) else F.lit(grow)
    out = rows.groupBy("g").agg(*sums, *[F.covar_pop(a, b).alias(f"s_{a}_{b}") for a, b in pairs], grow.alias("grow"))
    for a, b in pairs:
        floor = VECTOR[a] ** 2 if a == b else 0.0
        out = out.withColumn(f"s_{a}_{b}", F.col(f"s_{a}_{b}") * F.col("grow") + floor)
    return _factor(out, names)


def _factor(out: DataFrame, names: list[str]) -> DataFrame:
    """g, the means m_ and the Cholesky factor l_ of the scatter s_."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    for i, a in enumerate(names):  # row by row; the floors keep every pivot away from 0
        for j, b in enumerate(names[:i]):
            rest = F.col(f"s_{a}_{b}")
            for k in range(j):
                rest = rest - F.col(f"l_{a}_{names[k]}") * F.col(f"l_{b}_{names[k]}")
            out = out.withColumn(f"l_{a}_{b}", rest / F.col(f"l_{b}_{b}"))
        rest = F.col(f"s_{a}_{a}")
        for k in range(i):
            rest = rest - F.col(f"l_{a}_{names[k]}") ** 2
        out = out.withColumn(f"l_{a}_{a}", F.sqrt(F.greatest(rest, F.lit(VECTOR[a] ** 2 / 4))))
    return out.select("g", *[f"m_{x}" for x in names], *[f"l_{a}_{b}" for a, b in pairs])


def _distance(rows: DataFrame, estimate: DataFrame, names: list[str], few: bool) -> DataFrame:
    """rows and d2, the squared Mahalanobis distance to their group's estimate."""
    met = rows.join(F.broadcast(estimate) if few else estimate, "g")
    total = F.lit(0.0)
    for i, a in enumerate(names):
        rest = F.col(a) - F.col(f"m_{a}")
        for k in range(i):
            rest = rest - F.col(f"l_{a}_{names[k]}") * F.col(f"z_{names[k]}")
        met = met.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
        total = total + F.col(f"z_{a}") ** 2
    return met.withColumn("d2", total).select(*rows.columns, "d2")


def _nearest(rows: DataFrame, few: bool) -> DataFrame:
    """The h rows of each group with the least d2, to a twentieth of a power of e: counted by bins, not sorted."""
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 20).cast("int"))
    bins = binned.groupBy("g", "bin").agg(F.count("*").alias("n"), F.max("h").alias("h"))
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("before < h").groupBy("g").agg(F.max("bin").alias("last"))
    return binned.join(F.broadcast(last) if few else last, "g").filter("bin <= last").drop("bin", "last", "d2")


def _starts(points: DataFrame, names: list[str], few: bool) -> DataFrame:
    """First estimates of each group around its median, scaled by the median deviation: g is the start's digit and the group.

    0 has no correlations, 1 those of the directions alone, 2 those of the deviations damped by tanh.
    """

    def median(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        return rows.groupBy("g").agg(*[F.percentile_approx(v, 0.5, 2000).alias(k) for k, v in values.items()])

    def at(other: DataFrame) -> DataFrame:
        return points.join(F.broadcast(other) if few else other, "g")

    middle = checkpoint(median(points, {f"m_{x}": F.col(x) for x in names}))
    wide = median(at(middle), {f"w_{x}": 1.4826 * F.abs(F.col(x) - F.col(f"m_{x}")) for x in names})
    wide = wide.select("g", *[F.greatest(F.col(f"w_{x}"), F.lit(VECTOR[x])).alias(f"w_{x}") for x in names])
    middle = checkpoint(middle.join(wide, "g"))
    scaled = at(middle).withColumns({f"z_{x}": (F.col(x) - F.col(f"m_{x}")) / F.col(f"w_{x}") for x in names})
    scaled = scaled.withColumn("r", F.greatest(F.sqrt(sum((F.col(f"z_{x}") ** 2 for x in names), F.lit(0.0))), F.lit(1e-9)))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    products = {1: lambda x: F.col(f"z_{x}") / F.col("r"), 2: lambda x: F.tanh(f"z_{x}")}
    means = scaled.groupBy("g").agg(*[F.avg(f(a) * f(b)).alias(f"c{k}_{a}_{b}") for k, f in products.items() for a, b in pairs])
    met = means.join(middle, "g")

    def start(k: int) -> DataFrame:
        def spread(a: str) -> Column:
            return F.col(f"c{k}_{a}_{a}") + 1e-3

        def scatter(a: str, b: str) -> Column:
            r = F.lit(1.0) if a == b else F.lit(0.0) if k == 0 else F.col(f"c{k}_{a}_{b}") / F.sqrt(spread(a) * spread(b))
            return r * F.col(f"w_{a}") * F.col(f"w_{b}")

        named = met.select(F.concat(F.lit(str(k)), "g").alias("g"), *[f"m_{x}" for x in names], *[scatter(a, b).alias(f"s_{a}_{b}") for a, b in pairs])
        return _factor(named, names)

    return checkpoint(start(0).unionByName(start(1)).unionByName(start(2)))


def _concentrated(points: DataFrame, names: list[str], few: bool) -> DataFrame:
    """The estimate of least determinant of each group g, of its points, which have h and grow of half()."""
    estimate = _starts(points, names, few).withColumn("det", F.lit(math.inf))
    rows = points.withColumn("g", F.explode(F.array(*[F.concat(F.lit(k), "g") for k in "012"])))
    found = None
    while True:  # ends: each time round a determinant falls by FALL, and the floors bound them
        near = _nearest(_distance(rows, estimate, names, few), few)
        step = _moments(near, names, F.max("grow")).withColumn("det", sum((2 * F.log(f"l_{x}_{x}") for x in names), F.lit(0.0)))
        was = estimate.select("g", F.col("det").alias("was"))
        step = checkpoint(step.join(F.broadcast(was) if few else was, "g"))
        found = step.drop("was") if found is None else found.unionByName(step.drop("was"))
        estimate = step.filter(F.col("det") < F.col("was") - FALL).drop("was")
        if estimate.isEmpty():
            break
    columns = [c for c in found.columns if c not in ("g", "det")]
    least = found.groupBy(F.substring("g", 2, 1 << 30).alias("g")).agg(F.min(F.struct("det", *columns)).alias("e"))
    return checkpoint(least.select("g", *[f"e.{c}" for c in columns]))


def outliers(rows: DataFrame, group: list[str], chance: float = CHANCE, own: int = OWN) -> DataFrame:
    """rows, which have the columns of VECTOR, and d2, the squared robust distance, and outlier, whether it's over the cut-off.

    Groups with fewer than own distinct vectors are judged by all rows alike in all columns of group but the last, and
    so on up to the estimate of all rows, which has no least size: every row is judged.
    """
    names, d = list(VECTOR), len(VECTOR)
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in group]
    levels = list(range(len(group), -1, -1))
    keys = {f"k{n}": F.to_json(F.array(*parts[:n])) if n else F.lit("[]") for n in levels}
    rows = rows.withColumns(keys)
    vectors = checkpoint(rows.select(*keys, *names).distinct())
    h, grow = half(F.col("__n"))
    sizes = {k: checkpoint(vectors.select(k, *names).distinct().groupBy(k).agg(F.count("*").alias("__n"))) for k in keys}
    finest = f"k{levels[0]}"
    placed = vectors.select(*keys).distinct().withColumn("g", F.lit(None).cast("string"))
    for k, size in sizes.items():
        big = size.filter(F.col("__n") >= (own if k != "k0" else 0)).select(k, F.lit(True).alias("big"))
        placed = placed.join(big, k, "left").withColumn("g", F.coalesce("g", F.when(F.col("big"), F.col(k)))).drop("big")
    placed = checkpoint(placed.select(finest, "g"))
    used = checkpoint(placed.select("g").distinct())
    few = 3 * used.count() <= SENT
    rows = checkpoint(rows.join(F.broadcast(placed) if placed.count() <= SENT else placed, finest).drop(*keys))
    held = None
    for k, size in sizes.items():
        some = size.withColumnRenamed(k, "g").join(used, "g", "left_semi").select("g", h.alias("h"), grow.alias("grow"))
        some = vectors.select(F.col(k).alias("g"), *names).distinct().join(F.broadcast(some) if few else some, "g")
        held = some if held is None else held.unionByName(some)
    points = checkpoint(held)
    estimate = _concentrated(points, names, few)
    inner = chi2_quantile(0.975, d)
    close = _distance(points, estimate, names, few).filter(F.col("d2") <= inner)
    estimate = checkpoint(_moments(close, names, 0.975 / chi2_cdf(inner, d + 2)))
    cut = chi2_quantile(1 - chance, d)
    return _distance(rows, estimate, names, few).withColumn("outlier", F.col("d2") > cut).drop("g")


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: key, the statistics, base_failed, d2 (null if base_failed), kept.

    Null and empty texts have no words and fail. Very long texts are measured whole. Null languages and sources are groups of
    their own. Repeated rows are judged alike and count once in an estimate; of estimates with equal determinants the first
    in order of their values counts. An empty table gives an empty table. Other columns of docs may have any names; a key that
    is named like a column of the result is in it with _key behind its name.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"), body.alias("__body"))
    names = ["__k", "__lang", "__source"]
    short = base.filter(F.octet_length("__body") < LONG)
    rows = checkpoint(short.select(*names, *[c.alias(n) for n, c in statistics(F.col("__body")).items()]))
    if rows.count() < docs.count():
        long = checkpoint(base.filter(F.octet_length("__body") >= LONG).withColumn("__uid", F.monotonically_increasing_id()))
        rows = rows.unionByName(long.drop("__body").join(long_statistics(long.select("__uid", "__body")), "__uid").select(*names, *STATISTICS))
    rows = checkpoint(rows.withColumn("base_failed", base_failed()))
    passed = rows.filter("not base_failed").withColumns(vector())
    judged = outliers(passed, ["__lang", "__source"])
    names = [F.col("__k").alias(apart(key, *STATISTICS, "base_failed", "d2", "kept")), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = rows.filter("base_failed").select(*names, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return failed.unionByName(judged.select(*names, "d2", (~F.col("outlier")).alias("kept")))
