"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing chunks.

The fingerprint of bytes b_1..b_n is b_1 256^(n-1) + ... + b_n modulo a prime of 127 bits that was drawn at random. It
composes: f(AB) = f(A) 256^|B| + f(B), so that chunks are hashed apart, of huge texts in parallel tasks, and combined by
length-shifted arithmetic. Texts of equal length and fingerprint are then compared chunk by chunk with one of them; those
that differ from it are compared among themselves, until each class holds equal texts only.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._common import apart, checkpoint, forget, keep_rows, map_texts, scratch, text_key

#: Modulus: a random safe prime p = 2q + 1 with q prime, so that 256 has order q and no two places of a text weigh the same.
#: Fixed: fingerprints of different runs must compose.
PRIME = 140131192711811213458589270554428317267
#: Bytes of a chunk that is hashed or compared at a time, and bytes from which a text's chunks go to tasks of their own.
CHUNK, HUGE = 1 << 20, 64 << 20


def fingerprint(data: bytes) -> int:
    """Polynomial fingerprint of one chunk."""
    return int.from_bytes(data, "big") % PRIME


def combine(left: int, right: int, right_length: int) -> int:
    """Fingerprint of two neighbouring parts from theirs."""
    return (left * pow(256, right_length, PRIME) + right) % PRIME


def composed(data: bytes, chunk: int = CHUNK) -> int:
    """Fingerprint of a text of any length, chunk by chunk; 0 for an empty one."""
    out = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        out = combine(out, fingerprint(part), len(part))
    return out


def _packed(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _body(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _pieces(body: Column, chunk: int) -> Column:
    """Numbers of a text's chunks; an empty text has one, which is empty."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(body) / chunk).cast("int"), F.lit(1)) - 1)


def _piece(body: str, at: str, chunk: int) -> Column:
    return F.expr(f"substring({body}, {at} * {chunk} + 1, {chunk})")


def fingerprints(docs: DataFrame, key: str, text: str, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """__k (the key), __tk, len, sha and fp, 16 bytes, of each row; null text counts as empty."""
    body = _body(F.col(f"`{text}`"))
    names = ["__k", "__tk", "len", "sha"]
    base = docs.select(F.col(f"`{key}`").alias("__k"), text_key(body).alias("__tk"), F.octet_length(body).cast("long").alias("len"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), body.alias("__body"))
    fields = [T.StructField("fp", T.BinaryType())]

    def make():
        return lambda texts: [[_packed(composed(t, chunk)) for t in texts]]

    small = map_texts(base.filter(F.col("len") < huge), F.col("__body"), names, fields, make)
    parts = base.filter(F.col("len") >= huge).select(*names, F.col("__body").cast("binary").alias("__body"), F.explode(_pieces(F.col("__body"), chunk)).alias("at"))
    parts = parts.select(*names, "at", _piece("__body", "at", chunk).alias("part"))

    def hashed(batches):
        for b in batches:
            made = pa.array([_packed(fingerprint(p)) for p in b.column("part").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "h"])

    spread = parts.repartition("__k", "__tk", "at").mapInArrow(hashed, T.StructType([*parts.schema.fields[:-1], T.StructField("h", T.BinaryType())]))

    def joined(batches):
        for b in batches:
            out = []
            for n, row in zip(b.column("len").to_pylist(), b.column("hs").to_pylist(), strict=True):
                value = 0
                for item in row:
                    value = combine(value, int.from_bytes(item["h"], "big"), min(chunk, n - item["at"] * chunk))
                out.append(_packed(value))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*b.schema.names[:-1], "fp"])

    # one list per huge text: a 64 thousandth of it. Repeated rows share their chunks, and all meet the one fingerprint.
    once = spread.groupBy(*names, "at").agg(F.min("h").alias("h"))
    lists = once.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("hs"))
    found = lists.mapInArrow(joined, T.StructType([*(lists.schema[c] for c in names), *fields]))
    long = base.filter(F.col("len") >= huge).select(*names)
    met = [long[c].eqNullSafe(found[c]) for c in names]
    return small.unionByName(long.join(found, met[0] & met[1] & met[2] & met[3]).select(*[long[c] for c in names], found["fp"]))


BLOOM = "spark.sql.optimizer.runtime.bloomFilter"
#: Settings under which Spark filters a scan by a Bloom filter of the join's other side, whatever the table's size, and sends
#: no side to all tasks.
RUNTIME = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", f"{BLOOM}.enabled": "true", f"{BLOOM}.applicationSideScanSizeThreshold": "0", f"{BLOOM}.creationSideThreshold": "1TB"}


def unequal(docs: DataFrame, pairs: DataFrame, key: str, text: str, chunk: int = CHUNK, repeated: bool = True) -> DataFrame:
    """(__k, __tk) of rows whose text, compared chunk by chunk, differs from that of their group's representative; checkpointed.

    pairs: __k, __tk, g (the group), and whether it stands for it (rep), of rows with a partner. It is written and read
    again, so that Spark can filter the texts by a Bloom filter of their names where they are scanned: only texts with a
    partner move. Chunks are the unit of the shuffle and of the comparison, so a task holds one at a time, however long a
    text or large a group; both sides come straight from a shuffle, so that Spark can split a large group over tasks.

    The comparison is planned in a session of its own, under RUNTIME: other queries keep their settings. What it writes is
    deleted when its result is there.
    """
    spark = docs.sparkSession
    paths, view = [scratch(spark, "pairs"), scratch(spark, "odd")], f"docs_{uuid.uuid4().hex}"
    try:
        pairs.withColumn("size", F.lit(2)).write.parquet(paths[0])
        own = spark.newSession()
        few = own.read.parquet(paths[0])
        items = min(1 << 26, max(1 << 20, few.count()))  # at 8 bits a name: 64 MB at most, a fuller filter lets more through
        inherited = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")}
        sized = {f"{BLOOM}.{k}": str(v) for k, v in (("expectedNumItems", items), ("maxNumItems", items), ("numBits", 8 * items), ("maxNumBits", 8 * items))}
        for name, value in (inherited | RUNTIME | sized).items():
            own.conf.set(name, value)
        docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).createGlobalTempView(view)
        plain = own.table(f"global_temp.{view}")
        k, t = (F.col(f"_{docs.columns.index(c)}") for c in (key, text))
        few = few.filter("size > 1")  # the filter tells Spark that these are few of all rows
        body = _body(t)
        base = plain.select(k.alias("__dk"), text_key(body).alias("__dt"), body.cast("binary").alias("__body"))
        mine = base.join(few, base["__dk"].eqNullSafe(few["__k"]) & (base["__dt"] == few["__tk"])).select("__k", "__tk", "g", "rep", "__body")
        cut = mine.select("__k", "__tk", "g", "rep", "__body", F.explode(_pieces(F.col("__body"), chunk)).alias("at"))
        cut = cut.select("__k", "__tk", "g", "rep", "at", _piece("__body", "at", chunk).alias("part"))
        reps = cut.filter("rep").select(F.col("g").alias("rg"), F.col("at").alias("ra"), F.col("part").alias("rpart"))
        if repeated:  # one of a representative's rows; met over another form of the group, so that this side is shuffled too
            reps = reps.groupBy("rg", "ra").agg(F.min("rpart").alias("rpart"))
        reps = reps.select(F.reverse(F.hex("rg")).alias("rg"), "ra", "rpart")
        others = cut.filter("not rep").withColumn("og", F.reverse(F.hex("g")))
        met = others.join(reps, (others["og"] == reps["rg"]) & (others["at"] == reps["ra"]), "left")
        met.filter(~F.col("part").eqNullSafe(F.col("rpart"))).select("__k", "__tk").distinct().write.parquet(paths[1])
        return checkpoint(spark.read.parquet(paths[1]))
    finally:
        spark.catalog.dropGlobalTempView(view)
        for path in paths:
            forget(spark, path)


def decide(docs: DataFrame, key: str, text: str, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """One row per (__k, __tk) with n, the rows of that name, sha, and their group's size and keep, the key that stays.

    A class is a length, a fingerprint and the round in which the comparison found its representative: round 0 but for texts
    that clash.
    """
    rows = fingerprints(docs, key, text, chunk, huge)
    rows = checkpoint(rows.groupBy("__k", "__tk", "len", "sha", "fp").agg(F.count("*").alias("n")))
    repeated = not rows.filter("n > 1").isEmpty()
    group = F.concat(F.encode(F.col("len").cast("string"), "UTF-8"), F.col("fp"))
    done, left, turn = [], rows, 0
    while True:
        sizes = left.groupBy("len", "fp").agg(F.sum("n").alias("size"), F.count("*").alias("names"), F.max(F.struct(F.col("__k").alias("k"), F.col("__tk").alias("t"))).alias("r"))
        member = left.join(checkpoint(sizes.filter("names > 1")), ["len", "fp"], "left")
        pairs = member.filter("names > 1").select("__k", "__tk", group.alias("g"), (F.col("__k").eqNullSafe(F.col("r.k")) & (F.col("__tk") == F.col("r.t"))).alias("rep"))
        odd = unequal(docs, pairs, key, text, chunk, repeated)
        named = member.select("__k", "__tk", "n", "sha", "len", "fp", F.coalesce("size", "n").alias("size"), F.when(F.col("names").isNull(), F.col("__k")).otherwise(F.col("r.k")).alias("keep"))
        if odd.isEmpty():
            done.append(named.drop("len", "fp"))
            break
        # different texts under one fingerprint: those that equal the representative are a class, the others go on
        other = odd.select(F.col("__k").alias("ok"), F.col("__tk").alias("ot"), F.lit(True).alias("odd"))
        marked = checkpoint(named.join(other, named["__k"].eqNullSafe(other["ok"]) & (named["__tk"] == other["ot"]), "left"))
        same = marked.filter("odd is null").withColumn("turn", F.lit(turn))
        again = same.groupBy("len", "fp").agg(F.sum("n").alias("size"))
        done.append(same.drop("size").join(again, ["len", "fp"]).select("__k", "__tk", "n", "sha", "size", "keep"))
        left, turn = checkpoint(marked.filter("odd").select("__k", "__tk", "len", "sha", "fp", "n")), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Equal texts form a group (null and empty texts one too); the row with the largest key stays, null keys last. Of
    repeated rows with that key one stays. Texts of any length are hashed and compared by chunks, never cut off. An empty
    table gives an empty table; other columns of docs play no part, whatever their names. A key that is named like a column of
    the result is in it with _key behind its name.
    """
    found = decide(docs, key, text, chunk, huge)
    kept = F.col("__k").eqNullSafe(F.col("keep"))
    names = [F.col("__k").alias(apart(key, "keep_id", "group_size", "kept", "text_sha256")), F.col("keep").alias("keep_id"), F.col("size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    once = found.select(*names)
    if found.filter("n > 1").isEmpty():
        return once
    # the other rows of a name: dealt out by thousands, so that one that is repeated very often is not one array
    more = found.filter("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / 1000)))).repartition("__k", "__tk", "part")
    more = more.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000), F.col("n") - 1 - F.col("part") * 1000))))
    return once.unionByName(more.select(*names).withColumn("kept", F.lit(False)))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies: of equal texts the row with the largest key stays, whole and with all its columns.

    Nulls, empty and very long texts, repeated rows and empty tables are treated as by exact_duplicates.
    """
    kept = decide(docs, key, text).filter(F.col("__k").eqNullSafe(F.col("keep"))).select("__k", "__tk", "n")
    return keep_rows(docs, checkpoint(kept), key, text)
