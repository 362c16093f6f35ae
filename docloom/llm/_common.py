"""What the training-data operators share: shared-folder checkpoints, byte-level maps over Arrow, row keys."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import checkpoint_folder, ship

#: ASCII white space of the word definition: space and \t \n \v \f \r. bytes.split() splits at exactly these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: The same bytes one by one, and a pattern for them in bytes.
SPACES, _SPACE = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"), re.compile(rb"[\x20\x09-\x0D]")

TEXT = "__text"


#: Whole documents in an Arrow batch at most: Spark's default of 10,000 is meant for narrow rows.
BATCH, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers, keep Arrow batches of documents small, and see to a checkpoint folder."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH:
        spark.conf.set(BATCH_KEY, str(BATCH))
    ship(spark)
    checkpoint_folder(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder for a table that is written and read again."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch() gave, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that have one of these names, whatever their case: an operator's own columns replace them."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def apart(key: str, *own: str) -> str:
    """The name of the key column in a result that has columns of its own: the key's, or with _key behind it where one has that."""
    return f"{key}_key" if key.lower() in own else key


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def held_out(key: Column, mod: int, rest: int) -> Column:
    """Whether a row is held out of training. Rows without a key are never learned from."""
    return F.coalesce(remainder(key, mod) == rest, F.lit(True))


def map_texts(
    df: DataFrame,
    text: Column,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list]],
    model: str | None = None,
) -> DataFrame:
    """Append columns that are computed from each row's text, as bytes (None if null).

    make() runs once per task and gives a function from a list of texts to one list (or Arrow array) per field. The
    columns in keep pass through unchanged, unless a field replaces them. model names what make() takes from
    worker_cache(); a worker forgets the models of other operators, so that it holds one at a time.
    """
    prepare(df.sparkSession)
    taken = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in taken]
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], text.cast("string").cast("binary").alias(TEXT))
    schema = T.StructType([narrow.schema[c] for c in keep] + fields)
    kinds = [_arrow(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in set(worker_cache()) - {model}:
            del worker_cache()[name]
        work = make()
        for whole in batches:
            for batch in _pieces(whole):
                columns = work(batch.column(batch.num_columns - 1).to_pylist())
                made = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)
            pa.default_memory_pool().release_unused()

    return narrow.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about most bytes of text each: Python objects of long texts never pile up."""
    if batch.num_rows == 0 or batch.nbytes <= most:
        yield batch
        return
    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker: models are unpacked once per process, not once per task."""
    return sys.modules[__name__].__dict__.setdefault("_WORKER", {})


def blocks(data: bytes, most: int) -> Iterator[bytes]:
    """Parts of most bytes or so, each ending behind white space, so that no word is cut. A longer word stays whole in a
    longer part; only the last part may end without white space."""
    start, size = 0, len(data)
    while size - start > most:
        cut = 1 + max(data.rfind(c, start, start + most) for c in SPACES)
        if cut <= start:  # one word fills the part: it goes on to its end
            found = _SPACE.search(data, start + most)
            if not found:
                break
            cut = found.end()
        yield data[start:cut]
        start = cut
    if start < size:
        yield data[start:]


def text_key(text: Column) -> Column:
    """MD5 of a text, 16 bytes, null counting as empty. With the row's key it names a row without moving its text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def boxed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs as __k (the key), __tk (see text_key) and __row, all columns by their position: names can't clash."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    k, t = (plain.columns[docs.columns.index(c)] for c in (key, text))
    return plain.select(F.col(k).alias("__k"), text_key(F.col(t)).alias("__tk"), F.struct(*plain.columns).alias("__row"))


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from the __row of boxed()."""
    return rows.select("__row.*").toDF(*docs.columns)


def keep_rows(docs: DataFrame, keepers: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs that keepers name by (__k, __tk), each once; n there is the number of docs' rows of that name.

    A name that fits several rows means rows equal in key and text; of those one stays. Nulls in key match nulls. Columns of
    docs may have any names.
    """
    named = boxed(docs, key, text)
    k = keepers.select(F.col("__k").alias("__wk"), F.col("__tk").alias("__wt"), F.col("n").alias("__wn"))
    hit = named.join(k, named["__k"].eqNullSafe(k["__wk"]) & (named["__tk"] == k["__wt"]), "inner")
    once = hit.filter("__wn = 1")
    if not k.filter("__wn > 1").isEmpty():
        again = hit.filter("__wn > 1").dropDuplicates(["__wk", "__wt"])
        once = once.unionByName(again)
    return unboxed(once, docs)
