"""What several operators share: the shared folder, stored tables, texts in and columns out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that a Python worker holds as objects at once, in characters; an Arrow batch is cut into slices of about this
# size. One longer text is a slice of its own.
SLICE_CHARS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the session names it in ``spark.checkpoint.dir``.

    A session without one gets a temporary folder only where the driver and the executors are one process; on a
    cluster that folder would differ from machine to machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read from there.

    Cuts the lineage: what reads the table does not run its plan again, and an executor that is lost costs only the
    tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(text: Column | str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo. A null identifier counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_CHARS characters of a text column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > SLICE_CHARS:
            yield batch.slice(first, at - first)
            first, held = at, 0
        held += int(size)
    if first < batch.num_rows:
        yield batch.slice(first)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    fields: list[T.StructField],
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """The columns of df but the text, and those that a function makes of the texts, in the order of fields.

    With ``keep_text`` the text stays too, as it came: a worker that reads it anyway gets it once.

    A column of df named as one of the fields gives way to it: what an operator makes keeps its name.

    ``make`` is called once a task and gives the function, which takes texts (null as empty) and gives one Arrow
    array for each field. No shuffle; a worker holds one slice of texts at a time.
    """
    own = {f.name for f in fields}
    kept = [f for f in df.schema.fields if (keep_text or f.name != text) and f.name not in own]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                made = work([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), *made], names=[f.name for f in schema.fields]
                )

    return df.mapInArrow(run, schema)


def longs(values: list[int | None]) -> Column:
    """A literal array of 64-bit numbers, as one expression: a column for each number would be slow to make."""

    def spelled(value: int | None) -> str:
        if value is None:
            return "CAST(NULL AS BIGINT)"
        return f"{value}L" if value > -(1 << 63) else f"({value + 1}L - 1L)"

    return F.expr(f"array({', '.join(map(spelled, values))})")


# Everything in ASCII that is neither a digit nor a letter in lower case parts words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, without empty ones; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: without it the optimiser may put it into every inner function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_shingles(df: DataFrame, words: str, name: str, size: int = 5) -> DataFrame:
    """df with the 64-bit hash of every run of ``size`` words, in order; of fewer words the one of them all, of none none.

    Words are hashed first and runs of hashes then, so that the inner function touches numbers only.
    """

    def runs(hashes: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size)))
        )
        return (
            F.when(F.size(hashes) >= size, each)
            .when(F.size(hashes) > 0, F.array(F.xxhash64(hashes)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return df.withColumn(name, let(F.transform(words, lambda w: F.xxhash64(w)), runs))
