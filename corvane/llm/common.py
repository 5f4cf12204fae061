"""Helpers of the training-data operators: scratch tables, Arrow passes and text bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on one machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/corvane-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, so a lost
    executor costs nothing that came before, and Spark knows its size for later joins."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if (held := _HELD.get()) is not None:
        held.append(path)
    return out


#: Paths of the tables written inside scope().
_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables of written(), once all that was read from them is written itself."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


@contextmanager
def scope(spark: SparkSession):
    """Yields a function that writes a frame like written() and deletes all other tables written in the
    scope until then: what its stages made on the way."""
    token = _HELD.set([])

    def settle(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        for path in _HELD.get():
            if path != out.scratch_path:
                _delete(spark, path)
        _HELD.set([out.scratch_path])
        return out

    try:
        yield settle
    finally:
        _HELD.reset(token)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once results built on them are stored."""
    _delete(spark, scratch_dir(spark))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text; None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about SLICE_BYTES of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= SLICE_BYTES:
            yield batch
            continue
        sizes = [len(x) if x is not None else 0 for x in text_bytes(column)]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def typed(arrays: dict[str, pa.Array | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, f.type) for a, f in ((arrays[f.name], f) for f in schema)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def with_doc_id(docs: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in fields)])


def map_texts(docs: DataFrame, work: Callable, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """One row per row of docs: doc_id and what work(list of text bytes) gives for each field."""
    schema = with_doc_id(docs, *fields)
    out = arrow_schema(schema)
    names = [n for n, _ in fields]

    def run(batches):
        for batch in slices(batches):
            got = work(text_bytes(batch.column(1)))
            yield typed({"doc_id": batch.column(0).cast(out.field(0).type), **dict(zip(names, got, strict=True))}, out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_rows(docs: DataFrame, verdicts: Callable) -> DataFrame:
    """The rows of docs, all columns untouched, for which verdicts(list of text bytes) is true."""

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(verdicts(text_bytes(batch.column(batch.schema.get_field_index("text")))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def most_frequent(counts: DataFrame, most: int) -> list:
    """The rows (..., n) of the greatest counts n, at most so many, no count in part.

    A histogram of counts on a log scale tells where to cut, so that no task sorts or merges them.
    """
    placed = counts.withColumn("bucket", F.floor(F.log2("n") * 64))
    cut, held = None, 0
    for r in sorted(placed.groupBy("bucket").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["bucket"]):  # 4,096 rows at most
        held += r["k"]
        if held > most:
            break
        cut = r["bucket"]
    return [] if cut is None else placed.where(F.col("bucket") >= cut).drop("bucket").collect()  # `most` rows at most


def in_fold(modulus: int, remainder: int):
    """Whether crc32(doc_id as text) leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
