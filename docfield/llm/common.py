"""What the operators share: tables, Arrow batches of texts, the shared folder, bounded worker caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch of texts is worked on in slices of at most this many bytes (one longer text is a slice of its own).
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing (tests, a laptop in local mode) a folder is made and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that stored() made in this process and that are still there.
MADE: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the folders that stored() made from the one numbered `since` on, but for the last `keep`. Tables that read them are gone, too."""
    jvm = spark.sparkContext._jvm
    for path in MADE[since : len(MADE) - keep]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        MADE.remove(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `limit` bytes at most, so that memory doesn't depend on text length."""
    for batch in batches:
        texts = batch.column(column)
        if texts.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


class Bounded(dict):
    """A worker's cache: `make(key)` fills it, and it is emptied at `size` entries, so memory stays bounded on any input."""

    def __init__(self, make: Callable, size: int):
        self.make, self.size = make, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.make(key)
        return value


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that most operators read, so the scan reads no more."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """values combined with all before them, by doubling: in round k each takes in the one 2^k places before, so n log n steps."""
    rounds = F.slice(F.sequence(F.lit(0), F.lit(30)), F.lit(1), F.when(F.size(values) > 1, F.length(F.bin(F.size(values) - 1))).otherwise(0))

    def step(s: Column, k: Column) -> Column:
        shift = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(s))
        return F.zip_with(s, F.concat(F.array_repeat(zero, shift), F.slice(s, F.lit(1), F.size(s) - shift)), combine)

    return F.aggregate(rounds, values, step)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
