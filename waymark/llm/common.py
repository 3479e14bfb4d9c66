"""What the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, as in tests, local mode takes a temporary one; a cluster has no folder to take, so it fails."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def few_samples(spark: SparkSession) -> Iterator[None]:
    """Within, Spark takes a tenth of its usual sample to find the bounds of a range sort: the sample goes to the driver, and with long keys and many partitions would not fit there."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "10")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The share of all rows over which a key is hot is one in so many; there are fewer such keys than this.
HOT = 500


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined by `on` with table, which has each key once, with n, how many of the rows have it; n isn't returned. how: inner, or left to keep rows of other keys.

    A key with more than one in HOT of all the rows would load one task, so the fewer than HOT entries of such keys are broadcast and their rows stay where they
    are; all others are shuffled. table is read three times: it should be a written one.
    """
    bound = (table.agg(F.sum("n")).first()[0] or 0) / HOT
    hot, cold = F.broadcast(table.where(F.col("n") > bound)), table.where(F.col("n") <= bound)
    return rows.join(hot.drop("n"), on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold.drop("n"), on, how))


def map_texts(df: DataFrame, text: str, fn: Callable[[list[str | None]], dict[str, list]], added: T.StructType) -> DataFrame:
    """df with the columns of `added`, which fn makes from the texts of a batch.

    Narrow: rows stay where they are. The columns of df travel inside one struct, so that none of their names can clash;
    a column of df that is named as an added one is replaced. Batches are handed to fn in runs of at most about 4 MB of
    text, so memory follows the longest text and not the batch.
    """
    kept = [c for c in df.columns if c not in added.fieldNames()]
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text") if text not in kept else F.lit(None).cast("string").alias("text"))
    at = kept.index(text) if text in kept else None
    out = T.StructType([packed.schema["row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, at):
                row = part.column(0)
                texts = (row.field(at) if at is not None else part.column(1)).to_pylist()
                made = fn(texts)
                yield pa.RecordBatch.from_arrays([row, *[pa.array(made[f.name], arrow_type(f.dataType)) for f in added.fields]], ["row", *added.fieldNames()])

    done = packed.mapInArrow(run, out)
    return done.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], *added.fieldNames())


def runs(batch: pa.RecordBatch, at: int | None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes, of a row at least."""
    n = batch.num_rows
    if not n:
        return
    rows = max(1, int(n * most / max(1, batch.nbytes)))
    for i in range(0, n, rows):
        yield batch.slice(i, rows)


def arrow_type(t: T.DataType) -> pa.DataType:
    simple = {T.StringType: pa.string(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.IntegerType: pa.int32()}
    if isinstance(t, T.ArrayType):
        return pa.list_(pa.field("element", arrow_type(t.elementType), t.containsNull))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType), f.nullable) for f in t.fields])
    return simple[type(t)]


HELD: dict[tuple, object] = {}


def give_back() -> None:
    """Hands memory that isn't used any more back to the system, where the C library can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)



def held(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps for the operator at work: a table, a model, memos. Another operator's is let go, as workers live on."""
    if key not in HELD:
        HELD.clear()
        give_back()
        HELD[key] = make()
    return HELD[key]


class Memo(dict):
    """A function's results by key, at most 2 * size of them: what was not asked for again since the last half fill is forgotten."""

    def __init__(self, fn: Callable, size: int = 200_000):
        super().__init__()
        self.fn, self.size, self.old = fn, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
