"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.shipping import ship

#: Rows of one Arrow batch: bounds a Python worker's memory on tables of long texts.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; lowers the session's limit, never raises it.

    Also sends the package to workers that lack it.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; one of its own where the setting is absent and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='opledger-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/opledger-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a :func:`materialised` table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/opledger-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def map_batches(df: DataFrame, schema: T.StructType, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with a per-task set-up: ``start()`` returns the batch function."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Bytes of a column of strings; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_bucket(column, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def long_id(name: str = "doc_id") -> T.StructField:
    return T.StructField(name, T.LongType())


def summed(parts: DataFrame, slices: int) -> list[bytes]:
    """Slice-wise sum of partial float64 vectors, in slice order.

    ``parts`` has rows ``(slice int, vec binary)``, a slice's vectors all of one
    length.  Tasks add what they receive as a stream, so their memory is bounded
    by the slices; the driver gets ``slices`` vectors.  A slice that no row names
    is missing from the result and comes back as an empty byte string.
    """
    schema = "slice int, vec binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, dtype=np.float64)
                if s in total:
                    total[s] += x
                else:
                    total[s] = x.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "vec"])

    wide = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("slice", "salt").select("slice", "vec").mapInArrow(add, schema)
    rows = wide.repartition("slice").mapInArrow(add, schema).collect()
    out = [b""] * slices
    for r in rows:
        out[r[0]] = bytes(r[1])
    return out


#: Rows of one key that one task joins, and frequent keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1024, 200_000


class Spread:
    """Joins on a key of which some values may be very frequent.

    Rows of a value with more than ``HOT_ROWS`` rows are dealt to parts, and what is
    joined to them is copied to each part.  ``counts`` has the key and its rows; the
    frequent values, at most one for ``HOT_ROWS`` rows, are broadcast.  Beyond
    ``HOT_KEYS`` of them the join is a plain one, whose largest partitions are left to
    Spark's own splitting.
    """

    def __init__(self, counts: DataFrame, key: str, n: str, most: int = HOT_ROWS):
        self.key = key
        hot = counts.filter(F.col(n) > most).select(key, (F.col(n) / most + 1).cast("int").alias("_parts")).limit(HOT_KEYS + 1)
        found = hot.toArrow()
        self.hot = F.broadcast(counts.sparkSession.createDataFrame(found, hot.schema)) if 0 < found.num_rows <= HOT_KEYS else None

    def parts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of parts of their key as ``_parts``."""
        if self.hot is None:
            return rows.withColumn("_parts", F.lit(1))
        return rows.join(self.hot, self.key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))

    def join(self, rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        if self.hot is None:
            return rows.join(facts, self.key, how)
        dealt = self.parts(rows).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_parts")
        copied = self.parts(facts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        return dealt.join(copied, [self.key, "_part"], how).drop("_part")


def free_name(name: str, df: DataFrame) -> str:
    """The name, or the first with underscores before it, that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def task_index() -> int:
    return TaskContext.get().partitionId()
