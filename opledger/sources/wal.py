"""Write-ahead log files: a reader and a writer as Python data sources.

A record is a little-endian length, the Castagnoli checksum of the payload, and
the payload.  A file is read by one task; the status says what a replay makes of
a record: ``ok``, ``torn`` (the tail that a crash left) or ``corrupt``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.functions.hashing import crc32c
from opledger.shipping import ship

HEADER, MOST_PAYLOAD = 8, 64 << 20

SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("status", T.StringType()),
])


def records(data: bytes) -> Iterator[tuple[int, int, int, bytes | None, str]]:
    """``(offset, length, crc, payload, status)`` up to the first record that cannot be read.

    A zero length is the clean end of a preallocated file if only zeros follow.  A
    bad checksum or an impossible length is a torn tail at the end of the file and
    corruption before it.
    """
    at, size = 0, len(data)
    while at < size:
        if size - at < HEADER:
            yield at, 0, 0, None, "torn"
            return
        length, crc = struct.unpack_from("<II", data, at)
        if length == 0:
            if data[at:].strip(b"\0"):
                yield at, 0, crc, None, "corrupt"
            return
        end = at + HEADER + length
        if end > size:
            yield at, length, crc, None, "torn"
            return
        payload = data[at + HEADER : end]
        if length > MOST_PAYLOAD or crc32c(payload) != crc:
            yield at, length, crc, None, "torn" if end == size else "corrupt"
            return
        yield at, length, crc, payload, "ok"
        at = end


def encoded(payloads: list[bytes]) -> bytes:
    """Records of a batch; empty and oversized payloads are refused before anything is written."""
    if any(not p or len(p) > MOST_PAYLOAD for p in payloads):
        raise ValueError("a payload must have 1 byte to 64 MiB")
    return b"".join(struct.pack("<II", len(p), crc32c(p)) + p for p in payloads)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files at ``path``, by whatever file system Spark reads."""
    ship(spark)

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, *r) for r in records(data.as_py())]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=SCHEMA.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, SCHEMA)


def replay(wal: DataFrame) -> DataFrame:
    """Payloads in append order; fails on corruption before the tail."""
    checked = wal.withColumn("payload", F.when(F.col("status") == "corrupt", F.raise_error(F.concat(F.lit("corrupt record in "), "file")).cast("binary")).otherwise(F.col("payload")))
    return checked.filter("status <> 'torn'").orderBy("file", "offset").select("file", "offset", "payload")


def valid_end(wal: DataFrame) -> DataFrame:
    """Where each file's last whole record ends: what an opening writer truncates to."""
    return wal.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("status") == "ok", F.col("offset") + HEADER + F.col("length"))), F.lit(0)).alias("valid_end"), F.max((F.col("status") == "corrupt").cast("int")).alias("corrupt"))


def write_wal(payloads: DataFrame, path: str) -> None:
    """Write ``payload``s in the order of ``idx`` as one log file a partition.

    ``path`` is a folder that driver and executors share, as a path or a URI of a
    file system that Arrow knows.  Spark sorts each partition, a task writes its rows
    as they come, and the files get their names when the job commits; what an
    attempt that failed has written is never named.
    """
    ship(payloads.sparkSession)
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    class Writer(DataSourceArrowWriter):
        def __init__(self, options):
            self.path = options["path"]

        def write(self, batches):
            import uuid

            from pyarrow.fs import FileSystem

            fs, root = FileSystem.from_uri(self.path)
            fs.create_dir(root, recursive=True)
            message = WriterCommitMessage()
            message.name, message.first = f"{root}/.{uuid.uuid4().hex}.tmp", None
            with fs.open_output_stream(message.name) as out:
                for batch in batches:
                    if batch.num_rows:
                        message.first = batch.column(0)[0].as_py() if message.first is None else message.first
                        out.write(encoded(batch.column(1).to_pylist()))
            return message

        def commit(self, messages):
            from pyarrow.fs import FileSystem

            fs, root = FileSystem.from_uri(self.path)
            written = sorted((m for m in messages if m is not None), key=lambda m: (m.first is None, m.first))
            for k, m in enumerate(written):
                fs.move(m.name, f"{root}/wal-{k:05d}.log")

        def abort(self, messages):
            import contextlib

            from pyarrow.fs import FileSystem

            fs, _ = FileSystem.from_uri(self.path)
            for m in messages:
                if m is not None:
                    with contextlib.suppress(OSError):
                        fs.delete_file(m.name)

    class Wal(DataSource):
        @classmethod
        def name(cls):
            return "opledger_wal"

        def schema(self):
            return "idx long, payload binary"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    payloads.sparkSession.dataSource.register(Wal)
    payloads.select(F.col("idx").cast("long").alias("idx"), "payload").sortWithinPartitions("idx").write.format("opledger_wal").mode("append").option("path", path).save()


#: Fixed value: how a persister's file begins.
MAGIC = b"RAF1"


def persister_file(state: bytes, snapshot: bytes | None) -> bytes:
    """A persister's file: magic, both lengths, state, snapshot, checksum of all before."""
    body = MAGIC + struct.pack("<II", len(state), len(snapshot or b"")) + state + (snapshot or b"")
    return body + struct.pack("<I", crc32c(body))


def persisted(data: bytes) -> tuple[bytes, bytes | None] | None:
    """State and snapshot (null if empty) of a persister's file, or None if it is not whole."""
    if len(data) < 16 or data[:4] != MAGIC:
        return None
    n, m = struct.unpack_from("<II", data, 4)
    if len(data) != 16 + n + m or crc32c(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        return None
    return data[12 : 12 + n], data[12 + n : 12 + n + m] or None


def read_persisted(spark: SparkSession, path: str) -> DataFrame:
    """``(file, state, snapshot, corrupt)`` of the persister files at ``path``."""
    ship(spark)

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            got = [persisted(x) for x in batch.column(1).to_pylist()]
            parts = [(g or (None, None)) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in parts], pa.binary()), pa.array([x for _, x in parts], pa.binary()), pa.array([g is None for g in got])], names=["file", "state", "snapshot", "corrupt"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, state binary, snapshot binary, corrupt boolean")


def with_snapshot_version(state: DataFrame, version: int = 1) -> DataFrame:
    return state.withColumn("schema_version", F.lit(version))


def restored(snapshot: DataFrame, version: int = 1) -> DataFrame:
    """A snapshot's rows; one of another version fails the query."""
    told = F.when(F.col("schema_version") == version, F.lit(True)).otherwise(F.raise_error("unknown snapshot version").cast("boolean"))
    return snapshot.filter(told).drop("schema_version")
