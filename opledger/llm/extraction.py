"""Main text of web pages by wrappers inferred for each host."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm import wrappers
from opledger.llm.common import bounded_batches, dropped, materialised, texts
from opledger.llm.urls import host_of

#: Shapes whose numbers a task adds up before it sends them on, wrappers it holds, and parts of a host that are aligned apart.
HELD_SHAPES, HELD_HOSTS, PARTS = 5000, 500, 16
#: Bytes of wrappers that are broadcast at most; beyond, they are joined to the pages.
BROADCAST_BYTES = 32 << 20

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
_KIND = "host string, part int, shape string, numbers array<long>"


def _batch(rows: list[tuple[str | None, int, str, list[int]]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "part", "shape", "numbers"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's expression; those of one host and shape are added up."""
    held: dict[tuple[str, str], list[int]] = {}

    def rows() -> pa.RecordBatch:
        return _batch([(host, wrappers.zlib.crc32(shape.encode()) % PARTS, shape, numbers) for (host, shape), numbers in held.items()])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            shape, numbers = wrappers.packed(wrappers.expression(wrappers.parsed(page)[0]))
            key = (host, shape)
            held[key] = wrappers.added(held[key], numbers) if key in held else numbers
        if len(held) > HELD_SHAPES:
            yield rows()
            held.clear()
    if held:
        yield rows()


def _aligned(by_part: bool):
    """Batch function over rows sorted by host, part and shape: aligns those of one host (and part) in that order.

    Rows of one shape are added up before they are aligned, so the wrapper does not
    depend on how pages were dealt to tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shape = numbers = wrapper = None

        def aligned() -> wrappers.Node:
            return wrappers.merge(wrapper, wrappers.unpacked(shape, numbers))

        def row() -> pa.RecordBatch:
            return _batch([(key[0], key[1], *wrappers.packed(aligned()))])

        for batch in batches:
            for host, part, next_shape, next_numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = (host, part if by_part else 0)
                if mine == key and next_shape == shape:
                    numbers = wrappers.added(numbers, next_numbers)
                    continue
                if key is not None:
                    if mine == key:
                        wrapper = aligned()
                    else:
                        yield row()
                        wrapper = None
                key, shape, numbers = mine, next_shape, next_numbers
        if key is not None:
            yield row()

    return run


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, shape, numbers)`` of all hosts: shapes are added up in tasks, aligned in parts of hosts, and then for hosts."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_shapes, _KIND)
    parts = rows.repartition("host", "part").sortWithinPartitions("host", "part", "shape").mapInArrow(_aligned(True), _KIND)
    return parts.repartition("host").sortWithinPartitions("host", "part").mapInArrow(_aligned(False), _KIND).select("host", "shape", "numbers")


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null page is empty, and an empty page has an empty text; an empty table gives
    no rows.  Pages without a host share one wrapper.  Repeated rows come back each;
    nulls of ``page_id`` and ``url`` stay; other columns are not read.  Nesting and
    length have no limit but a task's memory for one page.  Of parts with equal
    weight the first is the main one.
    """
    bounded_batches(pages.sparkSession)
    known = materialised(infer_wrappers(pages))
    size = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("shape") + 8 * F.size("numbers")), F.lit(0))).first()[0]
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host_of(url).alias("host"))
    shared = None
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2]) for r in known.collect()})
        dropped(known)
        rows = rows.withColumns({"shape": F.lit(None).cast("string"), "numbers": F.lit(None).cast("array<long>")})
    else:
        rows = rows.join(known, "host", "left").select("page_id", "url", "html", "host", "shape", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, wrappers.Wrapper] = {}
        for batch in batches:
            out = []
            for page, host, shape, numbers in zip(texts(batch.column(2)), *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                if host not in ready:
                    if len(ready) >= HELD_HOSTS:
                        ready.clear()
                    ready[host] = wrappers.Wrapper(wrappers.unpacked(*(shared.value[host] if shared else (shape, numbers))))
                out.append(ready[host].main_text(page))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=SCHEMA.names)

    return rows.mapInArrow(run, SCHEMA)
