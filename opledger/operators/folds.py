"""Ordered folds: one state per key, advanced by its rows in order.

State that later rows do not need is a window (``operators.kv.classify``); what
depends on its own outcomes is folded.  A fold's rows are sorted by Spark within
hash partitions and pass as a stream, so a key's rows are never held at once and
one key's length is bounded by its task's time alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opledger.shipping import ship


def fold(rows: DataFrame, keys: list[str], order: list[str], init: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], schema: str, finish: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """Rows that ``step(state, row)`` gives for each row, and ``finish(key, state)`` after a key's last.

    ``state`` is what ``init()`` made; ``step`` changes it in place.
    """
    ship(rows.sparkSession)
    out_schema = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=out_schema.names)

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key:
                    if finish is not None and key is not None:
                        out += finish(key, state)
                    key, state = now, init()
                out += step(state, row)
            if out:
                yield made(out)
        if finish is not None and key is not None and (out := finish(key, state)):
            yield made(out)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out_schema]
    # By the keys' hash: an exchange by the keys themselves is left out after a join by
    # them, and an adaptive plan then reads that join's rows by map task, which splits a key.
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)
