"""Sequence packing by Karmarkar-Karp multiway differencing.

A document is the ids of its text and an end id.  Stretches of ``capacity`` ids
become sequences of their own; what is left over, in pieces of ``PIECE`` ids at
most, is gathered from ``GROUP`` documents of the same task and differenced into
near-equal windows.  No shuffle is needed, memory is bounded by a group, and a
task that runs again gives the same sequences.  Only the last group of a task is
smaller, so the loss by padding does not grow with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm import kk
from opledger.llm.common import bounded_batches, task_index
from opledger.llm.subwords import word_encoder

CAPACITY = 2048
END_ID = 1
#: Documents whose left-over ids are differenced together, and the longest piece of them.
GROUP, PIECE = 512, 512

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False),
    T.StructField("doc_tokens", T.LongType(), False), T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False),
])


class Packer:
    """Turns documents' ids into piece rows; :meth:`flush` ends a group."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, piece: int = PIECE):
        self.next_id, self.capacity, self.piece = first_id, capacity, piece
        self.rows: list[tuple] = []
        self.open: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._row(doc_id, at, ids[at : at + self.capacity], n, self.next_id, 0)
            self.next_id += 1
            at += self.capacity
        while at < n:
            part = ids[at : at + self.piece]
            self.open.append((doc_id, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), n))
            at += len(part)

    def _row(self, doc_id, at, part, n, sequence, offset):
        self.rows.append((doc_id, at, len(part), zlib.crc32(part.astype("<u4").tobytes()), n, sequence, offset))

    def flush(self) -> None:
        window = kk.pack([p[2] for p in self.open], self.capacity)
        fill: dict[int, int] = {}
        for p, w in zip(self.open, window.tolist(), strict=True):
            at = fill.get(w, 0)
            self.rows.append((*p, self.next_id + w, at))
            fill[w] = at + p[2]
        self.next_id += int(window.max()) + 1 if len(window) else 0
        self.open = []

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in range(7)]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.name for f in SCHEMA])


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence.

    A null or empty text is a document of the end id alone.  Repeated rows are
    packed each for itself; a null ``doc_id`` stays null.  Other columns are not
    read.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        packer, held = Packer(task_index() << 36, capacity, piece), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.append(encode((text.as_py() or "").encode()), END_ID))
                held += 1
                if held == group:
                    packer.flush()
                    held = 0
            yield packer.taken()
        packer.flush()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
