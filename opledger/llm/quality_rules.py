"""Quality rules: basic word counts and zstandard compression bands.

A text's compressed share (compressed bytes over bytes) must lie in the band of
its length: below it the text repeats itself, above it the text is noise.  Texts
are also compressed in chunks, of ``CHUNK`` bytes or of ``SMALL_CHUNK`` in texts
under two ``CHUNK``, so that a repetitive or incompressible stretch shows that the
whole text's share would hide.  The last chunk ends with the text and may overlap.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm.common import long_id, map_batches, texts

LEVEL, CHUNK, SMALL_CHUNK = 3, 4096, 512
#: From so many bytes on (to the next row's), the least and the largest share that is kept.
BANDS = ((0, 0.0, 9.9), (64, 0.45, 1.25), (128, 0.40, 1.00), (256, 0.36, 0.88), (512, 0.33, 0.80), (1024, 0.30, 0.74), (4096, 0.27, 0.70), (65536, 0.24, 0.68))
#: A chunk's band, and the share of chunks that may lie outside.  A small chunk's band is that of a text of its length.
CHUNK_BAND, CHUNK_SHARE = (0.30, 0.72), 0.25
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

SCHEMA = T.StructType([
    long_id(), *(T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False), T.StructField("zstd_share", T.DoubleType(), False), T.StructField("bad_chunks", T.DoubleType(), False),
])


def repeated_words(words: list, width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window which the list holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    starts = np.fromiter((times[w] > 1 for w in windows), dtype=bool, count=n)
    cover = np.zeros(len(words), dtype=bool)
    for k in range(width):
        cover[k : k + n] |= starts
    return int(cover.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def compression(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Compressed share of the text, and the share of its chunks outside their band."""
    if not data:
        return 0.0, 0.0
    whole = len(compressor.compress(data)) / len(data)
    size, (low, high) = (CHUNK, CHUNK_BAND) if len(data) >= 2 * CHUNK else (SMALL_CHUNK, band(SMALL_CHUNK))
    if len(data) <= size:
        return whole, 0.0
    starts = [*range(0, len(data) - size, size), len(data) - size]
    shares = [len(compressor.compress(data[k : k + size])) / size for k in starts]
    return whole, sum(not low <= x <= high for x in shares) / len(shares)


def band(size: int) -> tuple[float, float]:
    """The least and the largest share of a text of ``size`` bytes."""
    return next((lo, hi) for start, lo, hi in reversed(BANDS) if size >= start)


def passes(size: int, share: float, bad_chunks: float) -> bool:
    low, high = band(size)
    return low <= share <= high and bad_chunks <= CHUNK_SHARE


def judge(text: str, compressor: zstandard.ZstdCompressor) -> tuple:
    """The columns of one text after ``doc_id``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: ASCII white space only
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * len(words)
    share, bad = compression(data, compressor)
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), duplicate_lines(data), repeat,
        failed, not failed and passes(len(data), share, bad), share, bad,
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and verdict.

    A null text has no words and is rejected, as an empty one is.  Repeated rows
    are judged each for itself; a null ``doc_id`` stays null; other columns are
    not read; an empty table gives no rows.  A text of any length is judged whole.
    """

    def start():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge(t, compressor) for t in texts(batch.column(1))]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=SCHEMA.names)

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), SCHEMA, start)


def keep_passing(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents the rules reject; all columns stay.

    Null and empty texts are rejected.  Repeated rows and rows without an id are judged
    each for itself; an empty table stays empty; a text of any length is judged whole.
    """
    at = docs.columns.index("text")

    def start():
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return lambda batch: batch.filter(pa.array([judge(t, compressor)[6] for t in texts(batch.column(at))], pa.bool_()))

    return map_batches(docs, docs.schema, start)
