"""Codecs of stored values, as column expressions; what cannot be decoded has a defined value."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def counter(value: Column) -> Column:
    """Big-endian 8-byte counter; any other length is 0."""
    return F.when(F.octet_length(value) == 8, F.conv(F.hex(value), 16, 10).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))


def leader(value: Column) -> Column:
    """``holder|until`` split at the last bar."""
    text = value.cast("string")
    until = F.substring_index(text, "|", -1)
    return F.struct(F.substr(text, F.lit(1), F.length(text) - F.length(until) - 1).alias("holder"), until.try_cast("bigint").alias("until_ms"))


def idempotency(value: Column) -> Column:
    """``id|n`` is a bound job, ``pending|until`` a reservation."""
    text = value.cast("string")
    kind, rest = F.substring_index(text, "|", 1), F.substring_index(text, "|", -1).try_cast("bigint")
    return F.struct(F.when(kind == "id", rest).alias("job_id"), F.when(kind == "pending", rest).alias("pending_until_ms"))


@F.pandas_udf(T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("last_ms", T.LongType())]))
def bucket(value: pd.Series) -> pd.DataFrame:
    """Token bucket of 16 big-endian bytes; another length gives nulls, which count as a fresh bucket."""
    rows = [struct.unpack(">dq", v) if v is not None and len(v) == 16 else (None, None) for v in value]
    return pd.DataFrame(rows, columns=["tokens", "last_ms"]).astype({"tokens": "float64", "last_ms": "Int64"})


@F.pandas_udf(T.StructType([T.StructField("stored_ms", T.LongType()), T.StructField("prompt", T.StringType()), T.StructField("text", T.StringType())]))
def entry(value: pd.Series) -> pd.DataFrame:
    """Cache entry: big-endian time and prompt length, prompt, text; what does not fit is a miss (nulls)."""
    rows = []
    for v in value:
        if v is None or len(v) < 12:
            rows.append((None, None, None))
            continue
        stored, n = struct.unpack_from(">QI", v)
        rows.append((stored, bytes(v[12 : 12 + n]).decode("utf-8", "replace"), bytes(v[12 + n :]).decode("utf-8", "replace")) if 12 + n <= len(v) else (None, None, None))
    return pd.DataFrame(rows, columns=["stored_ms", "prompt", "text"]).astype({"stored_ms": "Int64"})
