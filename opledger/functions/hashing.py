"""Hashes whose values are part of the data model, as column expressions.

FNV-1a with 32 and 64 bits runs inside the JVM; 64-bit products would overflow
BIGINT, so the 64-bit state is kept as two 32-bit halves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the hashes and of the shard count.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
SHARDS = 10
_LOW = 4294967295


def _byte_list(text: Column) -> Column:
    hexed = F.hex(F.encode(text, "UTF-8"))
    return F.when(F.length(hexed) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")))


def fnv32(text: Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes as a BIGINT."""
    return F.aggregate(_byte_list(text), F.lit(FNV32_OFFSET).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit(_LOW)))


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    return (fnv32(key) % shards).cast("bigint")


def fnv64_halves(text: Column) -> Column:
    """FNV-1a, 64 bits, as ``struct(hi, lo)`` of 32-bit halves."""
    start = F.struct(F.lit(FNV64_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV64_OFFSET & _LOW).cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        # the prime is 2^40 + 435: the low half times 2^40 lands in the high half, 8 bits up
        lo = h["lo"].bitwiseXOR(b)
        product = lo * 435
        hi = (h["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo, 8)).bitwiseAND(F.lit(_LOW))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.aggregate(_byte_list(text), start, step)


def fnv64_hex(text: Column) -> Column:
    h = fnv64_halves(text)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def _fnv64_array(values) -> np.ndarray:
    out = np.empty(len(values), dtype=np.uint64)
    for k, v in enumerate(values):
        h = FNV64_OFFSET
        for b in (v or "").encode():
            h = ((h ^ b) * FNV64_PRIME) & 0xFFFFFFFFFFFFFFFF
        out[k] = h
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit states: shifts by 33 and two multiplications."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(33))


def distinct_hashes(values: pd.Series) -> np.ndarray:
    """FNV-1a of each value; every distinct value is hashed once."""
    codes, unique = pd.factorize(values.fillna(""))
    return _fnv64_array(unique)[codes]


@F.pandas_udf(T.LongType())
def rendezvous_order(prefix: pd.Series, worker: pd.Series) -> pd.Series:
    """Rendezvous score with its top bit flipped, so that BIGINT order is the unsigned order."""
    low = np.array([(int(h) * GOLDEN) & 0xFFFFFFFFFFFFFFFF for h in _fnv64_array(pd.unique(worker))], dtype=np.uint64)
    at = pd.Series(low, index=pd.unique(worker))
    score = mix64(distinct_hashes(prefix) ^ at.loc[worker].to_numpy())
    return pd.Series((score ^ np.uint64(1 << 63)).view(np.int64))


def crc32c_table() -> np.ndarray:
    """Byte table of the reflected Castagnoli polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0x82F63B78), out >> 1).astype(np.uint32)
    return out


_CRC = crc32c_table().tolist()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ _CRC[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def register(spark: SparkSession) -> None:
    """SQL names of the scalar functions that have no built-in counterpart."""
    spark.udf.register("rendezvous_order", rendezvous_order)
    spark.udf.register("crc32c", F.pandas_udf(lambda s: s.map(lambda b: None if b is None else crc32c(bytes(b))), T.LongType()))


def with_shard(df: DataFrame, key: str = "key") -> DataFrame:
    return df.withColumn("shard", shard_of(F.col(key)))
