"""URL filter: rules, then listed canonical URLs by a blocked Bloom filter and an exact join.

A page's keys are its canonical URL and the root URL of its host and of each
parent domain.  Keys that the filter passes are joined with the list, which removes
its false positives; a page with no such key never reaches the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.shipping import ship

#: The rules of the query, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Sites that the query lists by their root URL.
LISTED_NAMES, LISTED_ZONES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("example.com", "example.net", "example.org")
#: Bits of a block (as 64-bit words), bits set in a block by a key, bits a key takes up, and most blocks (8 MB).
WORDS, PROBES, BITS_PER_KEY, MOST_BLOCKS = 4, 6, 16, 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def listed_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"http://{n}.{z}/",) for n in LISTED_NAMES for z in LISTED_ZONES], "url string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null and others: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path as ``http`` URL: no closing dot, no doubled or closing slashes, no empty path."""
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    return F.concat(F.lit("http://"), F.regexp_replace(host, r"\.$", ""), F.when(path == "", F.lit("/")).otherwise(path))


def keys_of(host: Column, path: Column) -> Column:
    """Canonical URL and the roots of the host and its parents; none without a host."""
    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    roots = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("http://"), F.array_join(F.slice(labels, k, F.size(labels)), "."), F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(canonical(host, path)), roots)))


class BlockedBloom:
    """One block of ``64 * WORDS`` bits for each key; all its probes lie in that block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        h = h.view(np.uint64)
        block = (h >> np.uint64(32)) % np.uint64(blocks)
        low, probes = h & np.uint64(0xFFFFFFFF), []
        for k in range(PROBES):
            at = ((low * np.uint64(2 * k + 1) + np.uint64(k * 0x9E3779B1)) >> np.uint64(7)) % np.uint64(64 * WORDS)
            probes.append(((at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))))
        return block.astype(np.int64), probes

    def __contains__(self, key) -> bool:
        return bool(self.hits(np.array([key], dtype=np.int64))[0])

    def hits(self, h: np.ndarray) -> np.ndarray:
        block, probes = self.places(h, len(self.bits))
        out = np.ones(len(h), dtype=bool)
        for word, bit in probes:
            out &= (self.bits[block, word] & bit) != 0
        return out

    @classmethod
    def of(cls, hashes: DataFrame, keys: int) -> BlockedBloom:
        """Filter of ``hashes (h long)``: tasks set bits, and blocks are joined by OR before they reach the driver."""
        blocks = int(min(max(1, -(-keys * BITS_PER_KEY // (64 * WORDS))), MOST_BLOCKS))
        names = [f"w{k}" for k in range(WORDS)]

        def bits(batches):
            for pdf in batches:
                block, probes = cls.places(pdf["h"].to_numpy(dtype=np.int64), blocks)
                grid = np.zeros((len(pdf), WORDS), dtype=np.uint64)
                for word, bit in probes:
                    grid[np.arange(len(pdf)), word] |= bit
                yield pd.DataFrame({"block": block, **{n: grid[:, k].view(np.int64) for k, n in enumerate(names)}})

        rows = hashes.mapInPandas(bits, "block long, " + ", ".join(f"{n} long" for n in names)).groupBy("block").agg(*(F.expr(f"bit_or({n})").alias(n) for n in names)).collect()
        out = np.zeros((blocks, WORDS), dtype=np.uint64)
        for r in rows:
            out[r[0]] = np.array(r[1:], dtype=np.int64).view(np.uint64)
        return cls(out)


def judge_urls(pages: DataFrame, listed: DataFrame, *, rules=RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest rule whose host is the page's or a parent of it and whose path
    begins the page's decides; ties, which equal rules alone can make, go to the
    first.  Without a rule a page is blocked if it, its host or a parent domain is
    listed.  A null URL has neither host nor path and is allowed.  Null list
    entries match nothing.  Repeated pages come back each.
    """
    spark = pages.sparkSession
    ship(spark)
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, by_rule = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(by_rule)
    base = base.withColumn("rule", rule).withColumn("by_rule", by_rule)

    link = F.col("url").cast("string")
    entries = listed.select(canonical(host_of(link), path_of(link)).alias("key")).filter("key <> 'http:///'").distinct()
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(entries.select(F.xxhash64("key").alias("h")), entries.count()))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def passed(hashes: pd.Series) -> pd.Series:
        n = hashes.map(len).to_numpy()
        hit = bloom.value.hits(np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes])) if n.sum() else np.zeros(0, dtype=bool)
        return pd.Series(np.split(hit, np.cumsum(n)[:-1]) if len(n) else [])

    open_ = base.filter("by_rule is null").withColumn("keys", keys_of(F.col("host"), F.col("path")))
    open_ = open_.withColumn("hit", passed(F.transform("keys", lambda k: F.xxhash64(k))))
    maybe = open_.select("url", F.explode(F.filter(F.arrays_zip("keys", "hit"), lambda x: x["hit"])).alias("k")).select("url", F.col("k.keys").alias("key")).distinct()
    confirmed = maybe.join(entries, "key", "left_semi").select(F.col("url").alias("bad_url")).distinct()
    return base.join(confirmed, (base.url == confirmed.bad_url) & base.by_rule.isNull(), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad_url").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, text, rhost, rpath) AS (VALUES {", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in RULES)}
), ruled AS (
  SELECT s.page_id, s.host, s.path,
         (SELECT arg_max(text, length(text)) FROM rules WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)) AS rule
  FROM split s
), listed(name) AS (VALUES {", ".join(f"('{n}.{z}')" for n in LISTED_NAMES for z in LISTED_ZONES)})
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IS NOT NULL THEN (SELECT verdict FROM rules WHERE text = r.rule)
            WHEN EXISTS (SELECT 1 FROM listed WHERE r.host = name OR ends_with(r.host, '.' || name)) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r
"""
