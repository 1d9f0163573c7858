"""Semantic cache: text normalisation, n-gram vectors, cosine and edit distance, lookups.

Prompts are matched exactly by the digest of their normal form first; only what
misses is compared with vectors, and the one nearest entry is confirmed by a
bounded edit distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.functions.hashing import fnv64_halves
from opledger.operators.asof import asof_join
from opledger.shipping import ship

DIM, THRESHOLD, EDITS, CAPACITY = 512, 0.92, 3, 10_000
#: Vectors of one block of the top-1 search, and query vectors that are broadcast at most.
BLOCK, BROADCAST_VECTORS = 2048, 200_000


def normalise(text: Column) -> Column:
    """White space runs to one space, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, "[\\p{Z}\\s\\x85]+", " ")))


def exact_key(text: Column) -> Column:
    return F.sha2(normalise(text).cast("binary"), 256)


def gateway_key(tenant: Column, max_tokens: Column, prompt: Column) -> Column:
    """Cache key of a request; the normal form of the parts in one text is hashed."""
    return exact_key(F.concat(F.lit("tenant:"), F.sha2(tenant.cast("binary"), 256), F.lit("\n"), max_tokens.cast("string"), F.lit("\n"), prompt))


def features(text: Column) -> Column:
    """Character 2- and 3-grams (``c:``) and words without punctuation around (``w:``) of the normal form."""
    norm = normalise(text)

    def grams(n: int) -> Column:
        return F.when(F.length(norm) >= n, F.transform(F.sequence(F.lit(1), F.length(norm) - (n - 1)), lambda i: F.concat(F.lit("c:"), F.substring(norm, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.transform(F.split(norm, " "), lambda w: F.regexp_replace(w, "^\\p{P}+|\\p{P}+$", "")), lambda w: w != "")
    return F.concat(grams(2), grams(3), F.transform(words, lambda w: F.concat(F.lit("w:"), w)))


def embed_sparse(texts: DataFrame, id_col: str, text_col: str, *, dim: int = DIM) -> DataFrame:
    """``(id, bucket, weight)``: signed feature counts by hash bucket, to unit length.

    The features of a text are hashed once each; ``dim`` must divide 2^32.
    """
    if (1 << 32) % dim:
        raise ValueError("dim must divide 2^32")
    grams = texts.select(id_col, F.explode(features(F.col(text_col))).alias("feature")).groupBy(id_col, "feature").agg(F.count("*").alias("n"))
    h = fnv64_halves(F.col("feature"))
    signed = grams.select(id_col, "n", h.alias("h")).select(id_col, (F.col("h.lo") % dim).alias("bucket"), F.when(F.col("h.hi") >= 1 << 31, -F.col("n")).otherwise(F.col("n")).alias("n"))
    sums = signed.groupBy(id_col, "bucket").agg(F.sum("n").alias("n")).filter("n <> 0")
    norm = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return sums.join(norm, id_col).select(id_col, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def unit(vector: Column) -> Column:
    """Vector of length 1 in doubles; a zero vector stays."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for different lengths or a zero vector."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) != F.size(y)) | (size == 0), 0.0).otherwise(dot(x, y) / size)


def nearest(queries: DataFrame, index: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """Each query's most similar entry, ``(query_id, neighbour_id, similarity)``; the least id wins ties.

    The index passes as blocks against the broadcast query set, and a task keeps
    one candidate a query, so no pair leaves it.  More than ``BROADCAST_VECTORS``
    queries are refused: pass them in parts.
    """
    ship(queries.sparkSession)
    n = queries.count()
    if n > BROADCAST_VECTORS:
        raise ValueError(f"more than {BROADCAST_VECTORS} queries at once")
    rows = queries.select(id_col, vec_col).toPandas().sort_values(id_col)
    width = len(rows[vec_col].iloc[0]) if n else 0
    matrix = np.array(rows[vec_col].tolist(), dtype=np.float64).reshape(n, width)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = queries.sparkSession.sparkContext.broadcast((rows[id_col].to_numpy(), matrix))

    def best(batches):
        ids, q = shared.value
        top, who = np.full(len(ids), -np.inf), np.full(len(ids), -1, dtype=np.int64)
        for pdf in batches:
            pdf = pdf[pdf[vec_col].map(lambda v: v is not None and len(v) == q.shape[1])]
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK].sort_values(id_col)
                if not len(part) or not len(ids):
                    continue
                x = np.array(part[vec_col].tolist(), dtype=np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sim, own = q @ x.T, part[id_col].to_numpy()
                if skip_self:
                    sim[ids[:, None] == own[None, :]] = -np.inf
                k = sim.argmax(axis=1)
                s = sim[np.arange(len(ids)), k]
                better = (s > top) | ((s == top) & (own[k] < who))
                top[better], who[better] = s[better], own[k][better]
        found = who >= 0
        yield pd.DataFrame({"query_id": ids[found], "neighbour_id": who[found], "similarity": top[found]})

    parts = index.select(id_col, vec_col).mapInPandas(best, "query_id long, neighbour_id long, similarity double")
    pick = F.max_by(F.struct("neighbour_id", "similarity"), F.struct("similarity", -F.col("neighbour_id"))).alias("best")
    return parts.groupBy("query_id").agg(pick).select("query_id", "best.neighbour_id", "best.similarity")


def fifo_index(adds: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Keys of a bounded first-in-first-out index: the ``capacity`` last by first insertion.

    For histories in which no key comes back after it was pushed out.
    """
    first = adds.groupBy("key").agg(F.min("idx").alias("first"))
    return first.orderBy(F.desc("first")).limit(capacity)


def _levenshtein(a: bytes, b: bytes, most: int | None = None) -> int:
    """Edit distance; beyond ``most`` any larger number.

    Only places within ``most`` of the diagonal can lie on a path that short.
    """
    k = len(a) + len(b) if most is None else most
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = len(a) + len(b) + 1
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i, x in enumerate(a, 1):
        low, high, next_ = max(0, i - k), min(len(b), i + k), {}
        for j in range(low, high + 1):
            if j == 0:
                next_[0] = i
                continue
            next_[j] = min(row.get(j, far) + 1, next_.get(j - 1, far) + 1, row[j - 1] + (x != b[j - 1]))
        row = next_
    return row[len(b)]


def within_edits(a: Column, b: Column, k: int = EDITS) -> Column:
    """Edit distance in bytes of at most ``k``; ASCII pairs stay in the JVM."""

    @F.pandas_udf(T.BooleanType())
    def bytes_within(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p == q or _levenshtein(p.encode(), q.encode(), k) <= k for p, q in zip(x, y, strict=True)], dtype=bool)

    ascii_pair = (F.octet_length(a) == F.length(a)) & (F.octet_length(b) == F.length(b))
    near = F.abs(F.octet_length(a) - F.octet_length(b)) <= k
    return F.when(ascii_pair, F.levenshtein(a, b, k) >= 0).otherwise(near & bytes_within(F.when(near & ~ascii_pair, a).otherwise(""), F.when(near & ~ascii_pair, b).otherwise("")))


def near_pairs(texts: DataFrame, id_col: str, text_col: str, k: int = EDITS) -> DataFrame:
    """Pairs of distinct normal forms within ``k`` edits, ``a`` before ``b``.

    The shorter of two texts is cut into ``k + 1`` pieces; the longer, ``d`` characters
    more, must hold piece ``i`` whole, shifted by ``i`` at most and by ``k - i`` from
    ``d``: edits before the piece shift it, those behind it make up the rest.  Ids join
    on hashes of those pieces, each pair once, and only pairs that met fetch their
    texts, whose edit distance decides.  Equal forms are one node, so copies never pair
    up.  Texts of up to ``k`` characters have an empty piece and meet by length.
    """
    norm = texts.select(id_col, normalise(F.col(text_col)).alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.min(id_col).alias("id"))
    size = F.length("norm")
    begin = lambda i, n: F.floor(i * n / (k + 1)).cast("int")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), F.xxhash64(F.substring("norm", begin(i, size) + 1, begin(i + 1, size) - begin(i, size))).alias("h"))))
    short = norm.select(F.col("id").alias("a"), size.alias("size"), cut.alias("p")).select("a", "size", "p.i", "p.h")
    probes = [(d, i, s) for d in range(k + 1) for i in range(k + 1) for s in range(max(-i, d - (k - i)), min(i, d + k - i) + 1)]

    def probe(d: int, i: int, s: int) -> Column:
        of, i_ = size - d, F.lit(i)
        at = begin(i_, of) + s
        n = begin(i_ + 1, of) - begin(i_, of)
        return F.when((of > 0) & (at >= 0) & (at + n <= size), F.struct(of.alias("size"), i_.alias("i"), F.xxhash64(F.substring("norm", at + 1, n)).alias("h")))

    held = F.explode(F.array_distinct(F.array_compact(F.array(*(probe(*p) for p in probes)))))
    long_ = norm.select(F.col("id").alias("b"), size.alias("b_size"), held.alias("p")).select("b", "b_size", "p.size", "p.i", "p.h")
    met = short.join(long_, ["size", "i", "h"]).filter((F.col("b_size") > F.col("size")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    text = lambda name: norm.select(F.col("id").alias(name), F.col("norm").alias(f"{name}_norm"))
    pairs = met.join(text("a"), "a").join(text("b"), "b").filter(within_edits(F.col("a_norm"), F.col("b_norm"), k))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def embedded(texts: DataFrame, id_col: str, text_col: str, *, dim: int = DIM) -> DataFrame:
    """``(id, vector)``: the n-gram vector of each text as an array of ``dim`` doubles; texts without features have none."""
    sparse = embed_sparse(texts, id_col, text_col, dim=dim).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return sparse.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("vector"))


def near_lookups(queries: DataFrame, entries: DataFrame, *, threshold: float = THRESHOLD, edits: int = EDITS) -> DataFrame:
    """Lookups of ``queries (id, text)`` in a full cache of ``entries (id, text)``: ``(id, entry_id, outcome)``.

    ``exact`` if an entry has the same normal form, the least id of several.  Else the
    one entry nearest by n-gram vector is asked: below ``threshold`` it is a ``miss``;
    within ``edits`` it is ``near``, otherwise ``near_rejected``, which gives no entry
    and is not tried again with the next nearest.
    """
    forms = entries.groupBy(normalise(F.col("text")).alias("norm")).agg(F.min("id").alias("entry_id"))
    asked = queries.select("id", normalise(F.col("text")).alias("norm")).join(forms, "norm", "left")
    open_ = asked.filter("entry_id is null").select("id", "norm")
    best = nearest(embedded(open_, "id", "norm"), embedded(forms.select(F.col("entry_id").alias("id"), "norm"), "id", "norm"), id_col="id", vec_col="vector", skip_self=False)
    found = best.filter(F.col("similarity") >= threshold).select(F.col("query_id").alias("id"), F.col("neighbour_id").alias("entry_id"))
    told = found.join(open_, "id").join(forms.select("entry_id", F.col("norm").alias("theirs")), "entry_id").select("id", "entry_id", within_edits(F.col("norm"), F.col("theirs"), edits).alias("same"))
    near = open_.select("id").join(told, "id", "left").select("id", F.when(F.col("same"), F.col("entry_id")).alias("entry_id"), F.when(F.col("same"), "near").when(F.col("entry_id").isNotNull(), "near_rejected").otherwise("miss").alias("outcome"))
    return asked.filter("entry_id is not null").select("id", "entry_id", F.lit("exact").alias("outcome")).unionByName(near)


def lookups(requests: DataFrame, stores: DataFrame, *, ttl_ms: int = 0) -> DataFrame:
    """Exact lookups against the newest earlier store of their key: ``outcome`` hit, expired or miss.

    Both sides have ``key, ts_ms``; an entry is expired once its age exceeds the
    time to live, and one of exactly that age is live.
    """
    seen = asof_join(requests, stores.select("key", "ts_ms", F.col("ts_ms").alias("stored_ms"), "text"), by=["key"], at="ts_ms", values=["stored_ms", "text"])
    expired = (F.lit(ttl_ms) > 0) & (F.col("stored_ms") + ttl_ms < F.col("ts_ms"))
    return seen.withColumn("outcome", F.when(F.col("stored_ms").isNull(), "miss").when(expired, "expired").otherwise("hit"))


def replay(requests: DataFrame, *, ttl_ms: int) -> DataFrame:
    """A cache that stores on each miss: which requests ``hit``.

    A hit does not renew its entry, so a key's requests fall into runs that a miss
    begins; runs depend on their own outcomes and are folded by key.
    """
    from opledger.operators.folds import fold

    def step(cell: list, row: dict) -> list[tuple]:
        hit = bool(cell) and not (ttl_ms > 0 and cell[0] + ttl_ms < row["ts_ms"])
        if not hit:
            cell[:] = [row["ts_ms"]]
        return [(row["request_id"], row["key"], hit)]

    return fold(requests.select("request_id", "key", "ts_ms"), ["key"], ["ts_ms", "request_id"], list, step, "request_id long, key string, hit boolean")


def stats(outcomes: DataFrame) -> DataFrame:
    """Lookups by outcome; near rejections are among the misses."""
    o = F.col("outcome")
    return outcomes.agg(F.count("*").alias("lookups"), F.count_if(o == "exact").alias("exact_hits"), F.count_if(o == "near").alias("near_hits"), F.count_if(o.isin("miss", "near_rejected")).alias("misses"), F.count_if(o == "near_rejected").alias("near_rejected"))


def unbounded_first(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows with whether an earlier row has the same ``by``."""
    return rows.withColumn("seen", F.row_number().over(Window.partitionBy(by).orderBy(order)) > 1)
