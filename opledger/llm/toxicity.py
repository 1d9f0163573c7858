"""Toxicity: words are read through a noisy channel, then the restored text is scored.

Features are the character n-grams of the restored words, hashed.  The labelled
training rows give each feature the documents of either label that hold it; a
feature whose excess of toxic documents is significant weighs its log odds.  A
document's distinct words are summed up, each by its own weights, and the sum over
the root of their number, the strongest word, the strongest three and eight make a
probability by a logistic curve fitted on labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm.channel import CLASSES, CharModel, reading, spaced_runs
from opledger.llm.common import bounded_batches, crc_bucket, long_id, map_batches, summed, texts

#: Hashed features; n-gram lengths (a word's edges count); words whose sums a worker holds.
BITS, NGRAMS, CACHE_WORDS = 17, (3, 4, 5, 6), 300_000
#: Standard deviations by which the toxic documents of a feature must exceed chance, and its least documents.
LEAST_Z, LEAST_DOCS = 4.0, 4
#: Labelled rows, the first by a hash of their id, on which weights and curve are fitted.
TRAIN_ROWS = 20_000
SLICES, INPUTS = 64, 6

SCHEMA = T.StructType([long_id(), T.StructField("held_out", T.BooleanType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])


def ngram_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, and the number of the word each is from."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64)
    edge = data == 32
    word = np.cumsum(edge) - 1
    out, own = [], []
    for n in NGRAMS:
        m = len(data) - n + 1
        if m < 1:
            continue
        h, inside = np.zeros(m, dtype=np.uint64), np.zeros(m, dtype=bool)
        for k in range(n):
            h = h * np.uint64(1099511628211) + data[k : k + m] + np.uint64(7)
            if 0 < k < n - 1:
                inside |= edge[k : k + m]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        keep = ~inside
        out.append((h[keep] >> np.uint64(64 - BITS)).astype(np.int64))
        own.append(np.minimum(word[:m][keep], len(words) - 1))
    return np.concatenate(out), np.concatenate(own)


#: Bytes that end a word when no character of it is disguised, as spaces; A-Z as a-z.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Reader:
    """Distinct words of a text and, by a cache, how each reads."""

    def __init__(self, model: CharModel):
        self.model = model
        self.read: dict[bytes, bytes] = {}

    def words(self, text: str) -> set[bytes]:
        return set(text.encode("utf-8", "replace").translate(_PLAIN).split())

    def readings(self, words) -> list[bytes]:
        return [reading(w.decode("utf-8", "replace"), self.model).encode("utf-8", "replace") for w in words]

    def runs(self, text: str) -> list[bytes]:
        return [reading(r, self.model).encode("utf-8", "replace") for r in spaced_runs(text)]


@dataclass
class ToxicModel:
    """Everything scoring needs; sizes are fixed by the parameters above."""

    chars: CharModel
    weights: np.ndarray
    curve: tuple = (0.0,) * (1 + INPUTS)


class Scorer:
    """Pooled evidence of texts; sums of words already met are held in a bounded cache."""

    def __init__(self, model: ToxicModel):
        self.model, self.reader = model, Reader(model.chars)
        self.known: dict[bytes, float] = {}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        self.known.update(zip(words, self._sums(self.reader.readings(words)).tolist(), strict=True))

    def _sums(self, readings: list[bytes]) -> np.ndarray:
        parts, owner = [], []
        for k, r in enumerate(readings):
            for p in r.split():
                parts.append(p)
                owner.append(k)
        if not parts:
            return np.zeros(len(readings))
        feature, word = ngram_features(parts)
        return np.bincount(np.array(owner)[word], weights=self.model.weights[feature], minlength=len(readings))

    def pooled(self, text: str) -> list[float]:
        """The curve's inputs: what the words' sums come to, and how strong the strongest are."""
        words = self.reader.words(text)
        known = self.known
        if new := [w for w in words if w not in known]:
            before = len(known)
            self._learn(new)
            if len(known) < before + len(new):
                self._learn([w for w in words if w not in known])
        sums = [x for x in map(known.__getitem__, words) if x > 0]
        if runs := self.reader.runs(text):
            sums += self._sums(runs).tolist()
        sums.sort(reverse=True)
        total = sum(sums)
        return [total / (len(words) + 4) ** 0.5, math.log1p(total), sums[0] if sums else 0.0, sum(sums[:3]) / 3, sum(sums[:8]) / 8, math.log1p(len(words))]

    def score(self, text: str) -> float:
        z = self.model.curve[0] + sum(w * x for w, x in zip(self.model.curve[1:], self.pooled(text), strict=True))
        return 1 / (1 + math.exp(-min(max(z, -50.0), 50.0)))


def _char_counts(docs: DataFrame) -> np.ndarray:
    per = CLASSES**3 // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3)
        for batch in batches:
            total += CharModel.counts("\n".join(texts(batch.column(0))).encode("utf-8", "replace"))
        yield _sliced(total, per)

    return _whole(summed(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slice int, vec binary"), SLICES), per)


def _sliced(total: np.ndarray, per: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([total[k * per : (k + 1) * per].tobytes() for k in range(SLICES)], pa.binary())], ["slice", "vec"])


def _whole(parts: list[bytes], per: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=np.float64) if x else np.zeros(per) for x in parts])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple:
    """Logistic regression by Newton steps, with a slight pull to 0."""
    if len(y) == 0 or y.min() == y.max():
        return (float(-4 + 8 * (y.mean() if len(y) else 0)), *[0.0] * INPUTS)
    a = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(1 + INPUTS), np.diag([1e-3] + [3e-2] * INPUTS)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + pull
        w = w - np.linalg.solve(h, g)
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, *, held_out_of: int = 5) -> ToxicModel:
    """Model from all documents' characters and the labelled rows that are not held out.

    Rows without a label, or labelled with null, teach nothing.  Without labelled
    rows of both kinds every score is the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chars = CharModel(_char_counts(docs))
    told = labels.filter("toxic is not null").filter(crc_bucket("doc_id", held_out_of) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = F.broadcast(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))  # a fixed number of rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id").select("doc_id", "text", "toxic")
    shared, per = spark.sparkContext.broadcast(chars), (2 << BITS) // (SLICES - 1) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(shared.value), np.zeros(per * SLICES)
        held: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for text, toxic in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = reader.words(text)
                if new := [w for w in words if w not in held]:
                    if len(held) + len(new) > CACHE_WORDS // 3:
                        held.clear()
                        new = list(words)
                    parts, owner = [], []
                    for w, r in zip(new, reader.readings(new), strict=True):
                        for p in r.split():
                            parts.append(p)
                            owner.append(w)
                    held.update(dict.fromkeys(new, _NONE))
                    if parts:
                        feature, word = ngram_features(parts)
                        order = np.argsort(word, kind="stable")
                        cut = np.searchsorted(word[order], np.arange(1, len(parts)))
                        for w, f in zip(owner, np.split(feature[order].astype(np.int32), cut), strict=True):
                            held[w] = np.concatenate([held[w], f]) if len(held[w]) else f
                found = [held[w] for w in words]
                if runs := [p for r in reader.runs(text) for p in r.split()]:
                    found.append(ngram_features(runs)[0].astype(np.int32))
                if found:
                    hit = np.zeros(1 << BITS, dtype=bool)
                    hit[np.concatenate(found)] = True
                    at = np.flatnonzero(hit)
                    seen[at + ((1 << BITS) if toxic else 0)] += 1
                seen[-1 if toxic else -2] += 1
        yield _sliced(seen, per)

    seen = _whole(summed(rows.mapInArrow(count, "slice int, vec binary"), SLICES), per)
    model = ToxicModel(chars, _weights(seen[: 1 << BITS], seen[1 << BITS : 2 << BITS], seen[-2], seen[-1]))
    model_shared = spark.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model_shared.value)
        for batch in batches:
            got = np.array([scorer.pooled(t) for t in texts(batch.column(1))])
            yield pa.RecordBatch.from_arrays([*(pa.array(got[:, k]) for k in range(INPUTS)), batch.column(2)], names=[*(f"x{k}" for k in range(INPUTS)), "toxic"])

    names = [f"x{k}" for k in range(INPUTS)]
    got = rows.mapInArrow(pool, ", ".join(f"{n} double" for n in names) + ", toxic int").toPandas()
    model.curve = _logistic(got[names].to_numpy(dtype=float), (got["toxic"] > 0).to_numpy(dtype=float))
    return model


_NONE = np.zeros(0, dtype=np.int32)


def _weights(clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float) -> np.ndarray:
    n = max(n_clean + n_toxic, 1.0)
    share, docs = n_toxic / n, clean + toxic
    z = (toxic - docs * share) / np.sqrt(docs * share * (1 - share) + 1e-9)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((z >= LEAST_Z) & (docs >= LEAST_DOCS), odds, 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, held_out_of: int = 5) -> DataFrame:
    """One row per document with its probability of being toxic.

    Null and empty texts have no words and get the score of no evidence.  Repeated
    rows are scored each for itself; a null ``doc_id`` stays null and counts as the
    empty text for the fold; other columns are not read.  An empty table gives no
    rows; a text of any length is read whole; a score of exactly 0.5 is predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out_of=held_out_of))

    def start():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = np.array([scorer.score(t) for t in texts(batch.column(1))])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=SCHEMA.names)

        return step

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket("doc_id", held_out_of) == 0).alias("held_out"))
    return map_batches(wanted, SCHEMA, start)


def keep_civil(docs: DataFrame, labels: DataFrame, *, held_out_of: int = 5) -> DataFrame:
    """``docs`` without the documents scored 0.5 or more; all columns stay.

    Null and empty texts have the score of no evidence.  Repeated rows and rows without
    an id are scored each for itself; an empty table stays empty, and without labels
    nothing is known to be toxic; a text of any length is read whole.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out_of=held_out_of)), docs.columns.index("text")

    def start():
        scorer = Scorer(shared.value)
        return lambda batch: batch.filter(pa.array([scorer.score(t) < 0.5 for t in texts(batch.column(at))], pa.bool_()))

    return map_batches(docs, docs.schema, start)
