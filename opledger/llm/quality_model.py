"""Quality classifier: random-indexing vectors, pooled, and a two-layer network.

Every token is a word bucket and a shape (case, end punctuation, length, equal to
the token before).  Random indexing gives each of these units a sparse ternary
index vector; a unit's context vector is the sum of the index vectors around all
its occurrences in all documents, so it is a sum over the corpus that any number
of tasks can share.  A document is the weighted mean of its units' vectors, words
and shapes apart.  A two-layer numpy network on labelled rows makes a logit, and a
temperature fitted on rows it has not seen makes the logit a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm.common import bounded_batches, crc_bucket, long_id, map_batches, summed, texts

#: Units: word buckets, then shapes.  Vector length, and its non-zero places in an index vector.
WORD_UNITS, SHAPE_UNITS, DIM, NONZERO = 4096, 256, 32, 4
UNITS = WORD_UNITS + SHAPE_UNITS
#: Labelled rows, the first by a hash of their id, that the network is fitted on; every fifth sets the temperature.
FIT_ROWS = 12_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 60, 3e-3, 1e-4, 11
CACHE_WORDS, SLICES = 300_000, 64

SCHEMA = T.StructType([long_id(), T.StructField("held_out", T.BooleanType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

_ENDS = {b".": 1, b",": 1, b"!": 2, b"?": 2, b";": 1, b":": 1, b"|": 3, b"*": 4, b"#": 4, b"$": 4, b"%": 4, b"&": 4, b"<": 4, b">": 4}


def _unit(word: bytes) -> int:
    """Word bucket * 128 + shape of a token, without the place it stands in."""
    core = word.strip(b".,!?;:|*#$%&<>()[]\"'")
    bucket = zlib.crc32(core.lower()) % WORD_UNITS
    if not core:
        case = 0
    elif core.isdigit():
        case = 1
    elif core.isupper():
        case = 2 if len(core) > 1 else 3
    elif core.islower():
        case = 4
    elif core[:1].isupper() or core[:1] >= b"\x80":
        case = 5 if core[1:].islower() else 6
    else:
        case = 7
    end = 0 if word[-1:] == core[-1:] else _ENDS.get(word[-1:], 5)
    end = min(end, 3) if end < 4 else end - 1  # 0 none, 1 stop, 2 mark, 3 bar or symbol, 4 other
    size = 0 if len(core) < 4 else 1 if len(core) < 12 else 2
    return bucket * 128 + min(case * 15 + min(end, 4) * 3 + size, 127)


def index_vectors() -> np.ndarray:
    """Ternary index vectors of all units."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((UNITS, DIM), dtype=np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return out


class Units:
    """Unit numbers of texts, by a bounded cache of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Word buckets and shapes of the text's tokens, shapes counted from ``WORD_UNITS``."""
        words, known = text.encode("utf-8", "replace").split(), self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            known.update((w, _unit(w)) for w in new)
        both = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        bucket, shape = both >> 7, both & 127
        if len(words) > 1:
            shape[1:] += 128 * (both[1:] == both[:-1])
        return bucket, WORD_UNITS + shape


@dataclass
class QualityModel:
    vectors: np.ndarray
    weight: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    layers: tuple = ()
    temperature: float = 1.0
    prior: float = 0.0

    def pooled(self, bucket: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Weighted mean vector of the words and of the shapes, with the logarithm of their number."""
        out = np.zeros(2 * DIM + 1, dtype=np.float32)
        for k, units in enumerate((bucket, shape)):
            if len(units):
                n = np.bincount(units, minlength=UNITS)
                at = np.flatnonzero(n)
                out[k * DIM : (k + 1) * DIM] = ((n[at] * self.weight[at]) @ self.vectors[at]) / len(units)
        out[-1] = np.log1p(len(bucket)) / 5
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _index(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors and occurrences of all units over all documents."""
    per = UNITS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, index = Units(), index_vectors()
        place = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
        sign = np.take_along_axis(index, place, axis=1)
        total, seen = np.zeros(UNITS * DIM), np.zeros(UNITS)
        for batch in batches:
            got = [units(t) for t in texts(batch.column(0))]
            word, shape = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            doc = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
            seen += np.bincount(word, minlength=UNITS) + np.bincount(shape, minlength=UNITS)
            if len(word) < 2:
                continue
            same = doc[1:] == doc[:-1]
            for of, by in ((word[:-1], word[1:]), (word[1:], word[:-1]), (word, shape), (shape[:-1], shape[1:]), (shape[1:], shape[:-1])):
                of, by = (of[same], by[same]) if len(of) == len(same) else (of, by)
                for k in range(NONZERO):
                    total += np.bincount(of * DIM + place[by, k], weights=sign[by, k], minlength=UNITS * DIM)
        grid = np.concatenate([total.reshape(UNITS, DIM), seen[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([grid[k * per : (k + 1) * per].tobytes() for k in range(SLICES)], pa.binary())], ["slice", "vec"])

    parts = summed(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slice int, vec binary"), SLICES)
    grid = np.concatenate([np.frombuffer(p, dtype=np.float64) if p else np.zeros(per * (DIM + 1)) for p in parts]).reshape(UNITS, DIM + 1)
    return grid[:, :DIM], grid[:, DIM]


def _fit(model: QualityModel, x: np.ndarray, y: np.ndarray) -> None:
    """Train on four fifths of the rows, then set the temperature on the rest."""
    if len(y) < 10 or y.min() == y.max():
        model.prior = float(-2 + 4 * (y.mean() if len(y) else 0.5))
        return
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    tune, fit = order[::5], np.delete(order, np.s_[::5])
    model.mean, model.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    a = (x - model.mean) / model.scale
    p = [rng.normal(0, 1 / np.sqrt(a.shape[1]), (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), 64):
            rows = fit[at : at + 64]
            h = np.tanh(a[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = (e[:, None] * p[2]) * (1 - h * h)
            grads = [a[rows].T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model.layers = tuple(p)
    z = model.logits(x[tune])

    def loss(temperature: float) -> float:
        return float(np.mean(np.logaddexp(0, -np.where(y[tune] > 0, z, -z) / temperature)))

    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1) -> QualityModel:
    """Vectors from all documents; the network from labelled rows outside the held-out fold.

    Rows with a null label teach nothing.  With fewer than ten labelled rows, or
    one kind of label alone, every score is the same.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    context, seen = _index(docs)
    own = index_vectors()
    context = np.sign(context) * np.log1p(np.abs(context))
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
    share = seen / max(seen.sum(), 1)
    model = QualityModel((0.5 * context + own / np.sqrt(NONZERO)).astype(np.float32), np.where(np.arange(UNITS) < WORD_UNITS, 1e-3 / (1e-3 + share), 1.0).astype(np.float32))
    shared = spark.sparkContext.broadcast(model)
    told = labels.filter("quality is not null").filter(crc_bucket("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, m = Units(), shared.value
        for batch in batches:
            x = [m.pooled(*units(t)).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["doc_id", "x", "quality"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality")
    got = rows.mapInArrow(pool, "doc_id long, x binary, quality int").toPandas().sort_values(["doc_id", "x"])
    x = np.array([np.frombuffer(b, dtype=np.float32) for b in got["x"]], dtype=np.float64).reshape(-1, 2 * DIM + 1)
    _fit(model, x, (got["quality"] > 0).to_numpy(dtype=float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document with its probability of label 1.

    Null and empty texts are scored as a document without units.  Repeated rows
    are scored each for itself; a null ``doc_id`` stays null and counts as the
    empty text for the fold; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, held_out=held_out))

    def start():
        units, model = Units(), shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = model.scores(np.array([model.pooled(*units(t)) for t in texts(batch.column(1))], dtype=np.float64))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=SCHEMA.names)

        return step

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket("doc_id", folds) == held_out).alias("held_out"))
    return map_batches(wanted, SCHEMA, start)
