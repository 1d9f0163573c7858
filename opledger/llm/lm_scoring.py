"""Language-model scoring: word unigrams as the base, causal self-attention over subword ids.

What the model gathers follows the corpus.  Counts of all training words give the
counts of all subwords and of subword pairs within words; from those come the
subwords' features, the words' groups and a chain that spells any word.  Attention
over a token's past gives the probabilities of the next token's class: a frequent
word by itself, or a group.  A word's probability is its class's times its
discounted share of the class, plus what the discount leaves times the chain's
spelling, so all words together have probability one.

Training documents are dealt into shares by their ids.  Every share trains once, in
one of a few rounds that grow fourfold; a round's shares start from the same weights
and are averaged exactly, so the result depends on the documents alone and not on
how they lie in partitions.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opledger.llm import attention as net
from opledger.llm.common import bounded_batches, crc_bucket, materialised, summed, task_index

#: Most frequent words whose counts go to every task; the others' counts are joined.
HEAD_WORDS = 250_000
#: Words of a share of the training documents, about; learning rate, its factor from round to round, and windows of a step.
SHARE_WORDS, RATE, SLOWER, STEP_WINDOWS = 2_000_000, 1e-2, 0.5, 64
#: Steps of a share at least: one with fewer words trains on all of them several times.
LEAST_STEPS = 500
#: Units of the spelling chain: frequent subwords alone, the others in groups.
UNITS_ALONE, UNIT_GROUPS = 1024, 64
UNITS = UNITS_ALONE + UNIT_GROUPS
#: Words held by a task; words counted before they leave it, and bytes of counts held; slices of a sum.
CACHE_WORDS, COUNT_WORDS, COUNT_BYTES, SLICES = 300_000, 400_000, 1 << 26, 64
END = 50_256
#: Rows behind those of the known words, for nothing and for the start mark.
SPARE_ROWS = 2

SCHEMA = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<word: binary, share: double, rest: double>>"


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: ASCII alone


def flat_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has; null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    there = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end of a text makes an empty one
    if not pc.all(there, min_count=0).as_py():
        owner = np.repeat(np.arange(len(column)), n)[there.to_numpy(zero_copy_only=False)]
        flat, n = flat.filter(there), np.bincount(owner, minlength=len(column))
    return flat.cast(pa.binary()), n.astype(np.int64)


def values(column: pa.Array) -> list:
    """The values of a column without nulls; ``to_pylist`` makes a scalar of each first."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Subwords:
    """Lossless byte-level ids of lower-case words, each with the space before it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy  # with no special tokens
        self.names = sorted(ranks, key=ranks.get)
        self.first = np.array([n.startswith(b" ") for n in self.names])

    def __call__(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has; the empty word is ``END``."""
        if b"" in ws:
            at = ws.index(b"")
            ids, count = self(ws[:at] + ws[at + 1 :])
            return np.insert(ids, int(count[:at].sum()), END), np.insert(count, at, 1)
        ids = self.encode((b" " + b" ".join(ws)).decode("utf-8", "replace")).astype(np.int64) if ws else np.zeros(0, dtype=np.int64)
        begin = np.flatnonzero(self.first[ids]) if len(ids) else ids
        if len(begin) != len(ws):
            each = [self.encode(" " + w.decode("utf-8", "replace")) for w in ws]
            return np.concatenate(each).astype(np.int64), np.array([len(x) for x in each], dtype=np.int64)
        return ids, np.diff(begin, append=len(ids))


@lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    """One tokenizer for all tasks of a worker process."""
    return Subwords(path)


def parts(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in runs of about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    at = 0
    while at < len(column):
        end = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most)), at + 1)
        yield column.slice(at, end - at)
        at = end


@dataclass
class Units:
    """Unit of every subword, and its log share in its unit."""

    of: np.ndarray
    log_share: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, order: np.ndarray) -> Units:
        """Frequent subwords alone, by rank; the others, in ``order``, in groups of about equal mass."""
        rank = np.argsort(-counts, kind="stable")
        of = np.zeros(len(counts), dtype=np.int64)
        rest = order[~np.isin(order, rank[:UNITS_ALONE])]
        mass = np.cumsum(counts[rest] + 0.1)
        of[rest] = UNITS_ALONE + np.minimum((mass / mass[-1] * UNIT_GROUPS).astype(np.int64), UNIT_GROUPS - 1)
        of[rank[:UNITS_ALONE]] = np.arange(UNITS_ALONE)
        mine = counts + 0.1
        return cls(of, np.log(mine / np.bincount(of, weights=mine, minlength=UNITS)[of]))


def spelled(encode: Subwords, ws: list[bytes], units: Units):
    """Subword ids of words that are not empty, their units, how many each word has, and each word's first and last place."""
    ids, count = encode(ws)
    last = np.cumsum(count) - 1
    return ids, units.of[ids], count, last - count + 1, last


class Lexicon:
    """What is known of any word from its subwords: features, class, and the chain's probability."""

    def __init__(self, units: Units, pairs: np.ndarray, first: np.ndarray, last: np.ndarray, alone: list[bytes]):
        self.units = units
        all_ = pairs.sum(0) + first + 0.1
        after = pairs.sum(1) + last
        self.log_first = np.log((first + 0.1) / (first + 0.1).sum()).astype(np.float32)
        self.log_next = np.log((pairs + 30 * (all_ / all_.sum())[None, :]) / (after + 31)[:, None]).astype(np.float32)
        self.log_end = np.log((last + 1) / (after + 31)).astype(np.float32)
        self.vector = _spectral(pairs)
        self.centre = _centres(self.vector, pairs)
        self.alone = {w: k for k, w in enumerate(alone)}

    def described(self, encode: Subwords, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, class and natural log chain probability of words; the empty word is the end of a text."""
        features, classes = np.zeros((len(ws), net.FEATURES), dtype=np.float32), np.zeros(len(ws), dtype=np.int32)
        log_chain = np.full(len(ws), -np.inf)
        some = [k for k, w in enumerate(ws) if w]
        if some:
            ids, unit, count, begin, last = spelled(encode, [ws[k] for k in some], self.units)
            owner = np.repeat(np.arange(len(some)), count)
            inner = np.ones(len(ids), dtype=bool)
            inner[last] = False
            at = np.flatnonzero(inner)
            step = self.units.log_share[ids]
            step[at] += self.log_next[unit[at], unit[at + 1]]
            log_chain[some] = np.add.reduceat(step, begin) + self.log_first[unit[begin]] + self.log_end[unit[last]]
            total = np.add.reduceat(self.vector.take(unit, axis=0), begin, axis=0)
            mine = np.zeros((len(some), net.FEATURES), dtype=np.float32)
            mine[:, net.KNOWN : net.KNOWN + net.SPECTRAL] = total
            known = np.flatnonzero(unit < net.KNOWN)
            mine[:, : net.KNOWN] = np.bincount(owner[known] * net.KNOWN + unit[known], minlength=len(some) * net.KNOWN).reshape(-1, net.KNOWN)
            features[some] = mine / np.sqrt(count, dtype=np.float32)[:, None]
            direction = total / (np.sqrt((total * total).sum(1, keepdims=True)) + 1e-6)
            classes[some] = net.ALONE + (direction @ self.centre.T - 0.5 * (self.centre**2).sum(1)).argmax(1)
        for k in [k for k, w in enumerate(ws) if w in self.alone]:
            classes[k] = self.alone[ws[k]]
        return features, classes, log_chain


def _spectral(pairs: np.ndarray) -> np.ndarray:
    """Unit-length directions of the units in the leading eigenvectors of their positive pointwise information."""
    both = pairs + pairs.T
    of = both.sum(1) + 1
    value, vector = np.linalg.eigh(np.log(np.maximum(both * (of.sum() / np.outer(of, of)), 1)))
    most = np.argsort(-np.abs(value), kind="stable")[: net.SPECTRAL]
    e = vector[:, most] * np.sqrt(np.abs(value[most]))
    return (e / (np.sqrt((e * e).sum(1, keepdims=True)) + 1e-6)).astype(np.float32)


def _centres(vector: np.ndarray, pairs: np.ndarray, rounds: int = 15) -> np.ndarray:
    """k-means of the directions of all unit pairs within words, by their counts."""
    one, two = np.nonzero(pairs)
    rng = np.random.default_rng(3)
    if len(one) < net.GROUPS:
        return vector[rng.permutation(len(vector))[: net.GROUPS]]
    weight = pairs[one, two]
    x = vector[one] + vector[two]
    x /= np.sqrt((x * x).sum(1, keepdims=True)) + 1e-6
    c = x[rng.choice(len(x), net.GROUPS, p=weight / weight.sum())]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        mass = np.bincount(near, weights=weight, minlength=net.GROUPS)
        mean = np.stack([np.bincount(near, weights=weight * x[:, d], minlength=net.GROUPS) for d in range(x.shape[1])], axis=1)
        c = np.where(mass[:, None] > 0, mean / np.maximum(mass, 1e-9)[:, None], c).astype(np.float32)
    return c


@dataclass
class LanguageModel:
    lexicon: Lexicon
    flat: np.ndarray
    head: dict[bytes, int]
    tokens: int
    distinct: int
    discount: float
    class_tokens: np.ndarray
    class_words: np.ndarray

    def log10_unigram(self, count):
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    @property
    def taken(self) -> np.ndarray:
        """What each class discounts from a word's count: nothing where the word is alone."""
        return np.where(np.arange(net.CLASSES) < net.ALONE, 0.0, self.discount)

    @property
    def left(self) -> np.ndarray:
        """Share of each class that the discount leaves to the chain; all of a group without words."""
        left = self.taken * self.class_words / np.maximum(self.class_tokens, 1)
        return np.where((self.class_tokens == 0) & (self.taken > 0), 1.0, left)


class Known:
    """Numbers of the words met, with rows of arrays that ``describe`` makes for new ones; full, it keeps those asked for most.

    Behind the words' rows are ``SPARE_ROWS`` that a caller may fill until the next call.
    """

    def __init__(self, describe: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = CACHE_WORDS):
        self.describe, self.limit = describe, limit
        self.number: dict[bytes, int] = {}
        self.named: list[bytes] = []
        self.rows: list[np.ndarray] = []
        self.uses = np.zeros(0, dtype=np.int32)

    def _forget(self, new: int) -> None:
        """Keep the words that several calls asked for, half the limit and room for new ones at most; what was long ago counts less each time."""
        most = max(min(self.limit // 2, self.limit - new), 0)
        uses = self.uses[: len(self.named)]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[:most]])
        self.named = [self.named[k] for k in keep.tolist()]
        self.number = dict(zip(self.named, range(len(keep)), strict=True))
        for r in (*self.rows, self.uses):
            for at in range(0, len(keep), 1 << 12):  # no row moves up, so in parts none is lost
                some = keep[at : at + (1 << 12)]
                r[at : at + len(some)] = r.take(some, axis=0)
        self.uses[: len(keep)] >>= 1

    def _learn(self, ws: list[bytes]) -> None:
        made, at = self.describe(ws), len(self.named)
        if not self.rows:
            self.rows = [np.empty((1 << 12, *m.shape[1:]), dtype=m.dtype) for m in made]
        need, room = at + len(ws) + SPARE_ROWS, len(self.rows[0])
        if need > room:  # the rows made new stay untouched, and so without memory, until they are used
            while need > room:
                room *= 2
            held, self.rows = self.rows, []
            for k, r in enumerate(held):
                self.rows.append(np.empty((room, *r.shape[1:]), dtype=r.dtype))
                self.rows[k][:at] = r[:at]
        if len(self.uses) < room:
            self.uses = np.pad(self.uses, (0, room - len(self.uses)))
        for r, m in zip(self.rows, made, strict=True):
            r[at : at + len(ws)] = m
        self.uses[at : at + len(ws)] = 1
        self.number.update(zip(ws, range(at, at + len(ws)), strict=True))
        self.named += ws

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        """Number of each of some different words; all are valid until the next call."""
        out, missed = self._found(ws)
        self.uses[out[out >= 0]] += 1
        if missed and self.named and len(self.named) + len(missed) > self.limit:
            self._forget(len(missed))
            out, missed = self._found(ws)  # some of the words may have gone
        if missed:
            before = len(self.named)
            self._learn([ws[k] for k in missed])
            out[missed] = np.arange(before, before + len(missed))
        return out

    def _found(self, ws: list[bytes]) -> tuple[np.ndarray, list[int]]:
        out = np.fromiter(map(self.number.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        return out, np.flatnonzero(out < 0).tolist()


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """What ``make`` made for the key in this worker process, so that its tasks share the words they meet; one key at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def numbered(known: Known, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of several texts, the empty word as each one's end, and how many each has."""
    flat, n = flat_words(some)
    coded = flat.dictionary_encode()
    number = known.numbers([*values(coded.dictionary), b""])
    ends = np.cumsum(n + 1) - 1
    out = np.empty(len(flat) + len(n), dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside], out[ends] = number.take(coded.indices.to_numpy()), number[-1]
    return out, n + 1


def laid_out(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts with ``n`` tokens each in windows, a text's in order: what each reads and what it scores.

    A place reads the token at its value, or the start mark (-1) or nothing (-2);
    it scores the token at its value, or none (-1).  A text's ``k``-th place reads
    the token before the one it scores; the first reads the mark.
    """
    per = -(-n // net.SCORED)
    room = net.CONTEXT + per * net.SCORED
    begin, first, start = np.cumsum(room) - room, np.cumsum(per) - per, np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(start, n)
    read = np.full(int(room.sum()), -2, dtype=np.int64)
    read[np.repeat(begin + net.CONTEXT, n) + inside] = np.where(inside == 0, -1, np.arange(len(inside)) - 1)
    score = np.full(int(per.sum()) * net.SCORED, -1, dtype=np.int64)
    score[np.repeat(first * net.SCORED, n) + inside] = np.arange(len(inside))
    starts = np.repeat(begin - first * net.SCORED, per) + np.arange(len(score) // net.SCORED) * net.SCORED
    return read[starts[:, None] + np.arange(net.LENGTH)], score.reshape(-1, net.SCORED)


def _counts(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, n], ["word", "n"])


def _added(counts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The counts with each word once."""
    coded = pa.concat_arrays([x.column(0) for x in counts]).dictionary_encode()
    total = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(total, coded.indices.to_numpy(), np.concatenate([x.column(1).to_numpy() for x in counts]))
    return _counts(coded.dictionary, pa.array(total))


def _word_counts(train: DataFrame) -> DataFrame:
    """``(word, n)`` over the training texts; the empty word is the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            met = pc.value_counts(flat_words(batch.column(0))[0])
            new = [_counts(met.field(0), met.field(1)), _counts(pa.array([b""], pa.binary()), pa.array([batch.num_rows], pa.int64()))]
            if held and sum(x.nbytes for x in [*held, *new]) > COUNT_BYTES:
                yield _added(held)
                held = []
            held += new
            if sum(x.num_rows for x in held) > 2 * COUNT_WORDS:
                held = [_added(held)]
                if held[0].num_rows > COUNT_WORDS:
                    yield held.pop()
        if held:
            yield _added(held)

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame) -> tuple[dict[bytes, int], int, int, int, int, int]:
    """The most frequent words, and the numbers of all tokens, of different ones, of text ends, and of words met once and twice.

    The words are those above a count that a histogram of counts gives, ``HEAD_WORDS``
    at most.  Counts are binned by sixteenths of powers of two, so the histogram is
    small; a bin that would not fit whole is left out.  The end is always among them.
    """
    level, end = F.floor(F.log2("n") * 16), F.octet_length("word") == 0
    bins = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum(F.when(end, F.col("n")).otherwise(0)).alias("ends")).collect(), reverse=True)
    least, room = None, HEAD_WORDS
    for b in bins:
        room -= b["words"]
        if room < 0:
            break
        least = b["level"]
    ends = sum(b["ends"] for b in bins)
    head = {bytes(r[0]): r[1] for r in counts.filter((level >= least) & ~end).collect()} if least is not None else {}
    if ends:
        head[b""] = ends
    met = {b["level"]: b["words"] for b in bins}  # the first bins hold one count each
    return head, sum(b["n"] for b in bins), sum(b["words"] for b in bins), ends, met.get(0, 0), met.get(16, 0)


def _dense(parts: DataFrame, size: int, slices: int = SLICES) -> np.ndarray:
    per = -(-size // slices)
    got = summed(parts, slices)
    return np.concatenate([np.frombuffer(x, dtype=np.float64) if x else np.zeros(per) for x in got])[:size]


def _slices(total: np.ndarray, slices: int = SLICES) -> pa.RecordBatch:
    per = -(-len(total) // slices)
    total = np.pad(total, (0, per * slices - len(total)))
    return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([total[k * per : (k + 1) * per].tobytes() for k in range(slices)], pa.binary())], ["slice", "vec"])


def _with_tokenizer(path: str, step):
    """Batch function over ``(word, n)`` that adds up ``step(encode, words, counts)``, without the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total, ws, counts = subwords(path), None, [], []
        for batch in chain(batches, [None]):
            if batch is not None:
                ws += values(batch.column(0))
                counts.append(batch.column(1).to_numpy().astype(np.float64))
            if ws and (batch is None or len(ws) > 50_000):  # a step makes arrays of the sum's size
                n = np.concatenate(counts)
                keep = [k for k, w in enumerate(ws) if w]
                if keep:
                    got = step(encode, [ws[k] for k in keep], n[keep])
                    total = got if total is None else total + got
                ws, counts = [], []
        if total is not None:
            yield _slices(total)

    return run


def _per_id(encode: Subwords, ws: list[bytes], n: np.ndarray) -> np.ndarray:
    ids, count = encode(ws)
    return np.bincount(ids, weights=np.repeat(n, count), minlength=END + 1).astype(np.float64)


def _per_unit(units: Units):
    """Counts of unit pairs within words, of words' first units and of their last ones, in one row."""

    def step(encode: Subwords, ws: list[bytes], n: np.ndarray) -> np.ndarray:
        _, unit, count, begin, last = spelled(encode, ws, units)
        inner = np.ones(len(unit), dtype=bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        pairs = np.bincount(unit[at] * UNITS + unit[at + 1], weights=np.repeat(n, count)[at], minlength=UNITS * UNITS)
        return np.concatenate([pairs, np.bincount(unit[begin], weights=n, minlength=UNITS), np.bincount(unit[last], weights=n, minlength=UNITS)])

    return step


def _per_class(lexicon):
    """Tokens and different words of each class, in one row."""

    def step(encode: Subwords, ws: list[bytes], n: np.ndarray) -> np.ndarray:
        _, c, _ = lexicon.value.described(encode, ws)
        return np.concatenate([np.bincount(c, weights=n, minlength=net.CLASSES), np.bincount(c, minlength=net.CLASSES)])

    return step


def train(docs: DataFrame, *, held_out_of: int = 10, tokenizer: str | None = None) -> tuple[LanguageModel, DataFrame]:
    """The model of the documents that are not held out, and the table of their word counts."""
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    seen = docs.filter(crc_bucket("doc_id", held_out_of) != 0).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = materialised(_word_counts(seen))
    head, tokens, distinct, ends, once, twice = _head(counts)

    def added(step, size: int) -> np.ndarray:
        return _dense(counts.mapInArrow(_with_tokenizer(path, step), "slice int, vec binary"), size)

    order = np.array(sorted(range(END), key=subwords(path).names.__getitem__) + [END])
    units = Units.of_counts(added(_per_id, END + 1), order)
    total = added(_per_unit(units), UNITS * UNITS + 2 * UNITS)
    alone = sorted((w for w in head if w), key=lambda w: (-head[w], w))[: net.ALONE - 1]
    alone += [b"\xff%d" % k for k in range(net.ALONE - 1 - len(alone))]  # no text has such bytes
    lexicon = Lexicon(units, total[: UNITS * UNITS].reshape(UNITS, UNITS), total[UNITS * UNITS : -UNITS], total[-UNITS:], [*alone, b""])
    shared = spark.sparkContext.broadcast(lexicon)
    per_class = added(_per_class(shared), 2 * net.CLASSES)
    class_tokens, class_words = per_class[: net.CLASSES], per_class[net.CLASSES :]
    class_tokens[net.ALONE - 1], class_words[net.ALONE - 1] = ends, min(ends, 1)
    discount = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
    flat = _trained(seen, tokens, path, shared, net.initial((class_tokens + 1) / (class_tokens + 1).sum()))
    return LanguageModel(lexicon, flat, head, int(tokens), int(distinct), discount, class_tokens, class_words), counts


def _trained(seen: DataFrame, tokens: int, path: str, lexicon, flat: np.ndarray) -> np.ndarray:
    """Weights after all rounds; those at the start if there is no document."""
    shares = max(round(tokens / SHARE_WORDS), 1)
    passes = max(-(-LEAST_STEPS * STEP_WINDOWS * net.SCORED // max(tokens // shares, 1)), 1)
    rows = seen.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int").alias("share"), F.xxhash64(F.lit("order"), "doc_id", "text").alias("place"))
    low, high, k, key = 0, 1, 0, uuid.uuid4().hex
    while tokens and low < shares:
        high = min(high, shares)
        mine = rows.filter((F.col("share") >= low) & (F.col("share") < high)).repartitionById(high - low, F.col("share") - low).sortWithinPartitions("share", "place")
        total = _dense(mine.mapInArrow(_learn(path, lexicon, key, flat, RATE * SLOWER**k, passes, tokens // shares), "slice int, vec binary"), net.SIZE + 1, 4)
        if total[-1]:
            flat = (total[:-1] / (total[-1] * POINT)).astype(np.float32)
        low, high, k = high, 4 * high, k + 1
    return flat


#: Weights are added up as whole multiples of this one's inverse, so their sum has no order.
POINT = 1 << 24


def _learn(path: str, lexicon, key: str, flat: np.ndarray, rate: float, passes: int, expected: int):
    """Batch function over ``(text, share)`` sorted by share: trains each share from ``flat``, and adds up the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.keep_memory()
        encode, total = subwords(path), np.zeros(net.SIZE + 1)
        known = kept(key, lambda: Known(lambda ws: lexicon.value.described(encode, ws)[:2]))

        def finish(trainer: net.Trainer | None, held: list[pa.Array], rng) -> None:
            if trainer is None:
                return
            for _ in range(passes - 1):
                for some in held:
                    _steps(trainer, known, some, rate, rng, passes * expected)
            total[:-1] += np.rint(trainer.flat.astype(np.float64) * POINT)
            total[-1] += 1

        share, trainer, held, rng = None, None, [], None
        for batch in batches:
            shares = batch.column(1).to_numpy()
            begins = np.flatnonzero(np.diff(shares, prepend=-1)).tolist()
            for begin, end in zip(begins, [*begins[1:], len(shares)], strict=True):
                if shares[begin] != share:
                    finish(trainer, held, rng)
                    share, held, trainer, rng = shares[begin], [], net.Trainer(flat), np.random.default_rng(7)
                for some in parts(batch.column(0).slice(begin, end - begin)):
                    _steps(trainer, known, some, rate, rng, passes * expected)
                    if passes > 1:
                        held.append(some)
        finish(trainer, held, rng)
        if total[-1]:
            yield _slices(total, 4)

    return run


def _steps(trainer: net.Trainer, known: Known, some: pa.Array, rate: float, rng: np.random.Generator, expected: int) -> None:
    """Train on every window of the texts once, in random order; the rate falls to a fifth over the tokens expected."""
    numbers, n = numbered(known, some)
    features, classes = known.rows
    read, score = laid_out(n)
    end = len(known.named) + SPARE_ROWS
    features[end - SPARE_ROWS : end] = np.eye(SPARE_ROWS, net.FEATURES, net.ABSENT, dtype=np.float32)  # nothing and the mark
    place = np.where(read >= 0, numbers.take(np.maximum(read, 0)), end + read)
    target = np.where(score >= 0, classes.take(numbers.take(np.maximum(score, 0))), -1)
    for rows in np.array_split(rng.permutation(len(place)), -(-len(place) // STEP_WINDOWS)):
        done = min(trainer.t * STEP_WINDOWS * net.SCORED / max(expected, 1), 1.0)
        trainer.step(features.take(place[rows], axis=0), target[rows], rate * (1 - 0.8 * done))


def score_texts(docs: DataFrame, *, held_out_of: int = 10, tokenizer: str | None = None) -> DataFrame:
    """One row per document: token counts, base score and the model's log10 probability.

    A null text is empty and has its end token alone.  Words outside the head are
    joined with their counts, their classes' and the chain's probabilities beside
    them, so each token has its count in both scores however rare it is.
    Repeated rows are scored each; a null ``doc_id`` stays null and counts as the
    empty text for the fold.  An empty table gives no rows.  Without training documents all counts are 0.
    A text of any length passes in windows, none of it held but its tokens.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model, counts = train(docs, held_out_of=held_out_of, tokenizer=tokenizer)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.keep_memory()
        uid = task_index() << 36
        scorer = kept(key, lambda: Scorer(shared.value, subwords(path)))
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for some in parts(batch.column(1)):
                for column, got in zip(columns, scorer(some), strict=True):
                    column.append(got)
            length, known, base, score, tail = (pa.concat_arrays(c) for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + batch.num_rows)), batch.column(0), batch.column(2), length, known, base, score, tail], names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"])
            uid += batch.num_rows

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket("doc_id", held_out_of) == 0).alias("held_out"))
    rows = materialised(wanted.mapInArrow(run, SCHEMA))
    each = rows.select("uid", F.explode("tail").alias("w")).select("uid", F.col("w.word").alias("word"), F.col("w.share").alias("share"), F.col("w.rest").alias("rest"))
    c = F.coalesce(F.col("n"), F.lit(0))
    whole = F.log10(F.col("share") * F.greatest(c - F.lit(model.discount), F.lit(0.0)) + F.col("rest") + 1e-300)
    per_text = each.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.log10((c + 0.1) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))).alias("more"), F.count_if(c > 0).alias("found"), F.sum(whole).alias("more_score"))
    zero = F.lit(0)
    return rows.drop("tail").join(per_text, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", zero)).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


class Scorer:
    """Scores of several texts: token counts, sums over head words of both scores, and the words outside the head."""

    def __init__(self, m: LanguageModel, encode: Subwords):
        self.m, self.net = m, net.Model(m.flat)
        taken, tokens, emb = m.taken, np.maximum(m.class_tokens, 1), self.net.p["emb"]

        def describe(ws: list[bytes]) -> tuple[np.ndarray, ...]:
            features, classes, log_chain = m.lexicon.described(encode, ws)
            count = np.fromiter(map(m.head.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
            share = np.maximum(count - taken[classes], 0) / tokens[classes]
            return features @ emb, classes, np.exp(log_chain), count, np.where(count >= 0, share, 1 / tokens[classes]), m.log10_unigram(np.maximum(count, 0))

        self.known, self.left = Known(describe), m.left
        self.marks = emb[[net.ABSENT, net.START]]

    def __call__(self, some: pa.Array) -> list[pa.Array]:
        numbers, n = numbered(self.known, some)
        vectors, classes, spelling, counts, shares, unigram = self.known.rows
        log_class, log_left = self.of_classes(vectors, classes, numbers, n)
        of_class, rest, inside = np.exp(log_class, dtype=np.float64) * shares.take(numbers), np.exp(log_left, dtype=np.float64) * spelling.take(numbers), counts.take(numbers) >= 0
        owner = np.repeat(np.arange(len(some)), n)
        base = np.bincount(owner, weights=np.where(inside, unigram.take(numbers), 0), minlength=len(some))
        known = np.bincount(owner[inside], minlength=len(some))
        score = np.bincount(owner, weights=np.where(inside, np.log10(of_class + rest + 1e-300), 0), minlength=len(some))
        out = np.flatnonzero(~inside)
        offsets = pa.array(np.searchsorted(owner[out], np.arange(len(some) + 1)), pa.int32())
        tail = pa.StructArray.from_arrays([pa.array([self.known.named[k] for k in numbers[out].tolist()], pa.binary()), pa.array(of_class[out]), pa.array(rest[out])], names=["word", "share", "rest"])
        return [pa.array(n), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(offsets, tail)]

    def of_classes(self, vectors: np.ndarray, classes: np.ndarray, numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of each token's class probability, and of what all classes leave to the chain there."""
        read, score = laid_out(n)
        x = np.empty((*read.shape, net.WIDTH), dtype=np.float32)
        np.take(vectors, numbers[np.maximum(read, 0)], axis=0, out=x, mode="clip")  # the other modes make a copy of x
        x[read == -2], x[read == -1] = self.marks
        target = np.where(score >= 0, classes.take(numbers.take(np.maximum(score, 0))), -1)
        return self.net.log_probabilities(x, target, self.left)
