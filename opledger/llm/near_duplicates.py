"""Near-duplicates: BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its runs of five words.  Each shingle has, for every
dyadic weight interval ([0,1), [1,2), [2,4), ...) that its count reaches into, a
Poisson process whose rate is the interval's width; a point's place inside a
partly covered interval comes from its hash bits, half by half, so that points
above the count are dropped and the rest stay the same for every count.  A point
falls into one register; a register keeps its earliest point.  Two texts agree in
a register with the probability of their weighted Jaccard similarity.

Texts that share a band meet in its bucket.  Each bucket's hub, the member that
meets most others, is compared with the members.  Where a bucket's members are
then still in different components, those outside the hub's component are held
against the others in blocks, of which only links come out.  So every pair of
similar texts that shares a bucket is compared or already connected.  Exact copies
are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm.common import Spread, bounded_batches, dropped, free_name, materialised, texts
from opledger.llm.components import components
from opledger.llm.decontamination import words

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and registers of a band: a pair at 0.8 misses all bands once in 14,000.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Keys that are broadcast at most to pick rows of the texts' table; beyond, the rows are shuffled.
BROADCAST_KEYS = 200_000
#: Members compared with one copy of their hub's text.
PER_HUB = 256
#: Members, and members outside the hub's component, of a bucket that one task holds against each other.
BLOCK = 512
CACHE_WORDS = 300_000

_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * _R
    return x ^ (x >> np.uint64(31))


def _times(k: int) -> np.uint64:
    return np.uint64((k * int(_P)) & 0xFFFFFFFFFFFFFFFF)


class Shingles:
    """Distinct 64-bit shingles of a text with their counts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Empty arrays for a text without words; a text of fewer than five words is one shingle."""
        ws, known = words(text), self.known
        if not ws:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        if new := [w for w in set(ws) if w not in known]:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(ws)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        width = min(SHINGLE, len(ws))
        n = len(ws) - width + 1
        s = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            s = s * _P + h[k : k + n]
        return np.unique(_mixed(s), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``(len(bags), REGISTERS)`` winners; bags must not be empty.

    Points are drawn in time order up to a limit by which all registers are
    expected to be met; bags with a register left open are drawn again for twice
    as long.
    """
    out = np.zeros((len(bags), REGISTERS), dtype=np.uint64)
    todo, limit = list(range(len(bags))), REGISTERS * (np.log(REGISTERS) + 4)
    while todo:
        total = np.array([bags[k][1].sum() for k in todo], dtype=np.float64)
        element = np.concatenate([bags[k][0] for k in todo])
        count = np.concatenate([bags[k][1] for k in todo]).astype(np.int64)
        bag = np.repeat(np.arange(len(todo)), [len(bags[k][0]) for k in todo])
        first = np.full(len(todo) * REGISTERS, np.inf)
        winner = np.zeros(len(todo) * REGISTERS, dtype=np.uint64)
        until, level = limit / total, 0
        while len(element):
            width = 1 << max(level - 1, 0)
            _process(element, count, bag, until[bag], level, width, first, winner)
            rest = count > (1 << level)
            element, count, bag = element[rest], count[rest], bag[rest]
            level += 1
        met = np.isfinite(first).reshape(-1, REGISTERS).all(axis=1)
        out[[k for k, m in zip(todo, met, strict=True) if m]] = winner.reshape(-1, REGISTERS)[met]
        todo, limit = [k for k, m in zip(todo, met, strict=True) if not m], 2 * limit
    return out


def _process(element, count, bag, until, level: int, width: int, first, winner) -> None:
    """Points of one weight interval's process for all elements that reach into it."""
    low = width if level else 0
    seed = _mixed(element + _times(level))
    time, j = np.zeros(len(element)), 0
    while len(seed):
        j += 1
        point = _mixed(seed + _times(j))
        time = time - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        live = time <= until
        seed, time, point, bag, until, count = seed[live], time[live], point[live], bag[live], until[live], count[live]
        more = _mixed(point + _R)
        inside = np.ones(len(point), dtype=bool)
        if width > 1:  # the interval's half, quarter, ... that the point lies in, by its bits
            inside = low + (more & np.uint64(width - 1)).astype(np.int64) < count
        register = bag[inside] * REGISTERS + ((more[inside] >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
        t, p = time[inside], point[inside]
        np.minimum.at(first, register, t)
        won = first[register] == t
        winner[register[won]] = p[won]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


_NODE = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("bands", T.BinaryType())])


def _nodes(keyed: DataFrame) -> DataFrame:
    """Distinct texts with words: ``(node, doc_id, rows, copies, bands)``; ``rows`` counts the rows of the least id."""
    bounded_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            bags = [shingles(t) for t in texts(batch.column(1))]
            keep = [k for k, b in enumerate(bags) if len(b[0])]
            if not keep:
                continue
            sig = signatures([bags[k] for k in keep]).reshape(len(keep), BANDS, ROWS)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(keep), BANDS)).copy()
            for k in range(ROWS):
                h = _mixed(h * _P + sig[:, :, k])
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), pa.array([x.tobytes() for x in h.astype("<u8")], pa.binary())], names=_NODE.names)

    rows = keyed.select("doc_id", "text", "node").mapInArrow(run, _NODE)
    by_id = rows.groupBy("node", "doc_id").agg(F.count("*").alias("n"), F.first("bands").alias("bands"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("n"))).alias("least")
    return by_id.groupBy("node").agg(least, F.sum("n").alias("copies"), F.first("bands").alias("bands")).select("node", "least.doc_id", F.col("least.n").alias("rows"), "copies", "bands")


def _members(nodes: DataFrame) -> tuple[DataFrame, Spread]:
    """``(h, node, size)`` of buckets with two and more texts, and the joins on ``h``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], names=["h", "node"])

    rows = nodes.select("node", "bands").mapInArrow(spread, "h long, node binary")
    sizes = materialised(rows.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"))
    spread_h = Spread(sizes, "h", "size")
    members = materialised(spread_h.join(rows, sizes))
    dropped(sizes)
    return members, spread_h


def _verified(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs ``(a, hub)`` whose texts' similarity reaches ``SIMILARITY``.

    A hub's text goes to each part of ``PER_HUB`` of its pairs; a part's texts
    pass through a task one after another behind the hub's.
    """
    by_hub = Spread(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub", "n", PER_HUB)
    members = by_hub.parts(pairs).withColumn("part", F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int")).drop("_parts")
    texts_of = candidates.select("node", "text")
    left = members.join(texts_of, members.a == texts_of.node).select("hub", "part", F.col("a"), "text")
    wide = by_hub.parts(pairs.select("hub").distinct())
    heads = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").join(texts_of, F.col("hub") == F.col("node")).select("hub", "part", F.lit(None).cast("binary").alias("a"), "text")
    laid = left.unionByName(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, hub, bag = Shingles(), None, None
        for batch in batches:
            out_a, out_hub = [], []
            for h, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if a is None:
                    hub, bag = h, shingles(text.as_py())
                elif h == hub and similarity(shingles(text.as_py()), bag) >= SIMILARITY:
                    out_a.append(a)
                    out_hub.append(h)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_hub, pa.binary())], names=["a", "b"])

    return laid.select("hub", "part", "a", "text").mapInArrow(run, "a binary, b binary")


def _across(placed: DataFrame, nodes: DataFrame, candidates: DataFrame, spread_h: Spread) -> DataFrame:
    """Links ``(a, b)`` between components, of texts that share a bucket.

    ``placed`` has ``(h, node, root, out)`` of buckets whose members are not all in
    the hub's component; ``out`` marks those outside.  A bucket's outsiders and its
    members are dealt into blocks of ``BLOCK``, and a task takes a block of either:
    it holds the outsiders while the members pass.  A pair is compared in the first
    bucket that it shares, and no more once the outsider is linked to the other's
    component.  Only links leave the task.
    """
    blocks = placed.groupBy("h").agg(F.count("*").alias("n"), F.count_if("out").alias("outs"))
    blocks = blocks.select("h", (F.col("n") / BLOCK).cast("int").alias("mb"), (F.col("outs") / BLOCK).cast("int").alias("ob"))
    rows = spread_h.join(placed, blocks).withColumn("own", F.xxhash64("node"))
    every = lambda n: F.sequence(F.lit(0), F.col(n))
    as_out = rows.filter("out").withColumn("o", F.pmod("own", F.col("ob") + 1).cast("int")).withColumn("m", F.explode(every("mb"))).withColumn("member", F.lit(False))
    as_member = rows.withColumn("m", F.pmod("own", F.col("mb") + 1).cast("int")).withColumn("o", F.explode(every("ob"))).withColumn("member", F.lit(True))
    texts_of = candidates.join(nodes.select("node", "bands"), "node").select("node", "text", "bands")
    laid = as_out.unionByName(as_member).select("h", "o", "m", "member", "node", "root", "out").join(texts_of, "node")
    laid = laid.repartition("h", "o", "m").sortWithinPartitions("h", "o", "m", "member").select("h", "o", "m", "member", "node", "root", "out", "bands", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, key, outs, grid, linked = Shingles(), None, [], None, []
        for batch in batches:
            found: list[tuple] = []
            for h, o, m, member, node, root, out, bands, text in zip(*(batch.column(k).to_pylist() for k in range(8)), batch.column(8), strict=True):
                if (h, o, m) != key:
                    key, outs, grid, linked = (h, o, m), [], None, []
                bands = np.frombuffer(bands, dtype="<i8")
                if not member:
                    outs.append((node, root, bands, shingles(text.as_py())))
                    linked.append(set())
                    continue
                if not outs:
                    continue
                if grid is None:
                    grid = np.stack([x[2] for x in outs])
                same = grid == bands
                here = int(np.flatnonzero(bands == h)[0])
                bag = None
                for k in np.flatnonzero(same[:, here] & (same.argmax(axis=1) == here)).tolist():
                    a, a_root, _, a_bag = outs[k]
                    if a_root == root or root in linked[k] or out and a >= node:
                        continue
                    bag = bag or shingles(text.as_py())
                    if similarity(a_bag, bag) >= SIMILARITY:
                        linked[k].add(root)
                        found.append((a, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(2)], names=["a", "b"])

    return laid.mapInArrow(run, "a binary, b binary")


def _picked(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row with its text for each wanted node."""
    keys = wanted.join(nodes.select("node", F.col("doc_id").alias("least")), "node")
    keys = materialised(keys)
    small = keys.count() <= BROADCAST_KEYS
    keys = F.broadcast(keys) if small else keys
    return keyed.join(keys, "node").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"])


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and the components of the texts that have a near-duplicate."""
    nodes = materialised(_nodes(keyed))
    members, spread_h = _members(nodes)
    weight = members.groupBy("node").agg(F.sum("size").alias("w"))
    heavy = members.select("h", "node").join(weight, "node").groupBy("h").agg(F.max(F.struct("w", "node")).alias("top")).select("h", F.col("top.node").alias("hub"))
    heavy = materialised(heavy)
    pairs = materialised(spread_h.join(members.select("h", F.col("node").alias("a")), heavy).filter("a <> hub").select("a", "hub").distinct())
    candidates = materialised(_picked(keyed, nodes, members.select("node").distinct()))
    links = materialised(_verified(pairs, candidates))
    roots = components(links)

    placed = members.select("h", "node").join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    hub_root = heavy.join(roots, heavy.hub == roots.node, "left").select("h", F.coalesce("root", "hub").alias("hub_root"))
    apart = spread_h.join(placed, hub_root).withColumn("out", F.col("root") != F.col("hub_root"))
    mixed = apart.filter("out").select("h").distinct()
    left = materialised(spread_h.join(apart, mixed, "left_semi").select("h", "node", "root", "out"))
    more = materialised(_across(left, nodes, candidates, spread_h))
    all_links = materialised(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b").unionByName(more))
    out = components(all_links)
    for t in (members, heavy, pairs, candidates, links, left, more, all_links):
        dropped(t)
    return nodes, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the class's least id) and ``class_texts`` (its different texts).

    A table without rows gives none.  Texts of any length are taken whole, each in
    one task's memory.

    Documents of equal text, and those whose texts are linked by similarities of
    0.8 and more, share a class.  A text without words (null, empty, no letters or
    digits) is like no other; its class is its own id.  Repeated rows come back
    each; null ids are counted last, so a class has a null id only if all its ids
    are null.  Other columns are not read.
    """
    keyed = _keyed(docs)
    nodes, roots = _classes(keyed)
    joined = nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    per_class = materialised(joined.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_texts")))
    classes = Spread(per_class, "root", "class_texts").join(joined.select("node", "root"), per_class).select("node", "class_id", "class_texts")
    copies = Spread(nodes, "node", "copies")
    return copies.join(keyed.select("doc_id", "node"), classes, "left").select("doc_id", F.when(F.col("class_texts").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the least id's document of each class; all columns stay.

    Rows that repeat the kept document are dropped too.  Texts without words (null,
    empty, blank) stay, and so does a table without rows.  Of documents with equal
    ids, and of null ids alone, the one with the least text digest stays.
    """
    keyed = _keyed(docs)
    nodes, roots = _classes(keyed)
    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = materialised(joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("node"))).alias("best"), F.count("*").alias("texts")))
    node_, least_, kept_, rows_ = (free_name(x, docs) for x in ("node", "least", "kept", "rows"))
    judged = Spread(best, "root", "texts").join(joined, best).filter("texts > 1 or copies > 1").select(F.col("node").alias(node_), F.col("best.doc_id").alias(least_), (F.col("best.node") == F.col("node")).alias(kept_), F.col("rows").alias(rows_))
    judged = materialised(judged)
    keys = F.broadcast(judged) if judged.count() <= BROADCAST_KEYS else judged
    node = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))
    marked = docs.join(keys, node == F.col(node_), "left").filter(F.col(kept_).isNull() | (F.col(kept_) & F.col("doc_id").cast("long").eqNullSafe(F.col(least_))))
    if judged.filter((F.col(rows_) > 1) & F.col(kept_)).limit(1).count():
        marked = marked.filter(F.coalesce(rows_, F.lit(1)) == 1).unionByName(marked.filter(F.col(rows_) > 1).dropDuplicates([node_]))
    return marked.select(*docs.columns)
