"""Benchmark decontamination by a prefix-filtered set join with exact windows.

An item's windows are its runs of ``WINDOW`` words; an item of fewer words is one
window.  A window occurs in a document only if its rarest word does, so that word
is the whole of the prefix that containment of all words requires.  Rarity is the
number of the word's occurrences in all documents.  A document word that is some
window's prefix fixes, by its place in the window, the only stretch where the
window can lie (the positional bound); stretches that would leave the document
are skipped (the length bound); the rest are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opledger.llm.common import bounded_batches, long_id, map_batches, materialised, texts

WINDOW = 10
#: Characters of benchmark text that are sent to the executors at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8 << 20

#: Other bytes than 0-9, a-z after lower-casing A-Z, and those of characters beyond ASCII.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = T.StructType([
    long_id(), T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False), T.StructField("n_items", T.LongType(), False),
    T.StructField("items_sha256", T.StringType(), False), T.StructField("contaminated", T.BooleanType(), False),
])


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows_of(item: list[bytes], width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if len(item) < width:
        if item:
            yield tuple(item)
        return
    for k in range(len(item) - width + 1):
        yield tuple(item[k : k + width])


class WindowIndex:
    """Windows by their rarest word: word -> [(place of the word, window, item ids)]."""

    def __init__(self, items: list[tuple[str, str]], counts: dict[bytes, int], width: int = WINDOW):
        of: dict[tuple, set] = defaultdict(set)
        for item_id, text in items:
            for w in windows_of(words(text), width):
                of[w].add(item_id)
        self.by_word: dict[bytes, list] = defaultdict(list)
        for w, ids in of.items():
            rarest = min(range(len(w)), key=lambda k: (counts.get(w[k], 0), w[k], k))
            self.by_word[w[rarest]].append((rarest, list(w), tuple(ids)))
        self.by_word = dict(self.by_word)

    def find(self, doc: list[bytes]) -> tuple[set, set]:
        """Places of the words inside any occurrence, and the items that occur."""
        table = self.by_word
        if table.keys().isdisjoint(doc):
            return set(), set()
        hit, items, n = set(), set(), len(doc)
        for at, word in enumerate(doc):
            if word not in table:
                continue
            for place, window, ids in table[word]:
                begin = at - place
                if begin >= 0 and begin + len(window) <= n and doc[begin : begin + len(window)] == window:
                    hit.update(range(begin, begin + len(window)))
                    items.update(ids)
        return hit, items


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the wanted words over all documents."""
    schema = "word binary, n long"
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        keep = shared.value
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(filter(keep.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r[0]): r[1] for r in rows}


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """The items in blocks of about ``BLOCK_BYTES``; at least one, empty or not."""
    out, size = [[]], 0
    listed = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    for item_id, text in listed.toLocalIterator():
        if size >= BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append((item_id, text))
        size += len(text)
    return out


def _shared_index(docs: DataFrame, block: list[tuple[str, str]], width: int):
    wanted = {w for _, text in block for w in words(text)}
    return docs.sparkSession.sparkContext.broadcast(WindowIndex(block, word_counts(docs, wanted) if wanted else {}, width))


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW) -> DataFrame:
    """One row per document: how many of its words lie in benchmark windows, and of which items.

    A null text has no words; so has a text without letters or digits, and
    neither is ever hit.  Null items, and items without a word, have no window.
    Items of equal text are all reported.  Repeated documents are reported each;
    a null ``doc_id`` stays null; other columns are not read.

    The benchmark is a stated query set, held against all documents in blocks of
    ``BLOCK_BYTES``.  With several blocks the places found are merged by text.
    """
    blocks = _blocks(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if len(blocks) > 1:
        return _in_blocks(rows, [_shared_index(docs, b, width) for b in blocks])
    shared = _shared_index(docs, blocks[0], width)

    def start():
        index = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hit, many, sha = [], [], [], []
            for text in texts(batch.column(1)):
                doc = words(text)
                places, items = index.find(doc)
                n.append(len(doc))
                hit.append(len(places))
                many.append(len(items))
                sha.append(_digest(items))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=SCHEMA.names)

        return step

    return map_batches(rows, SCHEMA, start)


def _in_blocks(rows: DataFrame, indexes: list) -> DataFrame:
    """One pass over the texts for each block; only texts with hits leave it, as places and items by digest."""
    keyed = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(words(t)) for t in texts(batch.column(1))], pa.int64())], names=["doc_id", "key", "n_words"])

    def found_by(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                got = [(k, *index.find(words(t))) for k, t in zip(batch.column(2).to_pylist(), texts(batch.column(1)), strict=True)]
                got = [g for g in got if g[1]]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([sorted(g[1]) for g in got], pa.list_(pa.int32())), pa.array([sorted(g[2]) for g in got], pa.list_(pa.string()))], names=["key", "places", "items"])

        return run

    parts = [keyed.mapInArrow(found_by(s), "key binary, places array<int>, items array<string>").dropDuplicates(["key"]) for s in indexes]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  one entry a block
    merged = materialised(hits.groupBy("key").agg(F.size(merge("places")).cast("long").alias("n_hit"), merge("items").alias("items")))
    none = F.array().cast("array<string>")
    items = F.coalesce("items", none)
    out = keyed.mapInArrow(counted, "doc_id long, key binary, n_words long").join(merged, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay.

    Null and empty texts stay, and so do all if the benchmark has no words.  Repeated
    rows are judged each for itself; an empty table stays empty.
    """
    at = docs.columns.index("text")
    for k, block in enumerate(_blocks(benchmark)):
        docs = _kept(materialised(docs) if k else docs, block, width, at)
    return docs


def _kept(docs: DataFrame, block: list[tuple[str, str]], width: int, at: int) -> DataFrame:
    shared = _shared_index(docs, block, width)

    def start():
        index = shared.value
        return lambda batch: batch.filter(pa.array([not index.find(words(t))[0] for t in texts(batch.column(at))], pa.bool_()))

    return map_batches(docs, docs.schema, start)


def _oracle() -> str:
    text = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {found.format(text.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {found.format(text.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM i, unnest(range(1, len(w) - n + 2)) u(k)),
sizes AS (SELECT DISTINCT n FROM iw), dn AS (SELECT r, w, n FROM d CROSS JOIN sizes WHERE len(w) >= n),
dw AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM dn, unnest(range(1, len(w) - n + 2)) u(k)),
h AS (SELECT r, k, n, item FROM dw JOIN iw USING (n, g)),
p AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM h) x GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""


ORACLE = _oracle()
