"""Queries of the semantic cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from opledger.operators import textsim as ts
from opledger.plans.book import Book
from opledger.plans.inputs import EVENTS, REQUESTS, events, requests, table
from opledger.plans.placement import fnv64_sql

BOOK = Book()
query, QUERIES, ORACLE = BOOK.query, BOOK.queries, BOOK.oracle

WHITE = r"[\p{Z}\s\x0b\x{85}]+"
_NORM = "lower(trim(regexp_replace({0}, '" + WHITE.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')))"
WHITE_FORM = _NORM.format("text")
TTL = 6 * 3_600_000


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5, length({_NORM.format('text')}) AS norm_chars FROM documents")
def text_normalise(spark, sf):
    n = ts.normalise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(n.cast("binary")).alias("norm_md5"), F.length(n).cast("bigint").alias("norm_chars"))


@query(f"SELECT doc_id, sha256({_NORM.format('text')}) AS key FROM documents")
def cache_exact_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ts.exact_key(F.col("text")).alias("key"))


@query(f"SELECT sha256({_NORM.format('text')}) AS key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def cache_exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", ts.exact_key(F.col("text")).alias("key"))
    return d.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(f"WITH {REQUESTS} SELECT request_id, sha256(lower('tenant:' || sha256(tenant) || ' ' || max_tokens || ' ' || trim(regexp_replace(prompt, '{WHITE}', ' ', 'g')))) AS key FROM requests")
def cache_gateway_key(spark, sf):
    return requests(spark, sf).select("request_id", ts.gateway_key(F.col("tenant"), F.col("max_tokens"), F.col("prompt")).alias("key"))


@query(f"""WITH t AS (SELECT item_id, {_NORM.format('text')} AS n FROM benchmark),
f AS (SELECT item_id, 'c:' || substr(n, i, 2) AS feature FROM t, unnest(range(1, length(n))) u(i)
  UNION ALL SELECT item_id, 'c:' || substr(n, i, 3) FROM t, unnest(range(1, length(n) - 1)) u(i)
  UNION ALL SELECT item_id, 'w:' || w FROM (SELECT item_id, regexp_replace(regexp_replace(unnest(string_split(n, ' ')), '^\\p{{P}}+', ''), '\\p{{P}}+$', '') AS w FROM t) x WHERE w <> ''),
g AS (SELECT item_id, feature, count(*) AS n FROM f GROUP BY item_id, feature), hashed AS (SELECT item_id, n, {fnv64_sql('feature')} AS h FROM g),
s AS (SELECT item_id, CAST(h % 512 AS BIGINT) AS bucket, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -n ELSE n END) AS n FROM hashed GROUP BY 1, 2 HAVING sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -n ELSE n END) <> 0),
norm AS (SELECT item_id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM s GROUP BY item_id)
SELECT item_id, bucket, round(CAST(n AS DOUBLE) / norm, 6) AS weight FROM s JOIN norm USING (item_id)""")
def ngram_embedding_sparse(spark, sf):
    return ts.embed_sparse(table(spark, sf, "benchmark"), "item_id", "text").select("item_id", "bucket", F.round("weight", 6).alias("weight"))


def _top(spark, sf):
    e = table(spark, sf, "embeddings")
    return ts.nearest(e.filter("vec_id % 50 = 0"), e)


_TOP = """best AS (SELECT q.vec_id AS query_id, arg_max(i.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))) AS neighbour_id,
  max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[]))) AS similarity
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id)"""


@query(f"WITH {_TOP} SELECT query_id, neighbour_id, round(similarity, 6) AS similarity FROM best")
def vec_cosine_top1(spark, sf):
    return _top(spark, sf).select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_TOP} SELECT query_id, neighbour_id FROM best WHERE similarity >= 0.4")
def vec_near_hits(spark, sf):
    return _top(spark, sf).filter("similarity >= 0.4").select("query_id", "neighbour_id")


_TURNS = "turns AS (SELECT 2 * (1000 * conv_id + turn) AS id, text FROM conversations UNION ALL SELECT 2 * (1000 * conv_id + turn) + 1, substr(text, 3) FROM conversations)"


@query(f"""WITH {_TURNS}, n AS (SELECT {_NORM.format('text')} AS norm, min(id) AS id FROM turns GROUP BY 1),
t AS (SELECT id, norm, length(norm) AS size FROM n WHERE norm <> ''), s AS (SELECT id, norm, size, size + unnest(range(0, 4)) AS reach FROM t),
c AS MATERIALIZED (SELECT x.id AS a, y.id AS b, x.norm AS p, y.norm AS q FROM s x JOIN t y ON y.size = x.reach AND (y.size > x.size OR x.id < y.id))
SELECT least(a, b) AS a, greatest(a, b) AS b FROM c WHERE levenshtein(p, q) <= 3""")
def near_duplicate_pairs(spark, sf):
    """All turns, each also without its first two characters, as a prompt sent again by a sloppier hand."""
    c = table(spark, sf, "conversations")
    key = 2 * (1000 * F.col("conv_id") + F.col("turn"))
    turns = c.select(key.alias("id"), "text").unionByName(c.select((key + 1).alias("id"), F.expr("substring(text, 3)").alias("text")))
    return ts.near_pairs(turns, "id", "text")


_GATEWAY_KEY = f"sha256(lower('tenant:' || sha256(tenant) || ' ' || max_tokens || ' ' || trim(regexp_replace(prompt, '{WHITE}', ' ', 'g'))))"


@query(f"""WITH RECURSIVE {REQUESTS}, g AS MATERIALIZED (SELECT request_id, ts_ms, {_GATEWAY_KEY} AS key FROM requests), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms, request_id) AS rn FROM g),
f AS (SELECT key, rn, request_id, ts_ms AS stored_ms, false AS hit FROM r WHERE rn = 1
  UNION ALL SELECT r.key, r.rn, r.request_id, CASE WHEN f.stored_ms + {10 * TTL} < r.ts_ms THEN r.ts_ms ELSE f.stored_ms END, NOT f.stored_ms + {10 * TTL} < r.ts_ms FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1)
SELECT request_id, key, hit FROM f""")
def cache_lookup_replay(spark, sf):
    r = requests(spark, sf).select("request_id", "ts_ms", ts.gateway_key(F.col("tenant"), F.col("max_tokens"), F.col("prompt")).alias("key"))
    return ts.replay(r, ttl_ms=10 * TTL)


_STORES = f"r AS (SELECT request_id, ts_ms, item_id AS key, k FROM requests), st AS (SELECT key, ts_ms AS stored_ms, request_id FROM r WHERE k % 5 = 0)"
_OUTCOME = f"CASE WHEN stored_ms IS NULL THEN 'miss' WHEN stored_ms + {TTL} < ts_ms THEN 'expired' ELSE 'hit' END"


@query(f"WITH {REQUESTS}, {_STORES} SELECT request_id, outcome FROM (SELECT r.request_id, {_OUTCOME} AS outcome FROM r ASOF LEFT JOIN st ON r.key = st.key AND r.ts_ms >= st.stored_ms WHERE r.k % 5 <> 0)")
def cache_ttl_hits(spark, sf):
    r = requests(spark, sf).select("request_id", "ts_ms", F.col("item_id").alias("key"), "k")
    stores = r.filter("k % 5 = 0").select("key", "ts_ms", F.col("request_id").cast("string").alias("text"))
    return ts.lookups(r.filter("k % 5 <> 0"), stores, ttl_ms=TTL).select("request_id", "outcome")


@query(f"""WITH {REQUESTS}, {_STORES}, o AS (SELECT CASE WHEN stored_ms IS NOT NULL AND NOT (stored_ms + {TTL} < ts_ms) THEN 'exact' WHEN r.k % 7 = 0 THEN 'near' WHEN r.k % 7 = 1 THEN 'near_rejected' ELSE 'miss' END AS outcome
FROM r ASOF LEFT JOIN st ON r.key = st.key AND r.ts_ms >= st.stored_ms WHERE r.k % 5 <> 0)
SELECT count(*) AS lookups, count(*) FILTER (WHERE outcome = 'exact') AS exact_hits, count(*) FILTER (WHERE outcome = 'near') AS near_hits, count(*) FILTER (WHERE outcome IN ('miss', 'near_rejected')) AS misses, count(*) FILTER (WHERE outcome = 'near_rejected') AS near_rejected FROM o""")
def cache_stats(spark, sf):
    r = requests(spark, sf).select("request_id", "ts_ms", F.col("item_id").alias("key"), "k")
    stores = r.filter("k % 5 = 0").select("key", "ts_ms", F.col("request_id").cast("string").alias("text"))
    o = ts.lookups(r.filter("k % 5 <> 0"), stores, ttl_ms=TTL)
    return ts.stats(o.withColumn("outcome", F.when(F.col("outcome") == "hit", "exact").when(F.col("k") % 7 == 0, "near").when(F.col("k") % 7 == 1, "near_rejected").otherwise("miss")))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS similarity, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM p""")
def vec_cosine_pairs(spark, sf):
    """Each vector with its successor: their cosine, and the first component at length 1."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return e.join(after, "vec_id").select("vec_id", F.round(ts.cosine(F.col("embedding"), F.col("w")), 6).alias("similarity"), F.round(ts.unit(F.col("embedding"))[0], 6).alias("first"))


@query(f"WITH {EVENTS}, f AS (SELECT user_id AS key, min(event_id) AS first FROM ev GROUP BY user_id) SELECT key, first FROM f ORDER BY first DESC LIMIT 50")
def cache_fifo_index(spark, sf):
    """The fifty newest keys of an index that holds no more."""
    return ts.fifo_index(events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("idx")), 50)


#: Each benchmark text asked for in four ways: in other spacing, with two characters missing, with words behind it, and backwards.
_ASKED = """asked AS (SELECT 4 * item_id AS id, '  ' || replace(text, ' ', '  ') AS text FROM benchmark UNION ALL SELECT 4 * item_id + 1, substr(text, 3) FROM benchmark
  UNION ALL SELECT 4 * item_id + 2, text || ' and once more' FROM benchmark UNION ALL SELECT 4 * item_id + 3, reverse(text) FROM benchmark)"""
_FNV = fnv64_sql("feature")


@query(f"""WITH {_ASKED}, forms AS (SELECT {WHITE_FORM} AS norm, min(item_id) AS entry_id FROM (SELECT item_id, text FROM benchmark) b GROUP BY 1), q AS (SELECT a.id, a.norm, f.entry_id FROM (SELECT id, {WHITE_FORM} AS norm FROM asked) a LEFT JOIN forms f ON f.norm = a.norm),
t AS (SELECT 'q' AS side, id, norm FROM q WHERE entry_id IS NULL UNION ALL SELECT 'e', entry_id, norm FROM forms),
f AS (SELECT side, id, 'c:' || substr(norm, i, 2) AS feature FROM t, unnest(range(1, length(norm))) u(i) UNION ALL SELECT side, id, 'c:' || substr(norm, i, 3) FROM t, unnest(range(1, length(norm) - 1)) u(i)
  UNION ALL SELECT side, id, 'w:' || w FROM (SELECT side, id, regexp_replace(regexp_replace(unnest(string_split(norm, ' ')), '^\\p{{P}}+', ''), '\\p{{P}}+$', '') AS w FROM t) x WHERE w <> ''),
h AS (SELECT side, id, {_FNV} AS h FROM f), s AS (SELECT side, id, CAST(h % 512 AS BIGINT) AS bucket, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END) AS n FROM h GROUP BY 1, 2, 3),
norms AS (SELECT side, id, sqrt(sum(CAST(n AS DOUBLE) * n)) AS size FROM s GROUP BY 1, 2),
sim AS (SELECT a.id, b.id AS entry_id, sum(CAST(a.n AS DOUBLE) * b.n) / any_value(x.size) / any_value(y.size) AS similarity FROM s a JOIN s b ON a.side = 'q' AND b.side = 'e' AND a.bucket = b.bucket JOIN norms x ON x.side = 'q' AND x.id = a.id JOIN norms y ON y.side = 'e' AND y.id = b.id GROUP BY 1, 2),
best AS (SELECT id, arg_max(entry_id, similarity) AS entry_id, max(similarity) AS similarity FROM sim GROUP BY id),
j AS (SELECT q.id, b.entry_id, CASE WHEN b.similarity >= 0.92 THEN levenshtein(q.norm, e.norm) END AS edits FROM q LEFT JOIN best b ON b.id = q.id LEFT JOIN forms e ON e.entry_id = b.entry_id WHERE q.entry_id IS NULL)
SELECT id, entry_id, 'exact' AS outcome FROM q WHERE entry_id IS NOT NULL
UNION ALL SELECT id, CASE WHEN edits <= 3 THEN entry_id END, CASE WHEN edits IS NULL THEN 'miss' WHEN edits <= 3 THEN 'near' ELSE 'near_rejected' END FROM j""")
def cache_lookup_near(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text")
    ways = (F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("  "))), F.expr("substring(text, 3)"), F.concat("text", F.lit(" and once more")), F.reverse("text"))
    asked = None
    for k, way in enumerate(ways):
        part = b.select((4 * F.col("item_id") + k).alias("id"), way.alias("text"))
        asked = part if asked is None else asked.unionByName(part)
    return ts.near_lookups(asked, b.select(F.col("item_id").alias("id"), "text"))

