"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from opledger.operators import kv, ratelimit
from opledger.plans.inputs import oplog
from opledger.plans.ratelimit import _limits, bucket_requests
from opledger.streaming import replay

SF = "/root/testdata/sf0.001"


def _stream(spark, df, path, parts=3):
    """The rows of ``df`` as a stream of files in order of ``idx``."""
    df.repartitionByRange(parts, "idx").sortWithinPartitions("idx").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, name, tmp_path):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_classify(spark, tmp_path):
    log = oplog(spark, SF).select("idx", "client_id", "request_id").filter("idx < 300")
    stream = _stream(spark, log, str(tmp_path / "in"), 1)
    got = {(r.idx, r["class"]) for r in _run(replay.classify(stream), "classified", tmp_path).collect()}
    assert got == {(r.idx, r["class"]) for r in kv.classify(log).collect()}


def test_admit(spark, tmp_path):
    r = bucket_requests(spark, SF).filter("idx < 300").drop("gateway")
    rows = r.join(_limits(r), "tenant").select("idx", "tenant", "ts_ms", "n", "rate", "burst")
    got = {(x.idx, x.admitted) for x in _run(replay.admit(_stream(spark, rows, str(tmp_path / "in"), 1)), "admitted", tmp_path).collect()}
    assert got == {(x.idx, x.admitted) for x in ratelimit.admit(r, _limits(r)).collect()}


def test_windows_and_first_submits(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("idx"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 5).alias("ts"), F.lit("q").alias("prefix"), (F.col("id") % 7).cast("string").alias("idem_key"))
    stream = _stream(spark, rows, str(tmp_path / "in"), 1)
    rates = _run(replay.rate(stream, "prefix"), "rates", tmp_path / "a").collect()
    assert rates and max(r.rate for r in rates) <= 0.2 + 1e-9
    assert _run(replay.first_submits(stream, within="1 hour"), "firsts", tmp_path / "b").count() == 7
    assert _run(replay.sessions(stream, "prefix", gap="10 seconds"), "sessions", tmp_path / "c").columns == ["start", "end", "prefix", "n"]
