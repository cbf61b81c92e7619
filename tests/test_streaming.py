from pyspark.sql import functions as F

from sievelight.operators import cache, pacing
from sievelight.streaming import state


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_latest_and_queue(spark, tmp_path):
    log = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 5)], "url string, content string, created_at long")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = {(r.url, r.content) for r in run(state.latest_pages(stream, None), "latest", "update").collect()}
    assert got == {("a", "new"), ("b", "x")}

    calls = spark.createDataFrame([("p", i, i * 10, 100, False) for i in range(5)], "provider string, ord long, arrive_ms long, duration_ms long, blocked boolean")
    calls.coalesce(1).write.parquet(str(tmp_path / "calls"))
    paced = run(state.paced(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))), "paced", "append")
    batch = {r.ord: r.start_ms for r in pacing.schedule(calls).collect()}
    assert {r.ord: r.start_ms for r in paced.collect()} == batch


def test_patterns_and_upserts(spark, tmp_path):
    c = spark.createDataFrame([("https://a.b/v/1", "GET", "application/json", "{}"), ("https://a.b/v/2", "GET", "application/json", "{}"), ("https://a.b/v/3", "GET", "text/html", "{}")], "url string, method string, content_type string, data string")
    c = c.withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    got = run(state.new_patterns(spark.readStream.schema(c.schema).parquet(str(tmp_path / "c"))), "patterns", "append").collect()
    assert [(r.domain, r.endpoint_pattern) for r in got] == [("a.b", "/v/*")]

    log = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "url string, content string, created_at long")
    log.coalesce(1).write.parquet(str(tmp_path / "l"))
    q = state.write_upserts(spark.readStream.schema(log.schema).parquet(str(tmp_path / "l")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    kept = cache.upsert(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    assert [(r.url, r.content) for r in kept.collect()] == [("a", "new")]
