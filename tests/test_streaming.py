"""The streams give the rows of their batch forms."""

import os
import random

from pyspark.sql import functions as F

from attestor.streaming import jobs as J

EVENTS = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.table(name)


def events(spark, stream):
    schema = spark.read.parquet(f"{EVENTS}/events.parquet").schema
    reader = spark.readStream.schema(schema) if stream else spark.read.schema(schema)
    return reader.option("pathGlobFilter", "events.parquet").parquet(EVENTS)


def submissions(df):
    return df.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip_hash"), F.col("ts").alias("created_at"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_rate_limit_stream(spark):
    batch = J.submission_rate_limit(submissions(events(spark, False)), limit=1)
    stream = run(J.stream_rate_limit(submissions(events(spark, True)), limit=1, watermark="40 days"), "rate_limit")
    assert rows(stream, "id", "accepted") == rows(batch, "id", "accepted")
    assert batch.filter("not accepted").count() > 0


def test_rate_limit_brute_force(spark):
    """A burst across an hour boundary, against a plain count of earlier rows."""
    made = [(i, "a", 3590 + 7 * i) for i in range(40)] + [(100 + i, "b", 4000 * i) for i in range(5)]
    df = spark.createDataFrame(made, "id long, ip_hash string, at long").select("id", "ip_hash", F.timestamp_seconds("at").alias("created_at"))
    got = dict(rows(J.submission_rate_limit(df, 8), "id", "accepted"))
    for i, key, at in made:
        earlier = sum(1 for j, k, b in made if k == key and (b, j) < (at, i) and b >= at - 3600)
        assert got[i] == (earlier < 8)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHECK = "id long, source_id long, started_at timestamp, content_hash string"


def test_source_changes_in_the_order_of_events(spark, tmp_path):
    """Shuffled and late input, a file per micro-batch, gives what the batch form gives."""
    rng = random.Random(4)
    start = 1_700_000_000
    made = [(i, i % 7, start + 3600 * (i // 2) + rng.randrange(1800), rng.choice("ab")) for i in range(200)]
    late = sorted(made, key=lambda r: r[2] + rng.randrange(40) * 3600)  # up to 40 hours late
    end = [(1000 + k, k, start + 30 * 86400, "z") for k in range(8)] + [(2000, 99, start + 60 * 86400, "z")]
    parts = [late[i : i + 25] for i in range(0, 200, 25)] + [end[:8], end[8:]]
    inbox = str(tmp_path / "checks")
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "id long, source_id long, at long, content_hash string")
        df.select("id", "source_id", F.timestamp_seconds("at").alias("started_at"), "content_hash").coalesce(1).write.mode("append").parquet(inbox)
        for name in os.listdir(inbox):
            if name.endswith(".parquet") and os.path.getmtime(f"{inbox}/{name}") > 2000:
                os.utime(f"{inbox}/{name}", (1000 + k, 1000 + k))
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema(CHECK).option("maxFilesPerTrigger", 1).parquet(inbox)
        query = J.stream_source_changes(source, "48 hours", forget_days=10).writeStream.format("memory").queryName("source_changes").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    batch = J.source_changes(spark.read.schema(CHECK).parquet(inbox)).filter("id < 1000")
    assert rows(spark.table("source_changes").filter("id < 1000"), "id", "first", "changed") == rows(batch, "id", "first", "changed")
    # what was compared is gone, and quiet sources are forgotten: their check a month later counts as a first one
    assert sizes[-1] < max(sizes), sizes
    ends = {r["id"]: r["first"] for r in spark.table("source_changes").filter("id >= 1000").collect()}
    assert ends and all(ends.values())


def test_publication_counts_stream(spark):
    def published(df):
        return df.select("event_type", F.col("ts").alias("published_at"))

    batch = J.publication_counts(published(events(spark, False)))
    stream = run(J.publication_counts(published(events(spark, True)), watermark="1 day"), "publication_counts", "complete")
    assert rows(stream, "day", "event_type", "n") == rows(batch, "day", "event_type", "n")


def test_dedupe_stream(spark):
    def hashed(df):
        return df.select(F.col("event_id").alias("doc_id"), F.col("ts"), F.md5(F.col("value").cast("string")).alias("content_hash"))

    stream = run(J.stream_dedupe_evidence(hashed(events(spark, True)), "ts", "60 days"), "deduped")
    assert stream.count() == hashed(events(spark, False)).select("content_hash").distinct().count()


def test_exact_dedupe_by_batch(spark, tmp_path):
    table, inbox = str(tmp_path / "evidence"), str(tmp_path / "inbox")
    J.create_evidence_store(spark.createDataFrame([("h1", 1)], J.STORED), table)
    spark.createDataFrame([("h1", 2), ("h2", 3), ("h2", 4)], J.STORED).coalesce(1).write.parquet(inbox)
    source = spark.readStream.schema(J.STORED).parquet(inbox)
    for _ in range(2):
        J.write_new_evidence(source, table, os.path.join(str(tmp_path), "checkpoint")).start().awaitTermination(120)
    assert rows(spark.read.parquet(table), "content_hash", "doc_id") == [("h1", 1), ("h2", 3)]


def test_a_batch_opens_only_its_folders(spark, tmp_path):
    table = str(tmp_path / "evidence")
    stored = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("content_hash"), F.col("id").alias("doc_id"))
    J.create_evidence_store(stored, table, buckets=64)
    batch = spark.createDataFrame([("new", 9000)], J.STORED).unionByName(stored.filter("doc_id in (3, 4)"))
    known = J.known_evidence(J.with_bucket(batch, 64), table)
    opened = known.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < opened <= 3 < len(spark.read.parquet(table).inputFiles())
    assert "PartitionFilters: [isnotnull(bucket" in known._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [bucket" in known._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):  # a replayed batch adds nothing
        J.append_new_evidence(batch, table, 64)
        assert spark.read.parquet(table).count() == 2001
