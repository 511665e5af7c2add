"""Four request-time checks as batch jobs and as Structured Streaming jobs.

A batch form and its stream give the same rows; the batch form is the one
checked against SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3600


def _decide(recent: list[int], micros: int, limit: int) -> tuple[bool, list[int]]:
    """Is a submission accepted, and the accepted times that may still count."""
    recent = [t for t in recent if t >= micros - HOUR * 1_000_000]
    return (True, [*recent, micros]) if len(recent) < limit else (False, recent)


def submission_rate_limit(submissions: DataFrame, limit: int = 8) -> DataFrame:
    """Accept a submission unless ``limit`` accepted ones came from its address in the hour before.

    Only stored, so accepted, submissions count, and a missing address is never
    limited.  A pause of over an hour forgets everything, so an address is cut
    there into runs; the cuts come from the first and last time of each (address,
    hour), which Spark sums up before shuffling.  Each run is then read in order
    with at most ``limit`` times in hand; no run is held as a whole.
    """
    rows = submissions.select("id", "ip_hash", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    limited = F.coalesce(F.col("ip_hash") != "", F.lit(False))
    free = rows.filter(~limited).select("id", "ip_hash", F.lit(True).alias("accepted"))
    hour = F.floor(F.col("t") / (HOUR * 1_000_000))
    rows = rows.filter(limited).withColumn("hour", hour)
    ends = rows.groupBy("ip_hash", "hour").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    order = W.partitionBy("ip_hash").orderBy("hour")
    fresh = F.coalesce(F.col("first") - F.lag("last").over(order) > HOUR * 1_000_000, F.lit(True))
    runs = ends.withColumn("fresh", fresh).withColumn("run", F.max(F.when(F.col("fresh"), F.col("hour"))).over(order))
    dealt = rows.join(runs.select("ip_hash", "hour", "run"), ["ip_hash", "hour"]).select("ip_hash", "run", "t", "id")
    dealt = dealt.repartition("ip_hash", "run").sortWithinPartitions("ip_hash", "run", "t", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = None, []
        for batch in batches:
            accepted = []
            for ip, run, t in zip(batch["ip_hash"], batch["run"], batch["t"], strict=True):
                if (ip, run) != key:
                    key, recent = (ip, run), []
                ok, recent = _decide(recent, int(t), limit)
                accepted.append(ok)
            yield pd.DataFrame({"id": batch["id"], "ip_hash": batch["ip_hash"], "accepted": accepted})

    kind = submissions.schema["id"].dataType.simpleString()
    return dealt.mapInPandas(fold, f"id {kind}, ip_hash string, accepted boolean").unionByName(free)


def stream_rate_limit(submissions: DataFrame, limit: int = 8, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form; the state of an address is its last accepted times, ``limit`` at most.

    Rows of one address are ordered within a micro-batch.  State expires an
    hour of event time after the last accepted submission.
    """
    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        accepted = []
        for micros in rows["created_at"].astype("datetime64[us]").astype("int64"):
            ok, recent = _decide(recent, int(micros), limit)
            accepted.append(ok)
        if recent:
            state.update((recent,))
            state.setTimeoutTimestamp(max(recent[-1] // 1000, state.getCurrentWatermarkMs()) + HOUR * 1000 + 1)
        yield pd.DataFrame({"id": rows["id"], "ip_hash": key[0], "accepted": accepted})

    limited = F.coalesce(F.col("ip_hash") != "", F.lit(False))
    rows = submissions.select("id", "ip_hash", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", watermark)
    checked = (
        rows.filter(limited)
        .groupBy("ip_hash")
        .applyInPandasWithState(
            decide,
            "id long, ip_hash string, accepted boolean",
            "times array<long>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return checked.unionByName(rows.filter(~limited).select("id", "ip_hash", F.lit(True).alias("accepted")))


def source_changes(checks: DataFrame) -> DataFrame:
    """Does the content of a source differ from its previous check?

    Checks are compared within (source, day); the first check of a day is
    compared with the last hash of the source's previous day that had any.
    """
    rows = checks.select("id", "source_id", "started_at", "content_hash", F.to_date("started_at").alias("day"))
    last = rows.groupBy("source_id", "day").agg(F.max(F.struct("started_at", "id", "content_hash")).getField("content_hash").alias("last_hash"))
    # One row per source and day remains here.
    carried = last.withColumn("carried_hash", F.lag("last_hash").over(W.partitionBy("source_id").orderBy("day"))).drop("last_hash")
    within = F.lag("content_hash").over(W.partitionBy("source_id", "day").orderBy("started_at", "id"))
    j = rows.withColumn("previous", within).join(carried, ["source_id", "day"])
    before = F.coalesce("previous", "carried_hash")
    return j.select("id", "source_id", before.isNull().alias("first"), F.coalesce(before != F.col("content_hash"), F.lit(True)).alias("changed"))


class SourceHistory(StatefulProcessor):
    """Checks of one source, held until the watermark has passed them, then compared in the order of events.

    State: checks that wait, and the newest hash compared so far with its
    time.  A timer stands at the earliest waiting check; when none waits, at
    the time after which a quiet source is forgotten.
    """

    WAITING = "id long, started_at long, content_hash string"

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.newest = handle.getValueState("newest", "content_hash string, at long")

    def _alarm(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = min([t for t in self.handle.listTimers()] if self.waiting.exists() else [], default=None)
        for some in rows:
            at = some["started_at"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(some["id"].tolist(), at.tolist(), some["content_hash"].tolist(), strict=True)))
            soonest = int(at.min()) // 1000 + 1
            first = soonest if first is None else min(first, soonest)
        if first is not None:
            self._alarm(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._none()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        if not held:
            self.newest.clear()
            yield self._none()
            return
        held.sort(key=lambda r: (r[1], r[0]))
        ready = [r for r in held if r[1] // 1000 < mark]
        rest = held[len(ready) :]
        last, seen = self.newest.get() if self.newest.exists() else (None, None)
        out = []
        for i, at, content in ready:
            fresh = seen is None or (at - seen) // 1000 > self.forget_ms
            out.append((i, key[0], fresh, fresh or last != content))
            last, seen = content, at
        if ready:
            self.newest.update((last, ready[-1][1]))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][1] // 1000 + 1, mark + 1))
        else:
            self.waiting.clear()
            self.handle.registerTimer(ready[-1][1] // 1000 + self.forget_ms)
        yield pd.DataFrame(out, columns=["id", "source_id", "first", "changed"])

    def _none(self) -> pd.DataFrame:
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "source_id": pd.Series(dtype="int64"), "first": pd.Series(dtype=bool), "changed": pd.Series(dtype=bool)})

    def close(self) -> None:
        pass


def stream_source_changes(checks: DataFrame, watermark: str = "1 day", forget_days: int = 400) -> DataFrame:
    """Streaming form, in the order of events: a check is compared once the watermark has passed it.

    Checks that come later than the watermark are dropped; a source without a
    check for ``forget_days`` starts anew.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = checks.select("id", "source_id", F.col("started_at").cast("timestamp").alias("started_at"), "content_hash").withWatermark("started_at", watermark)
    return rows.groupBy("source_id").transformWithStateInPandas(
        SourceHistory(forget_days * 86_400_000), outputStructType="id long, source_id long, first boolean, changed boolean", outputMode="append", timeMode="eventTime"
    )


def publication_counts(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events per day and type; with a watermark this is the streaming form."""
    rows = events.withColumn("published_at", F.col("published_at").cast("timestamp"))
    rows = rows.withWatermark("published_at", watermark) if watermark else rows
    return rows.groupBy(F.window("published_at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.to_date("w.start").alias("day"), "event_type", "n"
    )


def dedupe_evidence(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose hash is not stored, the first of each hash."""
    first = documents.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return first.join(stored.select("content_hash"), "content_hash", "left_anti")


def stream_dedupe_evidence(documents: DataFrame, event_time: str, watermark: str = "1 day") -> DataFrame:
    """Streaming form for copies that arrive within the watermark of each other."""
    return documents.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["content_hash"])


#: Folders of the store of hashes; a power of two.
BUCKETS = 1024
STORED = "content_hash string, doc_id long"


def with_bucket(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).cast("int"))


def known_evidence(batch: DataFrame, path: str) -> DataFrame:
    """The stored rows in the folders that may hold the hashes of ``batch`` (with ``bucket``); the others are not opened."""
    wanted = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most as many as there are folders
    known = batch.sparkSession.read.schema(STORED + ", bucket int").parquet(path)
    return known.filter(F.col("bucket").isin(wanted) if wanted else F.lit(False))


def append_new_evidence(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store the rows whose hash is not stored, the first of each hash, a file per folder, with Bloom filters of the hashes."""
    rows = with_bucket(rows, buckets)
    first = rows.groupBy("bucket", "content_hash").agg(F.min("doc_id").alias("doc_id"))
    new = first.join(known_evidence(rows, path).select("bucket", "content_hash"), ["bucket", "content_hash"], "left_anti")
    out = new.repartition("bucket").write.mode("append").option("parquet.bloom.filter.enabled#content_hash", "true")
    out.partitionBy("bucket").parquet(path)


def create_evidence_store(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new store of rows (content_hash, doc_id)."""
    first = with_bucket(rows, buckets).groupBy("bucket", "content_hash").agg(F.min("doc_id").alias("doc_id"))
    first.repartition("bucket").write.option("parquet.bloom.filter.enabled#content_hash", "true").partitionBy("bucket").parquet(path)


def write_new_evidence(documents: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Exact form: every micro-batch appends only hashes the store does not hold, and opens only folders that may hold them.

    A batch that is replayed after a failure finds its own rows stored and
    appends nothing.
    """
    def append(batch: DataFrame, _: int) -> None:
        append_new_evidence(batch, path, buckets)

    return documents.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)
