"""Stateful streams: ranking alerts, quarantine, rate limits, frontier and stuck modules.

Each is a stream of events in, a stream of decisions out, over Structured Streaming state; run on a
bounded input (trigger availableNow) it gives what the batch query gives. Events later than the watermark are
dropped; within a micro-batch a key's events are taken in the order of time and sequence. Where keys are many and
their state is a row, as for alerts, it is a table that each micro-batch reads and writes anew, so that no key costs a call of Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import scores as S
from ..plans.registry import frame
from ..sources import stand_ins
from ..sources.scratch import shared_path

LATENESS = "1 day"
#: Decisions that a key hands on at once.
AT_ONCE = 10_000


def alert_type(new: int, old: int | None) -> str | None:
    """The rule for one change, as scores.alert has it for rows."""
    if old is None:
        return "new_ranking"
    if new > 100 >= old:
        return "lost_ranking"
    for edge in (3, 10):
        if new <= edge < old:
            return f"entered_top_{edge}"
    for edge in (10, 20):
        if old <= edge < new:
            return f"left_top_{edge}"
    return "big_jump" if old - new >= 10 else "big_drop" if new - old >= 10 else None


def alerts(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """An alert for each change that matters in rows (keyword, domain, position, seen_at, seq); last: each key's position before (see positions)."""
    held = rows.withColumn("fresh", F.lit(True))
    if last is not None:
        held = held.unionByName(last.withColumn("fresh", F.lit(False)), allowMissingColumns=True)
    old = F.lag("position").over(W.partitionBy("keyword", "domain").orderBy("fresh", "seen_at", "seq"))
    found = held.select("keyword", "domain", F.col("position").alias("new"), old.alias("old"), "seen_at", "seq", "fresh").where("fresh")
    return found.withColumn("alert", F.expr(S.alert("new", "old"))).where("alert IS NOT NULL").select("keyword", "domain", "alert", "old", "new", "seen_at", "seq")


def positions(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """keyword, domain, position: each key's last one after rows."""
    held = rows.select("keyword", "domain", "position", F.struct(F.lit(True).alias("fresh"), "seen_at", "seq").alias("at"))
    if last is not None:
        none = F.struct(F.lit(False).alias("fresh"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("seen_at", "seq")))
        held = held.unionByName(last.select("keyword", "domain", "position", none.alias("at")))
    return held.groupBy("keyword", "domain").agg(F.max_by("position", "at").alias("position"))


def _times(batches: Iterator[pd.DataFrame]) -> np.ndarray:
    """A key's seconds in order, eight bytes each: a key can have most of the events."""
    return np.sort(np.concatenate([b["s"].to_numpy("int64") for b in batches]))


def quarantines(events: DataFrame, errors: int = 3, window_s: int = 3600, hold_s: int = 3600) -> DataFrame:
    """key, s (epoch seconds) of errors to quarantines: `errors` of them within the window; the state is the times that still count and the end of the hold."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for s in map(int, _times(batches)):
            recent = [x for x in recent if x >= s - window_s] + [s]
            if len(recent) >= errors and s >= until:
                until = s + hold_s
                out.append((key[0], s, until))
        state.update((recent, until))
        yield pd.DataFrame(out, columns=["key", "from_s", "until_s"])

    return events.groupBy("key").applyInPandasWithState(run, "key long, from_s long, until_s long", "recent array<long>, until long", "append", GroupStateTimeout.NoTimeout)


class Holds(StatefulProcessor):
    """A key's recent errors and the end of its hold; the end of a hold is a timer, so a release is an event of its own."""

    def __init__(self, errors: int, window_s: int, hold_s: int):
        self.errors, self.window_s, self.hold_s = errors, window_s, hold_s

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "recent array<long>, until long")

    def handleInputRows(self, key, rows, timerValues):
        recent, until = (list(self.state.get()[0]), self.state.get()[1]) if self.state.exists() else ([], 0)
        for s in sorted(r["s"] for r in rows):
            recent = [x for x in recent if x >= s - self.window_s] + [s]
            if len(recent) >= self.errors and s >= until:
                until = s + self.hold_s
                self.handle.registerTimer(until * 1000)
                yield Row(key=key[0], event="hold", s=s, ts=datetime.fromtimestamp(s, UTC))
        self.state.update((recent, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = expiredTimerInfo.getExpiryTimeInMs() // 1000
        yield Row(key=key[0], event="release", s=s, ts=datetime.fromtimestamp(s, UTC))

    def close(self) -> None:
        pass


def holds(events: DataFrame, errors: int = 3, window_s: int = 3600, hold_s: int = 3600) -> DataFrame:
    """key, event (hold, release), s of errors (key, s, ts; under a watermark): a hold for `errors` errors within the window, a release when the watermark passes its end."""
    return events.groupBy("key").transformWithState(Holds(errors, window_s, hold_s), "key long, event string, s long, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts").select("key", "event", "s")


def token_buckets(requests: DataFrame, size: float = 10.0, per_minute: float = 10.0) -> DataFrame:
    """key, s to whether each request passes or how long it waits; the state is the tokens and the last time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (size, None)
        times = _times(batches)
        for start in range(0, len(times), AT_ONCE):
            out = []
            for s in times[start : start + AT_ONCE].tolist():
                if last is not None:
                    tokens = min(size, tokens + (s - last) / 60.0 * per_minute)
                last = s
                passed = tokens >= 1
                out.append((key[0], s, passed, 0.0 if passed else (1 - tokens) / per_minute * 60.0))
                tokens -= passed
            yield pd.DataFrame(out, columns=["key", "s", "passed", "wait_s"])
        state.update((tokens, last))

    return requests.groupBy("key").applyInPandasWithState(run, "key long, s long, passed boolean, wait_s double", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def frontiers(found: DataFrame) -> DataFrame:
    """domain, url, s to the URLs not seen before, with when they were found first: a resumable crawl's queue. Each URL has a state of its own, of one flag."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = min(int(x) for b in batches for x in b["s"])
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame([(key[0], key[1], first)], columns=["domain", "url", "s"])

    return found.groupBy("domain", "url").applyInPandasWithState(run, "domain string, url string, s long", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """Counts and sums by type and window of event time, under the watermark."""
    return events.withWatermark("ts", LATENESS).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, files a few at a time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _root(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"stream-{name}")


#: The state store that timers and states with several columns need.
TIMED_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Run a stream over what is there and return what it appended, as a table in the shared folder. root: where it ran before, to go on from there."""
    root = root or _root(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def drain_alerts(events: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Run a stream of positions over what is there and return its alerts. A batch that runs again writes over its alerts and positions; root as in drain."""
    spark, root = events.sparkSession, root or _root(events.sparkSession, name)

    def put(rows: DataFrame, batch: int) -> None:
        last = rows.sparkSession.read.parquet(f"{root}/last/{batch - 1}") if batch else None
        alerts(rows, last).write.mode("overwrite").parquet(f"{root}/out/{batch}")
        positions(rows, last).write.mode("overwrite").parquet(f"{root}/last/{batch}")

    query = events.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = "keyword long, domain string, alert string, old long, new long, seen_at timestamp, seq long"
    return spark.read.schema(schema).parquet(f"{root}/out/*")


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The same for a stream that updates its rows, open windows too: each key's last row. A batch that runs again writes over itself."""
    root = _root(stream.sparkSession, name)

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/{batch}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{root}/out/*")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


def _alerts_sql(d) -> str:
    return f"""WITH k AS ({stand_ins.rankings(d)}), l AS (SELECT keyword, domain, position AS new, lag(position) OVER (PARTITION BY keyword, domain ORDER BY seen_at, seq) AS old, seq FROM k)
SELECT keyword, domain, {S.alert('new', 'old')} AS alert, old, new, seq FROM l WHERE {S.alert('new', 'old')} IS NOT NULL"""


@frame("stream_alerts", "P7 E2 P14", _alerts_sql)
def stream_alerts(spark, sf_dir):
    events = event_stream(spark, sf_dir).select(F.col("user_id").alias("keyword"), F.col("event_type").alias("domain"), (F.floor("value").cast("long") % 100 + 1).alias("position"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"))
    return drain_alerts(events, "alerts").select("keyword", "domain", "alert", "old", "new", "seq")


def _holds_ctes(d, errors: int, window_s: int, hold_s: int) -> str:
    """holds: key, s of each hold. A hold begins at the first moment with errors enough that no hold covers; the moment after a hold is looked up for each."""
    return f"""RECURSIVE e AS (SELECT user_id % 10 AS key, {d.epoch('ts')} AS s FROM events WHERE event_type = 'error'),
m AS (SELECT DISTINCT key, s FROM (SELECT key, s, count(*) OVER (PARTITION BY key ORDER BY s RANGE BETWEEN {window_s} PRECEDING AND CURRENT ROW) AS n FROM e) w WHERE n >= {errors}),
n AS (SELECT a.key, a.s, min(b.s) AS next FROM m a JOIN m b ON a.key = b.key AND b.s >= a.s + {hold_s} GROUP BY a.key, a.s),
holds AS (SELECT key, min(s) AS s FROM m GROUP BY key UNION ALL SELECT n.key, n.next AS s FROM holds JOIN n ON holds.key = n.key AND holds.s = n.s)"""


def _quarantine_sql(d) -> str:
    return f"WITH {_holds_ctes(d, 5, 6 * 3600, 24 * 3600)} SELECT key, s AS from_s, s + {24 * 3600} AS until_s FROM holds"


def _errors(spark, sf_dir) -> DataFrame:
    return event_stream(spark, sf_dir).where("event_type = 'error'").select((F.col("user_id") % 10).alias("key"), F.unix_timestamp("ts").alias("s"), "ts")


@frame("stream_quarantine", "P8 P9", _quarantine_sql)
def stream_quarantine(spark, sf_dir):
    """Five errors of a tenth of the users within six hours hold it for a day."""
    return drain(quarantines(_errors(spark, sf_dir).drop("ts"), 5, 6 * 3600, 24 * 3600), "quarantine")


def _releases_sql(d) -> str:
    end = f"(SELECT max({d.epoch('ts')}) - 86400 FROM events WHERE event_type = 'error')"
    return f"WITH {_holds_ctes(d, 5, 6 * 3600, 24 * 3600)} SELECT key, 'hold' AS event, s FROM holds UNION ALL SELECT key, 'release' AS event, s + {24 * 3600} AS s FROM holds WHERE s + {24 * 3600} <= {end}"


@frame("stream_releases", "P8 P9 P13", _releases_sql)
def stream_releases(spark, sf_dir):
    """Holds of a tenth of the users, and their ends as events of their own: those that the watermark, a day behind the last error, has passed."""
    before = spark.conf.get(TIMED_STORE[0])
    spark.conf.set(*TIMED_STORE)
    try:
        return drain(holds(_errors(spark, sf_dir).withWatermark("ts", LATENESS), 5, 6 * 3600, 24 * 3600), "releases")
    finally:
        spark.conf.set(TIMED_STORE[0], before)


@frame("stream_rate_limit", "P10")
def stream_rate_limit(spark, sf_dir):
    requests = event_stream(spark, sf_dir).select((F.col("user_id") % 10).alias("key"), F.unix_timestamp("ts").alias("s"))
    return drain(token_buckets(requests, 2.0, 0.01), "rate")


def _frontier_sql(d) -> str:
    return f"""WITH f AS (SELECT 'd' || CAST(user_id % 20 AS string) AS domain, '/p' || CAST(CAST(floor(value) AS bigint) AS string) AS url, {d.epoch('ts')} AS s FROM events), u AS (SELECT domain, url, min(s) AS s FROM f GROUP BY domain, url)
SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY s, url) AS place FROM u"""


@frame("stream_frontier", "P6", _frontier_sql)
def stream_frontier(spark, sf_dir):
    """New URLs as they come, and their place in their domain's queue."""
    found = event_stream(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("domain"), F.concat(F.lit("/p"), F.floor("value").cast("string")).alias("url"), F.unix_timestamp("ts").alias("s"))
    rows = drain(frontiers(found), "frontier")
    return rows.select("domain", "url", F.row_number().over(W.partitionBy("domain").orderBy("s", "url")).alias("place"))


def _windows_sql(d) -> str:
    return f"SELECT {d.epoch('ts')} - {d.epoch('ts')} % 3600 AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2"


@frame("stream_windows", "P4 P12", _windows_sql)
def stream_windows(spark, sf_dir):
    """Counts and sums of every hour, closed by the watermark or still open."""
    rows = event_windows(event_stream(spark, sf_dir)).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")
    return drain_updates(rows, "windows", ["start", "event_type"])
