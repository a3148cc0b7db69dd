"""Streams that meet streams, and state that ends by itself.

Each function takes streams and says what is in its state and when that goes. Runs
go on from their checkpoint: what has been answered is not answered again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.windows import last_before
from sluice.streaming.arrivals import arriving, run_available, work_dir


def replies(messages: DataFrame, threads: DataFrame, within: str, late: str) -> DataFrame:
    """message, at and thread_id of messages that answer a thread's message at most within after it; thread_id is null once none can come.

    messages: message, answers, at; threads: thread_id, message_id, thread_at. Both
    sides' rows are in state until the watermark, late behind the newest row, has
    passed all that they can meet; rows that come later are left out, and are for
    the fallback.
    """
    left = messages.select("message", "answers", "at").withWatermark("at", late)
    right = threads.select("thread_id", "message_id", "thread_at").withWatermark("thread_at", late)
    same = F.expr(f"answers = message_id AND at >= thread_at AND at <= thread_at + interval {within}")
    return left.join(right, same, "left_outer").select("message", "at", "thread_id")


def with_fallback(answered: DataFrame, messages: DataFrame, threads: DataFrame) -> DataFrame:
    """message, thread_id and how: id where the stream has found the thread; else subject, the newest thread before the message of its subject; else null.

    answered: what replies gave; messages: message, subject, at; threads: thread_id,
    subject, thread_at. Messages that the stream has not answered, since they came
    late or still wait, are among them. Of threads as new the larger id counts.
    """
    by_id = answered.where("thread_id is not null").select("message", F.col("thread_id").alias("__by_id"))
    first = messages.select("message", "subject", "at").join(by_id, "message", "left")
    marks = threads.select("subject", F.col("thread_at").alias("at"), F.col("thread_id").alias("__by_subject")).where("subject is not null and at is not null")
    open_ = first.where("__by_id is null and subject is not null").select("message", "subject", "at")
    met = last_before(open_, marks, "subject", "at", "__by_subject", F.to_date("at")).select("message", "__by_subject")
    how = F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_subject").isNotNull(), "subject")
    return first.join(met, "message", "left").select("message", F.coalesce("__by_id", "__by_subject").alias("thread_id"), how.alias("how"))


def _by_time(frames: Iterable[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(order), kind="stable")


def _ms(at: datetime) -> int:
    return int(at.timestamp() * 1000)


def purges(stream: DataFrame, key: str, at: str, status: str, number: str, terminal: Sequence[str], keep_days: int, late: str) -> DataFrame:
    """key, since and purged: a key whose status was terminal for keep_days, without a further change, loses its documents then.

    Only keys in a terminal status have state, the time since when; it goes with the
    next change, or by the timer of the retention. number orders changes at the same
    time. What comes later than late is left out.
    """
    keep = pd.Timedelta(days=keep_days)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def gone(since: datetime) -> pd.DataFrame:
            return pd.DataFrame({"key": [group[0]], "since": [since], "purged": [since + keep]})

        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield gone(since)
            return
        since = state.get[0] if state.exists else None
        for row in _by_time(frames, "at", "number").itertuples():
            if since is not None and row.at - since > keep:
                yield gone(since)
            since = row.at if row.status in terminal else None
        if since is None:
            if state.exists:
                state.remove()
        elif _ms(since + keep) <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield gone(since)
        else:
            state.update((since,))
            state.setTimeoutTimestamp(_ms(since + keep))

    rows = stream.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(status).alias("status"), F.col(number).alias("number")).withWatermark("at", late)
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, since timestamp, purged timestamp", "since timestamp", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("key", key)


def promotions(stream: DataFrame, key: str, at: str, number: str, adds: dict[str, tuple[int, float]], closes: Sequence[str], opens: Sequence[str], kind: str, value: str, least: tuple[int, float], forget_days: int, late: str) -> DataFrame:
    """key, promoted and number: when a key first has enough documents and score while it is open. It is promoted once.

    adds: documents and score for each unit of value by kind; closes and opens: kinds
    that shut a key and open it. State is (documents, score, open, done), and goes
    where nothing has come for forget_days: whatever comes later is a new key. The
    score is a double, added in order of time. A kind without points leaves it as it
    is, whatever its value; what is not a number is above all numbers, as in SQL.
    Rows without a time come last of a batch. What comes later than late, or is of
    before 1970, where watermarks begin, is left out.
    """
    forget = pd.Timedelta(days=forget_days)

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        documents, score, is_open, done = state.get if state.exists else (0, 0.0, True, False)
        last = None
        for row in _by_time(frames, "at", "number").itertuples():
            more, points = adds.get(row.kind, (0, 0.0))
            documents, score = documents + more, score + points * row.value if points else score
            is_open = (is_open or row.kind in opens) and row.kind not in closes
            if not done and is_open and documents >= least[0] and not score < least[1]:
                done = True
                yield pd.DataFrame({"key": [group[0]], "promoted": [row.at], "number": [row.number]})
            last = last if pd.isna(row.at) else row.at
        state.update((int(documents), float(score), bool(is_open), bool(done)))
        watermark = state.getCurrentWatermarkMs()
        until = watermark + forget // pd.Timedelta(milliseconds=1) if last is None else _ms(last + forget)
        state.setTimeoutTimestamp(max(until, watermark + 1))

    rows = stream.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(number).alias("number"), F.col(kind).alias("kind"), F.coalesce(value, F.lit(0.0)).alias("value")).withWatermark("at", late)
    of = rows.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").applyInPandasWithState(run, f"key {of}, promoted timestamp, number long", "documents int, score double, open boolean, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("key", key)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return arriving(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _messages(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'click'").select(F.col("event_id").alias("message"), F.expr("event_id - 1 - event_id % 4").alias("answers"), F.col("user_id").alias("subject"), F.col("ts").alias("at"))


def _threads(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").select(F.col("event_id").alias("thread_id"), F.col("event_id").alias("message_id"), F.col("user_id").alias("subject"), F.col("ts").alias("thread_at"))


def stream_replies(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "replies")
    run_available(replies(_messages(_events(spark, sf)), _threads(_events(spark, sf)), "10 days", "2 days"), folder)
    arrived = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return with_fallback(spark.read.parquet(f"{folder}/out"), _messages(arrived), _threads(arrived))


def stream_purges(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "purges")
    run_available(purges(_events(spark, sf), "user_id", "ts", "event_type", "event_id", ["purchase", "error"], 1, "1 hour"), folder)
    out = spark.read.parquet(f"{folder}/out")
    return out.select("user_id", F.unix_micros("since").alias("since"), F.unix_micros("purged").alias("purged"))


def stream_promotions(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_dir(spark, "promotions")
    adds = {"view": (1, 0.0), "purchase": (0, 1.0)}
    run_available(promotions(_events(spark, sf), "user_id", "ts", "event_id", adds, ["error"], ["signup"], "event_type", "value", (3, 100.0), 90, "1 day"), folder)
    return spark.read.parquet(f"{folder}/out").select("user_id", F.unix_micros("promoted").alias("promoted"), F.col("number").alias("event_id"))


QUERIES = {"stream_replies": stream_replies, "stream_purges": stream_purges, "stream_promotions": stream_promotions}
ORACLE_SQL = {
    "stream_replies": """
WITH m AS (SELECT event_id AS message, event_id - 1 - event_id % 4 AS answers, user_id AS subject, ts AS sent FROM events WHERE event_type = 'click'),
t AS (SELECT event_id AS thread_id, user_id AS subject, ts AS thread_at FROM events WHERE event_type = 'signup'),
i AS (SELECT m.*, t.thread_id AS by_id FROM m LEFT JOIN t ON m.answers = t.thread_id AND sent >= thread_at AND sent <= thread_at + INTERVAL 10 DAY),
s AS (SELECT message, t.thread_id AS by_subject FROM m JOIN t ON t.subject = m.subject AND thread_at <= sent QUALIFY row_number() OVER (PARTITION BY message ORDER BY thread_at DESC, t.thread_id DESC) = 1)
SELECT message, coalesce(by_id, by_subject) AS thread_id, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_subject IS NOT NULL THEN 'subject' END AS how FROM i LEFT JOIN s USING (message)""",
    "stream_purges": """
WITH e AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, max(ts) OVER () AS newest FROM events)
SELECT user_id, epoch_us(ts) AS since, epoch_us(ts + INTERVAL 1 DAY) AS purged FROM e
WHERE event_type IN ('purchase', 'error') AND coalesce(next_ts > ts + INTERVAL 1 DAY, epoch_ms(ts + INTERVAL 1 DAY) < epoch_ms(newest - INTERVAL 1 HOUR))""",
    "stream_promotions": """
WITH e AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS documents, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER w AS score,
  last_value(CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN true END IGNORE NULLS) OVER w AS is_open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, epoch_us(ts) AS promoted, event_id FROM e WHERE documents >= 3 AND score >= 100 AND coalesce(is_open, true) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
}
