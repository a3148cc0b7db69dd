"""Streams over several batches, state that ends, and tables of buckets."""

import os

import pytest
from pyspark.sql import functions as F

from sluice.sources import sinks
from sluice.streaming import correlate
from sluice.streaming.arrivals import run_available
from tests.conftest import SF


@pytest.fixture
def in_files(spark, tmp_path):
    """Events in eight files by time, which arrive one after the other."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id").toPandas()
    folder = tmp_path / "events"
    folder.mkdir()
    for k in range(8):
        part = events.iloc[k * len(events) // 8 : (k + 1) * len(events) // 8]
        part.to_parquet(folder / f"{k}.parquet", index=False, coerce_timestamps="us")
        os.utime(folder / f"{k}.parquet", (1_000_000 + 100 * k,) * 2)
    schema = spark.read.parquet(str(folder)).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream, spark.read.parquet(str(folder))


def test_replies_hold_only_what_can_still_be_met(spark, in_files, tmp_path):
    stream, events = in_files
    find = lambda: correlate.replies(correlate._messages(stream()), correlate._threads(stream()), "2 days", "1 day")
    query = run_available(find(), str(tmp_path / "r"))
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    total = correlate._messages(events).count() + correlate._threads(events).count()
    # eight batches of four days or so: state covers three days, not the whole month
    assert max(rows) < total / 2
    out = spark.read.parquet(str(tmp_path / "r/out"))
    first = sorted(map(tuple, out.collect()), key=repr)
    sent, begun = correlate._messages(events), correlate._threads(events)
    want = sent.join(begun, F.expr("answers = message_id AND at >= thread_at AND at <= thread_at + interval 2 days")).count()
    assert out.where("thread_id is not null").count() == want > 0
    # once more: nothing new
    run_available(find(), str(tmp_path / "r"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "r/out")).collect()), key=repr) == first
    whole = correlate.with_fallback(out, sent, begun)
    assert whole.count() == sent.count() and whole.where("how = 'id'").count() == want


def test_batches_purge_what_one_batch_purges(spark, in_files, tmp_path):
    stream, events = in_files
    args = ("user_id", "ts", "event_type", "event_id", ["purchase", "error"], 1, "1 hour")
    query = run_available(correlate.purges(stream(), *args), str(tmp_path / "many"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "many/out")).select("user_id", F.unix_micros("since")).collect())
    whole = correlate.stream_purges(spark, SF).collect()
    assert got == sorted((r["user_id"], r["since"]) for r in whole)
    # keys that were purged, or are not in a terminal status, have no state
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < events.select("user_id").distinct().count()


def test_promoted_once(spark, in_files, tmp_path):
    stream, _ = in_files
    adds = {"view": (1, 0.0), "purchase": (0, 1.0)}
    make = lambda: correlate.promotions(stream(), "user_id", "ts", "event_id", adds, ["error"], ["signup"], "event_type", "value", (3, 100.0), 90, "1 day")
    for _ in range(2):
        run_available(make(), str(tmp_path / "p"))
    got = sorted((r["user_id"], r["number"]) for r in spark.read.parquet(str(tmp_path / "p/out")).collect())
    assert got == sorted((r["user_id"], r["event_id"]) for r in correlate.stream_promotions(spark, SF).collect())
    assert len({u for u, _ in got}) == len(got)
    # with a short memory idle keys are forgotten
    held = {}
    for days in (90, 1):
        query = run_available(correlate.promotions(stream(), "user_id", "ts", "event_id", adds, ["error"], ["signup"], "event_type", "value", (3, 100.0), days, "1 hour"), str(tmp_path / f"forget-{days}"))
        held[days] = min(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[2:] if p["stateOperators"])
    assert held[1] < held[90]


NAN, INF = float("nan"), float("inf")
VIEWS = [("view", 1.0)] * 3
HISTORIES = {
    "values": [
        [*VIEWS, ("click", NAN), ("purchase", 100.0)],
        [("view", INF), ("view", NAN), ("view", None), ("purchase", 99.0), ("error", INF), (None, NAN), ("signup", INF), ("purchase", 1.0)],
        [*VIEWS, ("purchase", NAN), ("view", 1.0)],
        [*VIEWS, ("purchase", INF), ("purchase", -INF)],
        [*VIEWS, ("purchase", None), ("purchase", -INF), ("purchase", 200.0)],
        # 100.00 in cents, 99.99999999999999 as doubles in order of time
        [*VIEWS, ("purchase", 75.05), ("purchase", 20.97), ("purchase", 0.85), ("purchase", 3.13), ("view", 1.0)],
    ],
    "times": [
        [*VIEWS, ("purchase", 100.0), ("late", 1.0)],
        [("late", 1.0), *VIEWS[:2], ("purchase", 100.0), ("view", 1.0)],
        [("late", 1.0), ("late", 100.0), ("late", 1.0)],
    ],
}


@pytest.mark.parametrize("name", HISTORIES)
def test_promotions_of_odd_values_and_times_are_those_of_the_sql(spark, duck, tmp_path, name):
    rows = []
    for user, events in enumerate(HISTORIES[name]):
        for hour, (kind, value) in enumerate(events):
            at = None if kind == "late" else f"2024-01-01 {hour:02}:00:00"
            rows.append((len(rows), at, user, "view" if kind == "late" else kind, value))
    schema = "event_id long, t string, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    sql = correlate.ORACLE_SQL["stream_promotions"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.sql(sql).fetchall())
    got = correlate.stream_promotions(spark, str(tmp_path)).select("user_id", "promoted", "event_id").collect()
    assert sorted(map(tuple, got)) == want and len(want) == {"values": 4, "times": 2}[name]


def test_days_begin_where_seconds_are_rounded_to(spark, duck, tmp_path):
    from sluice.plans import estimates

    rows = [("2024-01-30 23:59:59.4", "view", 9.0), ("2024-01-30 23:59:59.7", "purchase", 3.0), ("2024-01-30 12:00:00", "purchase", 1.8)]
    spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("cast(t as timestamp_ntz) as ts", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    sql = estimates.ORACLE_SQL["tonnage_verdicts"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, estimates.tonnage_verdicts(spark, str(tmp_path)).collect()))
    assert got == sorted(duck.sql(sql).fetchall()) and len(got) == 2


def written(path, version):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data/v={version:09d}") for f in names if f.endswith(".parquet"))


def test_an_upsert_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) as v", "0 as at")
    order = [F.desc("at")]
    assert len(sinks.upsert_version(spark, rows, path, 1, ["id"], order, 32)) == 32
    batch = spark.createDataFrame([(5, "new", 1), (6, "old", -1), (30_000, "more", 1)], "id long, v string, at int")
    touched = sinks.upsert_version(spark, batch, path, 2, ["id"], order, 32)
    assert len(touched) <= 3 and written(path, 2) < 0.15 * written(path, 1)

    def table():
        return {r["id"]: r["v"] for r in sinks.latest(spark, path).collect()}

    want = {i: str(i) for i in range(20_000)} | {5: "new", 30_000: "more"}
    assert table() == want
    # repeated, it replaces itself; before its commit it is not there
    assert sinks.upsert_version(spark, batch, path, 2, ["id"], order, 32) == touched and table() == want
    sinks.upsert_version(spark, batch.where("id = 5").withColumns({"at": F.lit(9), "v": F.lit("newest")}), path, 3, ["id"], order, 32)
    os.remove(f"{path}/commits/v={3:09d}/_SUCCESS")
    assert table() == want
    # an empty batch is a commit without data
    assert sinks.upsert_version(spark, batch.where("false"), path, 4, ["id"], order, 32) == [] and table() == want
    assert sinks.drop_unused(spark, path, 1) and table() == want
    assert sinks.latest(spark, str(tmp_path / "none")) is None


def test_work_is_dropped(spark, monkeypatch):
    from sluice.streaming import arrivals

    monkeypatch.setattr(arrivals, "_owned", {})
    folder = arrivals.work_dir(spark, "kept")
    spark.range(3).write.parquet(f"{folder}/out")
    assert arrivals.drop_work(spark) == [folder] and not os.path.exists(folder) and arrivals.drop_work(spark) == []
