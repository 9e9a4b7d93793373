import json

from pyspark.sql import functions as F

from eventloom.operators import windows as w
from eventloom.plans.surrogate import DELTA, KEYS, dispatches
from eventloom.streaming.windows import window_counts_stream, window_pairs_in_event_time, window_pairs_stream

DIR = "/root/testdata/sf0.001"


def test_pairs_equal_the_batch(spark, tmp_path):
    events = dispatches(spark, DIR).select(*KEYS, "class", "t_us").cache()
    cuts = events.selectExpr("percentile_approx(t_us, array(0.3, 0.6), 10000) q").first().q
    for k, where in enumerate((f"t_us < {cuts[0]}", f"t_us >= {cuts[0]} and t_us < {cuts[1]}", f"t_us >= {cuts[1]}")):
        events.where(where).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = window_pairs_stream(stream, KEYS, "class", DELTA).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("pairs").collect()
    pairs = w.window_pairs(w.share_vectors(w.window_counts(events, KEYS, "class", DELTA), KEYS, "class"), KEYS)
    last = pairs.groupBy(*KEYS).agg(F.max("win").alias("last"))
    # a group's last window is still open in the stream
    closed = pairs.join(last, KEYS).where("win < last")
    changes, inversions = ({(r.callsite_id, r.compile_id, r.prev_win, r.win) for r in f(closed).collect()} for f in (w.share_changes, w.rank_inversions))
    assert len(got) == closed.count() > 50
    assert {(r.callsite_id, r.compile_id, r.prev_win, r.win) for r in got if r.changed} == changes
    assert {(r.callsite_id, r.compile_id, r.prev_win, r.win) for r in got if r.inverted} == inversions
    assert abs(sum(json.loads(got[0].shares).values()) - 1) < 1e-9 and all(r.late == 0 for r in got)


def test_counts_equal_the_batch(spark, tmp_path):
    events = dispatches(spark, DIR).withColumn("ts", F.timestamp_micros("t_us"))
    events.write.parquet(str(tmp_path / "in"))
    anchors = w.anchors(events, KEYS)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = window_counts_stream(stream, anchors, KEYS, "class", DELTA).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    columns = [*KEYS, "win", "class", "n"]
    assert sorted(map(tuple, spark.table("counts").select(*columns).collect())) == sorted(map(tuple, w.window_counts(events, KEYS, "class", DELTA).select(*columns).collect()))


def test_events_out_of_order_equal_the_batch(spark, tmp_path):
    """An older event than the first one seen moves the anchor, and last windows come out."""
    import random

    rnd, second = random.Random(5), 1_000_000
    rows = [(g, 1, rnd.choice("abc"), g * 7 + rnd.randint(0, 400) * second + 3) for g in range(6) for _ in range(300)]
    schema = "callsite_id long, compile_id long, class string, t_us long"
    events = spark.createDataFrame(rows, schema)
    dealt = [[], [], [], [], [(99, 1, "a", 10_000 * second)]]
    for r in rows:  # at most 60 seconds behind
        dealt[min(3, (r[3] + rnd.randint(0, 60) * second) // (115 * second))].append(r)
    for part in dealt:
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema.add("ts", "timestamp")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pairs = window_pairs_in_event_time(stream, KEYS, "class", 20 * second, delay="61 seconds")
    pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema(pairs.schema).parquet(str(tmp_path / "out")).collect()
    batch = w.window_pairs(w.share_vectors(w.window_counts(events, KEYS, "class", 20 * second), KEYS, "class"), KEYS)
    assert {(r.callsite_id, r.prev_win, r.win) for r in got} == {(r.callsite_id, r.prev_win, r.win) for r in batch.collect()} and len(got) > 100
    for name, f in (("changed", w.share_changes), ("inverted", w.rank_inversions)):
        assert {(r.callsite_id, r.win) for r in got if r[name]} == {(r.callsite_id, r.win) for r in f(batch).collect()}


def test_many_groups_in_one_row_of_state(spark, tmp_path):
    """Groups that share a row of state, one of them without a key, have the pairs that they have in a batch, and Python is called once a bucket."""
    second = 1_000_000
    rows = [(g or None, 1, "abc"[(g + k * k) % 3], g * 7 + k * 3 * second) for g in range(40) for k in range(60)]
    schema = "callsite_id long, compile_id long, class string, t_us long"
    events = spark.createDataFrame(rows, schema)
    for part in (events.where(f"t_us < {90 * second}"), events.where(f"t_us >= {90 * second}"), spark.createDataFrame([(99, 1, "a", 10_000 * second)], schema)):
        part.withColumn("ts", F.timestamp_micros("t_us")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
        pairs = window_pairs_in_event_time(stream, KEYS, "class", 20 * second, delay="61 seconds", buckets=3)
        query = pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    got = spark.read.schema(pairs.schema).parquet(str(tmp_path / "out")).collect()
    known = events.fillna({"callsite_id": -5})  # a batch joins groups by their keys
    batch = w.window_pairs(w.share_vectors(w.window_counts(known, KEYS, "class", 20 * second), KEYS, "class"), KEYS)
    want = {(r.callsite_id, r.prev_win, r.win) for r in batch.collect()}
    assert {(-5 if r.callsite_id is None else r.callsite_id, r.prev_win, r.win) for r in got} == want and len(got) == len(want) > 100
