from quantafold.streaming.events import follow, latest_status, session_counts, track, track_frame, upsert_batches, windowed_counts

SCHEMA = "ts timestamp, who string"


def stream_of(spark, tmp_path, rows, schema):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(folder)
    return df, follow(spark, folder, df.schema)


def drain(stream, tmp_path, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()


def test_windows_are_those_of_the_table(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(datetime(2024, 1, 1) + timedelta(minutes=7 * i), "ab"[i % 2]) for i in range(60)]
    table, stream = stream_of(spark, tmp_path, rows, SCHEMA)
    for name, make in {"tumbling": lambda d: windowed_counts(d, "ts", "1 hour", ["who"], "10 minutes"), "sliding": lambda d: windowed_counts(d, "ts", "1 hour", ["who"], "10 minutes", "30 minutes")}.items():
        drain(make(stream), tmp_path, name, "complete")
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(table).collect()))
    assert session_counts(table, "ts", "20 minutes", ["who"], "1 hour").count() == 2


def test_incremental_upsert(spark, tmp_path):
    from datetime import datetime

    _, stream = stream_of(spark, tmp_path, [(datetime(2024, 1, 1), "a"), (datetime(2024, 1, 2), "b")], SCHEMA)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        upsert_batches(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 2
    status = spark.createDataFrame([("d", "completed", 3), ("d", "processing", 2), ("e", "uploaded", 1)], "doc string, status string, at int")
    assert {r.doc: r.status for r in latest_status(status, "doc", "status", "at").collect()} == {"d": "completed", "e": "uploaded"}


def test_tracker_keeps_ids_and_lets_go(spark, tmp_path):
    state, out = track_frame({}, 0, [(0, [101, 101, 200, 200]), (1, [301, 301, 450, 450])])
    assert out == [(0, 0), (1, 1)]
    state, out = track_frame(state, 1, [(0, [302, 303, 451, 452]), (1, [101, 102, 201, 203])])
    assert sorted(out) == [(0, 1), (1, 0)]
    state, out = track_frame(state, 9, [(0, [101, 102, 201, 203])], most_lost=2)
    assert out == [(0, 0)] and set(state["tracks"]) == {0}
    rows = [(1, f, b, *map(float, x)) for f, b, x in [(0, 0, (101, 101, 200, 200)), (0, 1, (301, 301, 450, 450)), (1, 0, (302, 303, 451, 452)), (1, 1, (101, 102, 201, 203))]]
    _, stream = stream_of(spark, tmp_path, rows, "video bigint, frame bigint, box_id bigint, x0 double, y0 double, x1 double, y1 double")
    drain(track(stream), tmp_path, "tracks")
    assert sorted(tuple(r)[1:] for r in spark.table("tracks").collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]
