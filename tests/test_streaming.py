from conftest import rows
from pyspark.sql import functions as F

from framelake.streaming import edits, intake, ledger


def stream(spark, df, folder, pieces=3):
    df.repartition(pieces).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, spark, folder, mode="append"):
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def test_continuity_holds_across_batches_in_any_order(spark, tmp_path):
    frames = spark.range(40).select(
        F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("idx"), F.col("id").alias("frame_id"),
        (F.col("id") * 50 + F.when(F.col("id") == 7, 3).otherwise(0)).alias("start_ms"), F.lit(50).cast("long").alias("duration_ms"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"),
    )
    found = run(intake.continuity_failures(stream(spark, frames, tmp_path / "in", 5), "30 days"), spark, tmp_path / "q")
    assert rows(found, "idx", "start_ms", "expected_ms") == [(7, 353, 350), (8, 400, 403)]
    assert rows(intake.continuity_failures(frames, "30 days"), "idx") == [(7,), (8,)]


def test_stream_frames_over_several_times_the_lateness(spark, monkeypatch):
    from framelake.plans import intake as plan

    step = 8 * 86_400_000  # eight days a frame: 20 frames are five times the lateness
    line = spark.range(40).select(
        (F.col("id") % 2).alias("clip_id"), F.floor(F.col("id") / 2).alias("idx"), (F.pmod(F.col("id") * 37, F.lit(40)) * 10_000_000).alias("frame_id"),
        (F.floor(F.col("id") / 2) * step + F.when(F.col("id") == 14, 3).otherwise(0)).alias("start_ms"), F.lit(step).cast("long").alias("duration_ms"),
    ).repartition(12, "frame_id")
    monkeypatch.setattr(plan, "stamped", lambda *_: line)
    found = plan.x1(spark, "")
    assert rows(found, "clip_id", "idx", "expected_ms", "code") == [(0, 7, 7 * step, "DISCONTINUOUS"), (0, 8, 8 * step + 3, "DISCONTINUOUS")]


def test_lessons_are_stored_once(spark, tmp_path):
    lessons = spark.range(30).select((F.col("id") % 5).alias("run_id"), F.lit("r").alias("report_sha"), F.lit("c").alias("correction_sha"), (F.col("id") % 2).cast("int").alias("action_index"))
    source = stream(spark, lessons, tmp_path / "in", 4)
    sink = str(tmp_path / "log")
    ledger.append_stream(source, sink, str(tmp_path / "cp"), ledger.LESSON_KEYS).awaitTermination()
    assert spark.read.parquet(sink).count() == 10


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "r", "c", 0), (1, "r", "c", 0)], "run_id long, report_sha string, correction_sha string, action_index int")
    schema = "run_id long, report_sha string, correction_sha string, action_index int, batch int"
    for number in (0, 0, 1):
        ledger.append_batch(batch, number, str(tmp_path / "log"), ledger.LESSON_KEYS, schema)
    assert spark.read.schema(schema).parquet(str(tmp_path / "log")).count() == 1


def test_stale_edits_are_refused(spark, tmp_path):
    log = [(1, 1, "root", "a", "root"), (1, 2, "root", "b", "root"), (1, 3, "a", "c", "root"), (2, 1, "x", "d", "root"), (2, 2, "root", "e", "root")]
    df = spark.createDataFrame(log, "run_id long, seq long, base_sha string, sha256 string, root_sha string")
    source = stream(spark, df, tmp_path / "in", 1)
    got = run(edits.accept_edits(source), spark, tmp_path / "q")
    assert rows(got, "run_id", "seq", "head", "status") == [
        (1, 1, "a", 200), (1, 2, "a", 409), (1, 3, "c", 200), (2, 1, "root", 409), (2, 2, "e", 200)
    ]


def test_an_edit_behind_a_decided_one_is_stale(spark, tmp_path):
    schema = "run_id long, seq long, base_sha string, sha256 string, root_sha string"
    folder = tmp_path / "in"
    spark.createDataFrame([(1, 5, "root", "a", "root")], schema).coalesce(1).write.parquet(str(folder / "x=0"))
    source = spark.readStream.schema(schema + ", x int").option("maxFilesPerTrigger", 1).parquet(str(folder)).drop("x")
    run(edits.accept_edits(source), spark, tmp_path / "q")
    spark.createDataFrame([(1, 3, "a", "b", "root"), (1, 6, "a", "c", "root")], schema).coalesce(1).write.parquet(str(folder / "x=1"))
    source = spark.readStream.schema(schema + ", x int").option("maxFilesPerTrigger", 1).parquet(str(folder)).drop("x")
    got = run(edits.accept_edits(source), spark, tmp_path / "q")
    assert rows(got, "seq", "head", "status") == [(3, "a", 409), (5, "a", 200), (6, "c", 200)]


def batches(spark, parts, schema, folder):
    """A stream that brings ``parts`` one after the other."""
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"x={number}"))
    return spark.readStream.schema(schema + ", x int").option("maxFilesPerTrigger", 1).parquet(str(folder)).drop("x")


def test_edits_of_a_large_batch_are_ordered_in_the_state_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edits, "IN_MEMORY", 7)
    monkeypatch.setattr(edits, "ANSWER", 3)
    log = [(1, n, "root" if n == 0 else f"s{n - 1}", f"s{n}", "root") for n in range(40)]
    log[20] = (1, 20, "old", "s20", "root")
    schema = "run_id long, seq long, base_sha string, sha256 string, root_sha string"
    got = run(edits.accept_edits(batches(spark, [log[::-1]], schema, tmp_path / "in")), spark, tmp_path / "q")
    want = [(n, 200 if n < 20 else 409) for n in range(40)]
    assert sorted(rows(got, "seq", "status")) == want


def test_held_edits_are_put_in_order_and_late_ones_answered(spark, tmp_path):
    schema = "run_id long, seq long, base_sha string, sha256 string, root_sha string, second long"
    parts = [
        [(1, 2, "a", "b", "root", 20), (2, 1, "root", "z", "root", 20)],  # arrives before the edit it is based on
        [(1, 1, "root", "a", "root", 15)],
        [(9, 1, "root", "q", "root", 200)],
        [(1, 3, "b", "c", "root", 30), (9, 2, "q", "r", "root", 400)],  # later than the watermark: answered at once
        [(9, 3, "r", "s", "root", 900)],
    ]
    stream_ = batches(spark, parts, schema, tmp_path / "in").withColumn("ts", F.timestamp_seconds(F.col("second") + 1_700_000_000))
    got = run(edits.accept_edits(stream_, hold="10 seconds"), spark, tmp_path / "q")
    found = rows(got, "run_id", "seq", "head", "status")
    assert [r for r in found if r[0] == 1] == [(1, 1, "a", 200), (1, 2, "b", 200), (1, 3, "c", 200)]
    assert (2, 1, "z", 200) in found and (9, 1, "q", 200) in found
    assert (9, 3, "s", 200) not in found  # still held: its time has not passed


def test_originals_are_forgotten_after_their_time(spark, tmp_path):
    schema = "clip_id long, idx long, frame_id long, sha256 string, second long"
    parts = [[(1, 0, 10, "a", 0), (1, 1, 11, "a", 1), (1, 2, 12, "b", 2)], [(2, 0, 20, "a", 100)], [(2, 1, 21, "c", 101)], [(1, 3, 13, "a", 102)]]
    for number, (expire, kept) in enumerate(((None, (10, 3)), ("10 seconds", (13, 1)))):
        stream_ = batches(spark, parts, schema, tmp_path / f"in{number}").withColumn("ts", F.timestamp_seconds(F.col("second") + 1_700_000_000))
        seen = []
        keep = lambda batch, n: seen.extend((n, *r) for r in rows(batch, "clip_id", "sha256", "original", "copies"))  # noqa: E731, B023
        query = intake.pixel_originals(stream_, expire).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"cp{number}")).trigger(availableNow=True).start()
        query.awaitTermination()
        last = {(c, s): (o, n) for _, c, s, o, n in sorted(seen)}
        assert last == {(1, "a"): kept, (1, "b"): (12, 1), (2, "a"): (20, 1), (2, "c"): (21, 1)}


def test_many_hashes_are_kept_by_a_streaming_aggregation(spark, tmp_path):
    schema = "clip_id long, idx long, frame_id long, sha256 string"
    # Two batches; the second brings an earlier frame of every third hash.
    parts = [[(n % 7, n + 10, n, str(n)) for n in range(3000)], [(n % 7, 5 - n % 2, n + 9000, str(n)) for n in range(0, 3000, 3)]]
    kept = {}
    keep = lambda batch, n: kept.update({(r.clip_id, r.sha256): (r.original, r.copies) for r in batch.collect()})
    stream_ = intake.pixel_originals(batches(spark, parts, schema, tmp_path / "in"))
    query = stream_.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert kept == {(n % 7, str(n)): (n + 9000, 2) if n % 3 == 0 else (n, 1) for n in range(3000)}
    # No call of Python per hash: these took 2 ms each.
    assert {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]} == {"stateStoreSave"}


def test_a_frame_whose_predecessor_never_comes_is_reported(spark, tmp_path):
    schema = "clip_id long, idx long, frame_id long, start_ms long, duration_ms long, second long"
    frame = lambda i, second: (1, i, i, i * 50, 50, second)
    whole = [frame(0, 0), frame(1, 1), frame(3, 3), frame(4, 4)]
    later = [frame(5, 5), (2, 0, 9, 0, 50, 10_000)]
    typed = lambda rows_: spark.createDataFrame(rows_, schema).withColumn("ts", F.timestamp_seconds(F.col("second") + 1_700_000_000)).drop("second")
    want = [(3, None, "PREDECESSOR_MISSING")]
    assert rows(intake.continuity_failures(typed(whole + later), "1 minute"), "idx", "expected_ms", "code") == want
    folder = tmp_path / "in"
    typed(whole).coalesce(1).write.parquet(str(folder / "part=0"))
    typed(later).coalesce(1).write.parquet(str(folder / "part=1"))
    source = spark.readStream.schema(typed(whole).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    found = run(intake.continuity_failures(source, "1 minute"), spark, tmp_path / "q")
    assert rows(found, "idx", "expected_ms", "code") == want
