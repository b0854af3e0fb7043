import datetime as dt

from facetlake.streaming.online import assign_stream, prototype_updates, session_events, threshold_updates

DAY = dt.datetime(2024, 6, 15, 9)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, i, DAY + dt.timedelta(hours=h)) for i, h in enumerate((0, 1, 9, 10, 11, 200))]
    df = spark.createDataFrame(rows, "user int, photo int, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = session_events(stream, "user", "ts").writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.photo_count for r in spark.table("sessions").collect()) == [2, 3]


def test_prototypes_of_a_stream(spark, tmp_path):
    rows = [(1, 0, [1.0, 0.0], 1.0, True), (1, 1, [0.0, 1.0], 1.0, True), (2, 2, [1.0, 0.0], 1.0, True), (2, 3, [1.0, 0.0], 1.0, False)]
    df = spark.createDataFrame(rows, "cluster int, seq long, embedding array<double>, weight double, is_addition boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = prototype_updates(stream).writeStream.outputMode("update").format("memory").queryName("prototypes").start()
    q.processAllAvailable()
    q.stop()
    got = {r.cluster: r for r in spark.table("prototypes").collect()}
    assert got[1].member_count == 2 and abs(got[1].centroid[0] - 0.5**0.5) < 1e-9
    assert got[2].member_count == 0 and got[2].centroid is None


def test_batches_are_handed_over(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    q = assign_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), lambda batch, epoch: seen.append(batch.count()), f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 2


def test_thresholds_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    schema, seen = "owner int, seq long, action string", {}

    def keep(batch, epoch):
        seen.update({r.owner: (round(r.threshold, 6), r.merges, r.splits) for r in batch.collect()})

    def run():
        stream = threshold_updates(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "owner")
        q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").start()
        q.processAllAvailable()
        q.stop()

    first = [(1, i, "split") for i in range(20)] + [(2, 0, "none"), (2, 1, None)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert seen == {1: (0.95, 0, 20), 2: (0.7, 0, 0)}
    spark.createDataFrame([(1, 21, "merge"), (1, 20, "split"), (3, 0, "merge")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert seen == {1: (0.93, 1, 21), 2: (0.7, 0, 0), 3: (0.68, 1, 0)}
