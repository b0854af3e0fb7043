import time

import pytest
from pyspark.sql import functions as F

from facetlake.streaming.batcher import batched_requests
from facetlake.streaming.reoptimise import LabelVersions, counter_updates, reoptimise, watch

FACES = "library string, face long"


def add(spark, path, library, first, n):
    spark.range(first, first + n).select(F.lit(library).cast("string").alias("library"), F.col("id").alias("face")).write.mode("append").parquet(path)


def by_remainder(faces):
    """Two clusters by the parity of ids, and noise."""
    return faces.select("face", F.when(F.col("face") % 100 == 99, -1).otherwise(F.col("face") % 2).cast("int").alias("label"))


def test_5000_new_faces_set_off_one_rebuild_also_after_a_restart(spark, tmp_path):
    versions = LabelVersions(spark, f"{tmp_path}/labels", "face", "long")
    called, broken = [], []

    def rebuild(library, stamp):
        called.append((library, stamp))
        reoptimise(versions, spark.read.schema(FACES).parquet(f"{tmp_path}/in").where(F.col("library") == library), by_remainder, stamp)
        if broken:
            raise RuntimeError("lost after the version was written")

    def run():
        stream = spark.readStream.schema(FACES).parquet(f"{tmp_path}/in")
        q = watch(stream, "library", rebuild, f"{tmp_path}/ck")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    add(spark, f"{tmp_path}/in", "a", 0, 4990)
    add(spark, f"{tmp_path}/in", "b", 0, 50)
    add(spark, f"{tmp_path}/in", None, 0, 1)
    run()
    assert called == [] and versions.version().count() == 0
    add(spark, f"{tmp_path}/in", "a", 4990, 10)
    broken.append(True)
    with pytest.raises(Exception, match="lost after"):
        run()
    broken.clear()
    run()
    # The micro-batch was done twice with one stamp, and made one version.
    assert [c[0] for c in called] == ["a", "a"] and len(set(called)) == 1
    assert [tuple(r) for r in versions.entries.select("number", "faces", "common", "changed", "new_clusters").collect()] == [(1, 5000, 0, 0, 52)]
    add(spark, f"{tmp_path}/in", "a", 5000, 4999)
    run()
    assert len(called) == 2
    add(spark, f"{tmp_path}/in", "a", 9999, 12_001)
    run()
    assert [c[0] for c in called] == ["a"] * 3
    last = versions.entries.orderBy(F.desc("number")).first()
    assert (last["number"], last["faces"], last["common"], last["changed"]) == (2, 22_000, 5000, 0)
    assert versions.version(1).count() == 5000 and versions.version().count() == 22_000


def test_versions_tell_the_drift_and_readers_see_whole_ones(spark, tmp_path):
    versions = LabelVersions(spark, f"{tmp_path}/v", "face", "long")
    with pytest.raises(KeyError):
        versions.version(1)
    names = lambda *rows: spark.createDataFrame(list(rows), "face long, name string, extra int")
    assert versions.publish(names((1, "a", 0), (2, "a", 0), (3, "b", 0), (4, None, 0))) == 1
    # A write that stopped before its entry leaves the last version as it was.
    names((9, "z", 0)).write.parquet(f"{tmp_path}/v/labels-2-lost")
    assert versions.version().count() == 4
    assert versions.publish(names((1, "a", 0), (2, "b", 0), (3, "c", 0), (5, "d", 0)), "s") == 2
    assert versions.publish(names((7, "x", 0)), "s") == 2
    entry = versions.entries.where("number = 2").first()
    assert (entry["common"], entry["changed"], entry["drift"], entry["new_clusters"], entry["faces"]) == (3, 2, 0.666667, 2, 4)
    assert versions.publish(names((1, "q", 0)), before=names((1, "q", 0))) == 3
    assert versions.entries.where("number = 3").first()["drift"] == 0.0
    assert LabelVersions(spark, f"{tmp_path}/v", "face", "long").version().collect()[0]["name"] == "q"


def test_counters_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], FACES).write.parquet(f"{tmp_path}/in")
    q = counter_updates(spark.readStream.schema(FACES).parquet(f"{tmp_path}/in"), "library").writeStream.outputMode("update").format("memory").queryName("none").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("none").count() == 0


def test_requests_go_full_urgent_or_after_a_while_also_after_a_restart(spark, tmp_path):
    schema, seen = "worker int, id string, urgent boolean", []

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def started(wait_ms):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        made = batched_requests(stream, "worker", "id", "urgent", 16, wait_ms)
        keep = lambda batch, epoch: seen.extend(tuple(r) for r in batch.collect())
        return made.writeStream.outputMode("append").foreachBatch(keep).trigger(processingTime="100 milliseconds").option("checkpointLocation", f"{tmp_path}/ck").start()

    def until(n):
        end = time.time() + 60
        while len(seen) < n and time.time() < end:
            time.sleep(0.1)

    def groups(worker):
        found = {}
        for _, batch, place, rid, reason in sorted(s for s in seen if s[0] == worker):
            assert place == len(found.setdefault((batch, reason), []))
            found[batch, reason].append(rid)
        return found

    low = [(1, f"l{i:02}", False) for i in range(35)]
    put(*low, (2, "u", True), (2, "m", None), (2, "k", False))
    q = started(600_000)
    until(35)
    q.stop()
    # Two full batches; an urgent request takes the others along; three wait.
    assert groups(1) == {(0, "full"): [f"l{i:02}" for i in range(16)], (1, "full"): [f"l{i:02}" for i in range(16, 32)]}
    assert groups(2) == {(0, "urgent"): ["u", "k", "m"]}
    put(*[(1, f"u{i:02}", True) for i in range(20)])
    q = started(1500)
    until(58)
    assert groups(1)[2, "full"] == [f"u{i:02}" for i in range(16)]
    assert groups(1)[3, "urgent"] == ["u16", "u17", "u18", "u19", "l32", "l33", "l34"]
    put((1, "w1", False), (1, "w0", False), (2, "w2", None))
    while not any(s[3] == "w2" for s in seen) and q.isActive and not q.lastProgress["numInputRows"]:
        time.sleep(0.05)
    q.stop()
    q = started(1500)
    until(61)
    q.stop()
    # What waited when the query stopped goes when its timer ends.
    assert groups(1)[4, "waited"] == ["w0", "w1"] and groups(2)[1, "waited"] == ["w2"]
    assert len(seen) == 61
