"""The reorder stream releases what a batch over all arrivals would, and each frame once."""

import random

from pixelweave.streaming import ready_frames, remaining, reorder


def test_frames_are_released_once_their_neighbours_are_there(spark, tmp_path):
    order = list(range(12))
    random.Random(3).shuffle(order)
    parts = [order[:4], order[4:8], order[8:] + order[:2]]
    for n, part in enumerate(parts):
        spark.createDataFrame([("s", i) for i in part], "sequence string, frame_idx int").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("sequence string, frame_idx int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = ready_frames(stream).writeStream.format("memory").queryName("released").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    released = spark.table("released")
    assert sorted(r.frame_idx for r in released.collect()) == list(range(10))
    arrived = spark.createDataFrame([("s", i) for i in order], "sequence string, frame_idx int")
    assert sorted(r.frame_idx for r in remaining(arrived, released).collect()) == [10, 11]


def plain_reorder(total):
    """The actions over a whole sequence, one frame after the other."""
    out = []
    for i in range(total):
        out.append((i, "linked"))
        if i - 3 >= 0 and i < total - 3:
            out.append((i - 3, "finished"))
    left = set(range(total)) - {i for i, a in out if a == "finished"}
    return out + [(i, "finished") for i in sorted(left)]


def test_frames_are_linked_and_finished_in_order_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, names = "sequence string, frame_idx int, n_frames int", {"a": 9, "b": 7, "c": 3, "d": 8}
    rows = [(s, i, n if s != "d" else None) for s, n in names.items() for i in range(n)]
    random.Random(5).shuffle(rows)
    rows += [("a", None, 9), *rows[:6]]
    parts = [rows[:9], rows[9:20], rows[20:]]

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = reorder(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for n, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            run(n)  # each part by a query of its own, from the checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        found.setdefault(r.sequence, []).append((r.frame_idx, r.action))
    for s, n in names.items():
        expected = plain_reorder(n) if s != "d" else [(i, "linked") for i in range(6)] + [(i, "finished") for i in range(3)]
        assert sorted(found[s]) == sorted(expected)
