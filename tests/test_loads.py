"""Timed state, loads that are run twice or broken off, upserts and swaps."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from siteloom.operators.dedupe import insert_absent, upsert
from siteloom.sources import writers
from siteloom.streaming import caches, loads

REQUESTS = "key string, request_id long, t long, payload string"


def test_answers_are_fresh_stale_and_gone(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", caches.STORE)
    try:
        # Minutes: fresh for 30, gone after 120. Each list is a file, read one at a time, so the clock moves between them.
        steps = [
            [("a", 1, 0, "one"), ("b", 2, 5, None), ("c", 3, 6, "see"), ("d", 16, 1, "dee")],
            [("a", 4, 29, "two"), ("a", 5, 30, None), ("a", 6, 40, "three"), ("c", 7, 36, None)],
            [("a", 8, 69, None), ("a", 9, 71, None), ("z", 10, 130, "later")],
            [("c", 11, 131, None), ("a", 12, 165, None), ("z", 13, 400, None)],
            [("z", 14, 900, "end"), ("z", 15, 901, None)],
        ]
        folder = str(tmp_path / "in")
        for n, rows in enumerate(steps):
            spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/*").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t") * 60))
        query = caches.answered(stream, 30 * 60, 120 * 60).writeStream.outputMode("update").format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {(r["key"], r["request_id"]): (r["status"], r["payload"]) for r in spark.table("answers").where("status <> 'gone'").collect()}
        assert got == {
            ("a", 1): ("fetched", "one"), ("b", 2): ("missing", None), ("c", 3): ("fetched", "see"), ("d", 16): ("fetched", "dee"), ("a", 4): ("fresh", "one"), ("a", 5): ("stale", "one"), ("a", 6): ("fetched", "three"), ("c", 7): ("stale", "see"),
            ("a", 8): ("fresh", "three"), ("a", 9): ("stale", "three"), ("z", 10): ("fetched", "later"), ("c", 11): ("missing", None), ("a", 12): ("missing", None), ("z", 13): ("missing", None), ("z", 14): ("fetched", "end"), ("z", 15): ("fresh", "end"),
        }
        gone = {r["key"]: (r["at_ms"] // 1000 - 1_700_000_000) // 60 for r in spark.table("answers").where("status = 'gone'").collect()}
        assert gone == {"d": 121}  # the timer dropped what nobody asked for again; the others' went when they were asked for
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


CHANGES = "k long, v string, seq long"
BATCHES = [[(1, "a", 1), (2, "b", 1), (2, "b2", 2), (None, "n", 1)], [(2, "c", 1), (3, "d", 1)], [(1, "e", 9), (None, "m", 1), (None, "l", 0)]]
WANT = {(1, "e"), (2, "c"), (3, "d"), (None, "m")}


def feed(spark, folder):
    for n, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{n}")
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows_of(spark, path):
    return Counter((r["k"], r["v"]) for r in loads.current(spark, path, ["k"]).collect())


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (0, 1, 1, 0, 2, 2):
        loads.put(spark.createDataFrame(BATCHES[n], CHANGES), n, path, ["k"], ["seq"])
    assert rows_of(spark, path) == Counter(WANT)
    loads.compact(spark, path, ["k"])
    assert rows_of(spark, path) == Counter(WANT) and [n for n, _ in loads._folders(spark, path)] == [2]
    loads.put(spark.createDataFrame(BATCHES[1], CHANGES), 1, path, ["k"], ["seq"])  # a late repeat of what is folded in
    loads.put(spark.createDataFrame([(7, "g", 1)], CHANGES), 3, path, ["k"], ["seq"])
    assert rows_of(spark, path) == Counter(WANT | {(7, "g")})


def test_a_load_broken_off_between_write_and_commit_is_as_one_run(spark, tmp_path):
    stream, path, checkpoint = feed(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    seen = []

    def die(_, number):
        seen.append(number)
        if number == 1 and seen.count(1) == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        loads.load(stream, path, checkpoint, ["k"], ["seq"], die).awaitTermination()
    loads.load(stream, path, checkpoint, ["k"], ["seq"], die).awaitTermination()
    assert seen == [0, 1, 1, 2] and rows_of(spark, path) == Counter(WANT)
    loads.load(stream, path, checkpoint, ["k"], ["seq"], die).awaitTermination()  # nothing new
    assert seen == [0, 1, 1, 2] and rows_of(spark, path) == Counter(WANT)


def test_what_was_half_written_is_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    loads.put(spark.createDataFrame(BATCHES[0], CHANGES), 0, path, ["k"], ["seq"])
    loads.put(spark.createDataFrame(BATCHES[1], CHANGES), 1, path, ["k"], ["seq"])
    (tmp_path / "table" / "batch-1" / "_SUCCESS").unlink()
    assert rows_of(spark, path) == Counter({(1, "a"): 1, (2, "b2"): 1, (None, "n"): 1})


def test_upserts_keep_one_row_a_key(spark):
    current = spark.createDataFrame([(1, "x", 0), (None, "y", 0)], CHANGES)
    changes = spark.createDataFrame([(2, "p", 1), (2, "q", 2), (None, "z", 1), (None, "w", 2), (1, "r", 5), (1, "s", 5)], CHANGES)
    assert {(r["k"], r["v"]) for r in upsert(current, changes, ["k"], ["seq"]).collect()} == {(1, "s"), (2, "q"), (None, "w")}
    assert upsert(current, changes, ["k"], ["seq"]).count() == 3
    absent = insert_absent(current, changes, ["k"], ["seq"])
    assert Counter((r["k"], r["v"]) for r in absent.collect()) == Counter({(1, "x"): 1, (None, "y"): 1, (2, "q"): 1})


def test_a_swap_that_fails_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    writers.replace_all(spark.createDataFrame([(1,)], "k long"), path)
    real = writers._move
    monkeypatch.setattr(writers, "_move", lambda fs, a, b: real(fs, a, b) if not a.toString().endswith(".new") else (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError, match="no"):
        writers.replace_all(spark.createDataFrame([(2,)], "k long"), path)
    assert [r["k"] for r in spark.read.parquet(path).collect()] == [1]
    monkeypatch.undo()
    (tmp_path / "t").rename(tmp_path / "t.old")  # broken off between the two moves
    writers.upsert_table(spark.createDataFrame([(3,)], "k long"), path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 3] and not (tmp_path / "t.old").exists()

    class Sleepy:
        def rename(self, a, b):
            return False

    with pytest.raises(OSError, match="could not be renamed"):
        real(Sleepy(), "a", "b")
