"""Runs that are killed between writing and publishing, and streams over leaves."""

import json

import pytest
from pyspark.sql import functions as F

from querent.functions.text import canonical_answers
from querent.streaming.commits import CommitLog
from querent.streaming.leaves import bad_leaves, follow_leaves


class Stopped(Exception):
    pass


def doubled(df):
    return df.select("_part", "id", (F.col("id") * 2).alias("twice"))


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    df = spark.range(200).unionByName(spark.createDataFrame([(None,), (7,)], "id long"))
    folder = f"file://{tmp_path}/log"
    log = CommitLog(spark, folder, parts=8)
    publish = CommitLog.publish
    calls = []

    def stop_at_the_second(self, attempt, parts):
        calls.append(parts)
        if len(calls) == 2:
            publish(self, attempt, parts[:1])  # one part of this attempt is out, the others are only written
            raise Stopped
        return publish(self, attempt, parts)

    monkeypatch.setattr(CommitLog, "publish", stop_at_the_second)
    with pytest.raises(Stopped):
        log.run(df, "id", doubled, at_once=3)
    monkeypatch.setattr(CommitLog, "publish", publish)
    half = CommitLog(spark, folder)
    assert half.parts == 8 and sorted(half.attempts()) == [0, 1, 2, 3]
    seen = [r["id"] for r in half.results("id long, twice long").collect()]
    assert 0 < len(seen) < 202 and len(set(seen) - {7}) == len([i for i in seen if i != 7])
    worked = []

    def noted(df_):
        worked.append(sorted(r[0] for r in df_.select("_part").distinct().collect()))
        return doubled(df_)

    assert half.run(df, "id", noted, at_once=3) == [4, 5, 6, 7]
    assert all(p >= 4 for parts in worked for p in parts)
    got = half.results("id long, twice long").collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["twice"] or 0) for r in got) == sorted([*((False, i, 2 * i) for i in range(200)), (False, 7, 14), (True, 0, 0)])
    assert half.run(df, "id", noted) == []  # nothing is left
    assert half.sweep() == 0


def test_one_attempt_wins(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", parts=2)
    df = spark.range(10).withColumn("_part", F.lit(1))
    first, second = log.write(df, [1], doubled), log.write(df, [1], doubled)
    assert log.publish(second, [1]) == [1] and log.publish(first, [1]) == []
    assert log.results("id long, twice long").count() == 10
    assert log.sweep() == 1 and log.results("id long, twice long").count() == 10


def test_a_file_is_created_once(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, f"file://{tmp_path}/log", parts=2)
    assert log._create("log/x", "one") and not log._create("log/x", "two") and log._read("log/x") == "one"
    # another writer comes between the look and the rename
    blind = type("Store", (), {"__getattr__": lambda self, name: getattr(real, name), "exists": lambda self, where: False})()
    real = log._store("log")
    monkeypatch.setattr(log, "_store", lambda name: blind)
    assert not log._create("log/x", "three") and log._read("log/x") == "one"


def test_an_empty_log(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log", parts=3)
    assert log.results("id long, twice long").count() == 0
    assert log.run(spark.range(0), "id", doubled) == [0, 1, 2]
    assert log.results("id long, twice long").count() == 0


def put(folder, rows):
    folder.mkdir(parents=True)
    (folder / "predictions.json").write_text(rows if isinstance(rows, str) else json.dumps(rows))


def test_leaves_are_read_once_and_late_ones_are_taken_up(spark, tmp_path):
    root, out = tmp_path / "runs", f"file://{tmp_path}/out"
    put(root / "a" / "x", [{"questionId": "1", "predicted_answer": "12"}, {"questionId": "2", "predicted_answer": "I cannot tell"}])
    put(root / "b", "not json at all")
    batches = []

    def steps(df):
        if not df.isStreaming:
            batches.append(sorted(r["leaf"].rsplit("/", 1)[-1] for r in df.select("leaf").distinct().collect()))
        return canonical_answers(df, "predicted_answer")

    def read():
        batches.clear()
        return follow_leaves(spark, f"file://{root}", out, steps)

    first = read()
    assert batches == [["b", "x"], []]  # the second is the empty table that gives the schema
    assert first.where("ord is not null").count() == 2
    assert [r["leaf"].rsplit("/", 1)[-1] for r in bad_leaves(first).collect()] == ["b"]
    read()
    assert batches == [[]]  # nothing is read again
    put(root / "c", [{"questionId": "3", "predicted_answer": "Paris"}])
    late = read()
    assert batches == [["c"], []]  # the new leaf is the only work
    assert sorted(r["questionId"] for r in late.where("ord is not null").collect()) == ["1", "2", "3"]


def test_no_leaves(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    assert follow_leaves(spark, f"file://{tmp_path}/runs", f"file://{tmp_path}/out", lambda df: df).count() == 0
