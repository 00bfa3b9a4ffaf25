"""Append-once logs with racing and dying writers; keyed state over several batches."""
import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.sources import append_log as al
from lodestone.streaming import keyed, logs


def ids(spark, at):
    return sorted(r.alert_id for r in al.read_log(spark, at, "alert_id string, n long").collect())


def rows(spark, names):
    return spark.createDataFrame([(x, i) for i, x in enumerate(names)], "alert_id string, n long")


def test_a_batch_is_appended_once(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    assert ids(spark, at) == []
    assert al.append_batch(rows(spark, ["a", "b"]), at, "1") and not al.append_batch(rows(spark, ["a", "b"]), at, "1")
    assert al.append_batch(rows(spark, ["b", "b", "c"]), at, "2", "alert_id")
    assert al.append_batch(rows(spark, []), at, "3", "alert_id")
    assert ids(spark, at) == ["a", "b", "c"] and [c["batch"] for c in al.commits(spark, at)] == ["1", "2", "3"]


def test_racing_writers_append_nothing_twice(spark, tmp_path):
    at, done = f"file://{tmp_path}/log", []
    jobs = [("same", ["a", "b"], None), ("same", ["a", "b"], None), ("x", ["b", "c"], "alert_id"), ("y", ["c", "d"], "alert_id"), ("z", ["d", "e"], "alert_id")]
    made = [(rows(spark, names), batch, key) for batch, names, key in jobs]
    start = threading.Barrier(len(made))

    def work(df, batch, key):
        start.wait()
        done.append((batch, al.append_batch(df, at, batch, key)))

    threads = [threading.Thread(target=work, args=j) for j in made]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(b for b, ok in done if ok) == ["same", "x", "y", "z"]
    # the batch without a key may hold what another one holds; those with a key hold nothing that came before them
    found = ids(spark, at)
    assert set(found) == set("abcde") and found.count("c") == found.count("d") == found.count("e") == 1
    names = sorted(p.name for p in (tmp_path / "log/_commits").iterdir() if not p.name.startswith("."))
    assert names == [f"{k:012}.json" for k in range(4)]
    assert len(list((tmp_path / "log/data").iterdir())) == 4


def test_a_writer_that_dies_before_its_commit(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/log"
    al.append_batch(rows(spark, ["a"]), at, "1")
    put = al.put_new

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(al, "put_new", die)
    with pytest.raises(OSError, match="gone"):
        al.append_batch(rows(spark, ["b"]), at, "2")
    assert ids(spark, at) == ["a"]
    monkeypatch.setattr(al, "put_new", put)
    assert al.append_batch(rows(spark, ["b"]), at, "2") and ids(spark, at) == ["a", "b"]


def test_a_file_is_put_in_place_once(spark, tmp_path):
    assert al.put_new(spark, f"file://{tmp_path}/c/0.json", "one") and not al.put_new(spark, f"file://{tmp_path}/c/0.json", "two")
    assert (tmp_path / "c/0.json").read_text() == "one"


T0 = dt.datetime(2024, 1, 1)
EVENTS = "user_id long, event_id long, ts timestamp, props string"


def stream(spark, tmp_path, batches):
    """A stream that reads one file a batch, in the order of their names."""
    for k, part in enumerate(batches):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def test_keys_are_known_after_days_and_restarts(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[(1, 1, at(0), "a"), (1, 2, at(1), "b")], [(2, 3, at(30), "c")], [(1, 4, at(100), "late"), (None, 5, at(101), "n")], [(None, 6, at(300), "n"), (3, 7, at(299), "d"), (3, 8, at(298), "e")]]
    for n in (2, 4):  # the second run goes on from the first one's checkpoint
        src = stream(spark, tmp_path, batches[n - 2 : n]) if n == 2 else None
        if n == 4:
            for k, part in enumerate(batches[2:], 2):
                spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{k:03}")
            src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        with keyed.disk_state(spark):
            logs.drain(keyed.first_of_key(src, ["user_id"], ["ts", "event_id"]), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = sorted((r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [1, 3, 5, 8]


def test_changes_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    r = random.Random(3)
    events = [(r.randrange(4), i, T0 + dt.timedelta(minutes=10 * i), r.choice(["x1", "x11", "y", None])) for i in range(200)]
    last = events[-1][2]
    shuffled = sorted(events, key=lambda e: e[1] + r.random() * 5)  # up to 50 minutes out of order
    batches = [shuffled[k : k + 25] for k in range(0, 200, 25)]
    with keyed.disk_state(spark):
        out = keyed.changes(stream(spark, tmp_path, batches), "user_id", "ts", "event_id", "props", {"ones": F.coalesce(F.regexp_count("props", F.lit("1")), F.lit(0))}, "1 hour")
        logs.drain(out, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    want, before = [], {}
    for u, i, ts, p in events:
        if u in before and ts < last - dt.timedelta(hours=1):
            _, pi, pts, pp = before[u]
            want.append((u, i, pts, (p or "") != (pp or ""), (p or "").count("1") - (pp or "").count("1")))
        before[u] = (u, i, ts, p)
    got = sorted((x.user_id, x.event_id, x.previous, x.text_changed, x.delta_ones) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(want) and len(got) > 150


def test_state_is_kept_for_many_keys_at_once(spark, tmp_path):
    """A call of Python for each key took most of the time of streams of many keys."""
    at = lambda k: T0 + dt.timedelta(seconds=k)
    src = stream(spark, tmp_path, [[(k % 300, k, at(k), "x") for k in range(900)], [(k % 300 if k % 2 else None, k, at(k), "y") for k in range(9000, 9600)]])
    first = keyed.first_of_key(src, ["event_id"], ["ts"], buckets=8)
    assert "TransformWithState" not in first._jdf.queryExecution().analyzed().toString()
    with keyed.disk_state(spark):
        logs.drain(keyed.first_of_key(src, ["user_id"], ["ts", "event_id"], buckets=8), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
        logs.drain(keyed.changes(src, "user_id", "ts", "event_id", "props", {}, "10 seconds", buckets=8), f"file://{tmp_path}/out2", f"file://{tmp_path}/cp2")
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [*range(300), 9000]
    want, before = [], {}
    for u, i in [(k % 300, k) for k in range(900)] + [(k % 300 if k % 2 else None, k) for k in range(9000, 9589)]:
        if u in before:
            want.append((u, i, at(before[u]), (i >= 9000) != (before[u] >= 9000)))
        before[u] = i
    got = [(r.user_id, r.event_id, r.previous, r.text_changed) for r in spark.read.parquet(f"{tmp_path}/out2").collect()]
    assert sorted(got, key=lambda r: r[1]) == want
