"""State by increments, and streaming results in written tables."""

import random

from pyspark.sql import functions as F

from paperloom.session import new_table_path, path_exists
from paperloom.streaming import changes as S
from tests.conftest import rows

CHANGES = "operation string, id long, v long, ts timestamp, seq long"


def made(seed, n=400):
    rng = random.Random(seed)
    # One key holds a third of the changes.
    return [
        (rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), 1 if rng.random() < 1 / 3 else rng.randrange(40), rng.randrange(100), rng.randrange(50), i)
        for i in range(n)
    ]


def frame(spark, changes):
    raw = spark.createDataFrame(changes, "operation string, id long, v long, t long, seq long")
    return raw.select("operation", "id", "v", F.timestamp_seconds("t").alias("ts"), "seq")


def table(spark, **more):
    return S.StateTable(spark, new_table_path(spark, "state"), ["id"], ["v", "seq"], order="seq", **more)


def plain(changes):
    out = {}
    for key in {c[1] for c in changes}:
        own = sorted((c for c in changes if c[1] == key), key=lambda c: (c[3], c[4]))
        alive = [c for c in own if c[0] != "DELETE"]
        last = (alive or own)[-1]
        out[key] = (key, last[2], last[4], own[-1][0] == "DELETE")
    return sorted(out.values())


def state(t):
    return rows(t.state(), "id", "v", "seq", "is_deleted")


def test_increments_in_any_order_equal_one_run(spark):
    changes = made(1)
    t = table(spark, buckets=5)
    assert t.state() is None
    parts = [changes[i::7] for i in range(7)]
    random.Random(2).shuffle(parts)
    for n, part in enumerate([*parts, parts[0], []]):  # one repeated under a new number, an empty one
        t.apply(frame(spark, part), n)
    assert state(t) == sorted(plain(changes), key=repr)
    full = S.current_state(frame(spark, changes), ["id"], ["v", "seq"], order=F.col("seq"))
    assert rows(t.state()) == rows(full)


def test_an_increment_rewrites_only_its_buckets(spark):
    t = table(spark, buckets=16)
    t.apply(frame(spark, made(3)), 0)
    before = t.versions()
    t.apply(frame(spark, [("UPDATE", 1, 7, 99, 1000)]), 1)
    changed = {b for b, data in t.versions().items() if before.get(b) != data}
    assert len(changed) == 1 and state(t) == sorted(plain([*made(3), ("UPDATE", 1, 7, 99, 1000)]), key=repr)


def test_a_batch_that_broke_off_is_not_read_and_a_committed_one_not_repeated(spark, monkeypatch):
    t = table(spark)
    t.apply(frame(spark, [("INSERT", 1, 1, 1, 1)]), 0)

    class Broken(Exception):
        pass

    def broken(*_):
        raise Broken

    more = frame(spark, [("UPDATE", 1, 2, 2, 2), ("INSERT", 2, 5, 2, 3)])
    monkeypatch.setattr(t.spark.__class__, "createDataFrame", broken)  # after the data, before the commit
    try:
        t.apply(more, 1)
    except Broken:
        pass
    monkeypatch.undo()
    assert not path_exists(spark, f"{t.folder}/commits/1") and state(t) == [(1, 1, 1, False)]
    t.apply(more, 1)
    assert state(t) == [(1, 2, 2, False), (2, 5, 3, False)]
    t.apply(frame(spark, [("DELETE", 1, 0, 9, 9)]), 1)  # the same number: already there
    assert state(t) == [(1, 2, 2, False), (2, 5, 3, False)]


def test_a_stream_is_followed_from_call_to_call(spark):
    changes, source, check = made(5), new_table_path(spark, "source"), new_table_path(spark, "check")
    t = table(spark, buckets=4)
    counts = (new_table_path(spark, "counts"), new_table_path(spark, "check"))
    for i, part in enumerate((changes[200:], changes[:200], [])):  # the earlier half comes late
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = S.parquet_stream(spark, source, "*.parquet", CHANGES, files=1)
        t.follow(stream, check)
        n = S.run_to_table(stream.groupBy("operation").agg(F.count(F.lit(1)).alias("n")), ["operation"], *counts)
        seen = changes[200:] if i == 0 else changes
        assert state(t) == sorted(plain(seen), key=repr)
        want = {op: sum(c[0] == op for c in seen) for op in {c[0] for c in seen}}
        assert {r["operation"]: r["n"] for r in n.collect()} == want


def test_an_empty_stream(spark):
    source = new_table_path(spark, "source")
    frame(spark, []).write.parquet(source)
    stream = S.parquet_stream(spark, source, "*.parquet", CHANGES)
    out = S.run_to_table(S.live_counts(stream, "operation"), ["operation"], new_table_path(spark, "t"), new_table_path(spark, "c"))
    assert out.columns == ["operation", "n"] and out.count() == 0
