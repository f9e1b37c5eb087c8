"""Python workers give freed memory back; texts are searched in short pieces without loss."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import decontaminate
from paperloom.llm.batches import prepare


def test_freed_blocks_leave_the_worker(spark):
    def run(batches):
        def resident():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096 >> 20

        for b in batches:
            del b
            first = np.ones(30 << 20, np.uint8)  # once freed, the default allocator keeps blocks of this size
            del first
            before = resident()
            blocks, pins = [], []
            for _ in range(100):
                blocks.append(np.ones(2 << 20, np.uint8))
                pins.append(bytearray(100_000))  # between the blocks
            del blocks
            yield pa.RecordBatch.from_pydict({"mb": pa.array([resident() - before], pa.int64())})
            del pins

    got = prepare(spark).range(0, 1, 1, 1).mapInArrow(run, "mb long").first()["mb"]
    assert got < 64


def test_pieces_of_texts_lose_no_leak(spark, monkeypatch):
    prepare(spark)
    passage = "The quick surveyor measured seventeen abandoned lighthouses along the northern coast before the winter storms arrived in November."
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"),
        F.concat(F.repeat(F.concat(F.lit("filler words number "), F.col("id").cast("string"), F.lit(" ")), 60),
                 F.when(F.col("id") % 4 == 0, F.lit(passage)).otherwise(F.lit("nothing here"))).alias("text"),
    )
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = []
    for size in (8 << 20, 4_000):
        monkeypatch.setattr(decontaminate, "SLICE", size)
        found.append(sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect()))
    assert found[0] == found[1] and [r[0] for r in found[0]] == list(range(0, 40, 4))
