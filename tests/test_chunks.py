"""Events from chunks of any size, as a batch and as a stream over several files."""

import random

import pytest

from weft.operators.storage import shared_dir
from weft.streaming import chunks as C

TEXT = "event: a\ndata: 1\n\n\n\ndata: 2\nevent: b\ndata:   3\n\nevent: lonely\n\n: note\ndata: é\n\ndata: \n\ndata:4\n\ndata: unfinished\n"
WANT = [(0, "a", "1"), (1, "b", "  3"), (2, "", "é")]


def cut(key, text, size):
    return [(key, k, text[k * size : (k + 1) * size]) for k in range(-(-len(text) // size))]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_any_size_gives_the_same_events(spark, monkeypatch, size):
    monkeypatch.setattr(C, "RANGE", 5)
    rows = cut("x", TEXT, size) + cut("y", TEXT * 3, size) + [("z", 0, None), ("z", 1, "data: end")]
    random.shuffle(rows)
    got = C.events(spark.createDataFrame(rows, "s string, seq long, chunk string"), "s").collect()
    assert sorted((r.n, r.event, r.data) for r in got if r.s == "x") == WANT
    assert sorted(r.n for r in got if r.s == "y") == list(range(9))
    assert not [r for r in got if r.s == "z"]


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_stream_carries_what_is_unfinished(spark, size, tmp_path):
    rows = cut("x", TEXT, size)
    third = max(1, len(rows) // 3)
    root = f"{shared_dir(spark)}/chunks-{size}"
    schema = "s string, seq long, chunk string"
    for k in range(0, len(rows), third):
        spark.createDataFrame(rows[k : k + third], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = C.event_stream(spark.readStream.schema(schema).parquet(f"{root}/in"), "s")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{root}/out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema("s string, n long, event string, data string").parquet(f"{root}/out").collect()
    assert sorted((r.n, r.event, r.data) for r in got) == WANT
