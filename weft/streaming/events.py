"""Structured Streaming forms of the event operators: windowed counts, folding of deltas, repeat detection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.storage import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; new files of the folder are new batches."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and values by event type and tumbling window; rows later than the watermark are left out."""
    ev = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ev.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there, and read its last result (complete) or all results (append) from shared storage."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/weft-stream-{uuid.uuid4().hex}"
    how = "overwrite" if mode == "complete" else "append"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", root + "/state").foreachBatch(lambda df, _: df.write.mode(how).parquet(root + "/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(root + "/out")


def folded(events: DataFrame, key: str, order: list[str], delta: str) -> DataFrame:
    """Each key's deltas joined in order (a batch)."""
    seq = F.sort_array(F.collect_list(F.struct(*order, delta)))
    return events.groupBy(key).agg(F.array_join(F.transform(seq, lambda x: x[delta]), "").alias("text"), F.count("*").alias("n"))


def fold_stream(stream: DataFrame) -> DataFrame:
    """(item, text) after each batch of (item, seq, delta, done): deltas are appended by seq; a done text replaces all before it."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (text,) = state.get if state.exists else ("",)
        rows = pd.concat(list(batches)).sort_values("seq")
        for d, done in zip(rows["delta"], rows["done"], strict=True):
            text = d if done else text + d
        state.update((text,))
        yield pd.DataFrame({"item": [key[0]], "text": [text]})

    return stream.groupBy("item").applyInPandasWithState(fold, "item string, text string", "text string", "update", GroupStateTimeout.NoTimeout)


def distinct_calls(events: DataFrame, keys: list[str], call_id: str) -> tuple[DataFrame, DataFrame]:
    """The distinct calls to run (the first id of each), and every call id with the id of the call that runs for it."""
    runs = events.groupBy(*keys).agg(F.min(call_id).alias("run_id"))
    return runs, events.join(runs, keys).select(call_id, "run_id")
