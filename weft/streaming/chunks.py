"""Server-sent events from chunks of text that cut them anywhere, as a batch and as a stream.

A stream's text is lines; "event: " and "data: " lines belong to the event that the next empty line ends. Of several lines
of a kind the last holds; an event without a name has an empty one, one without data is none, and what no empty line has
ended isn't an event yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rows that one task puts in order, at most or so.
RANGE = 1 << 14


def running(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows before, in an order of whole numbers: ranges of it are summed first."""
    at = df.withColumn("_range", F.floor(F.col(order) / RANGE))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy(*by, "_range").agg(F.sum(value).alias("_s")).withColumn("_start", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return at.join(starts, [*by, "_range"]).withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_range", "_start")


def rendered(rows: DataFrame, key: str, order: str, event: str, text: str, size: int) -> DataFrame:
    """(key, seq, chunk): each row as an event, in order, cut into chunks of `size` characters whatever they hold."""
    block = F.concat(F.lit("event: "), F.coalesce(event, F.lit("")), F.lit("\ndata: "), F.to_json(F.struct(F.col(text).alias("text"))), F.lit("\n\n"))
    placed = running(rows.select(key, order, block.alias("b")).withColumn("n", F.length("b")), [key], order, "n", "at")
    seqs = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))
    cut = placed.select(key, "at", "b", F.explode(seqs).alias("seq"))
    start = F.greatest(F.col("seq") * size - F.col("at"), F.lit(0)).cast("int")
    piece = F.substr("b", start + 1, ((F.col("seq") + 1) * size - F.col("at")).cast("int") - start)
    pieces = cut.select(key, "seq", F.struct("at", piece.alias("p")).alias("x"))
    return pieces.groupBy(key, "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), "").alias("chunk"))


def _field(line: str, name: str):
    return F.when(F.col(line).startswith(f"{name}: "), F.substr(line, F.lit(len(name) + 3)))


def events(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n, event, data) of chunks (key, seq, chunk), seq a whole number: n counts a stream's events from 0.

    Line ends before each chunk say which line its pieces belong to, and empty lines before each line which event; a line
    that chunks cut is joined from its pieces, and no task puts a whole stream in order.
    """
    c = chunks.select(key, "seq", F.coalesce("chunk", F.lit("")).alias("chunk")).withColumn("ends", F.length("chunk") - F.length(F.replace("chunk", F.lit("\n"), F.lit(""))))
    total = c.groupBy(key).agg(F.sum("ends").alias("_lines"))
    pieces = running(c, [key], "seq", "ends", "first").select(key, "seq", "first", F.posexplode(F.split("chunk", "\n")).alias("k", "piece"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    lines = pieces.groupBy(key, (F.col("first") + F.col("k")).alias("line")).agg(joined.alias("text"))
    # the last line of a stream has no end yet
    lines = lines.join(total, key).where(F.col("line") < F.col("_lines")).drop("_lines").withColumn("empty", (F.col("text") == "").cast("int"))
    told = running(lines, [key], "line", "empty", "block")
    last = lambda name: F.max_by(_field("text", name), F.when(F.col("text").startswith(f"{name}: "), F.col("line")))
    blocks = told.groupBy(key, "block").agg(F.coalesce(last("event"), F.lit("")).alias("event"), last("data").alias("data"), F.max("empty").alias("ended")).where("ended = 1 AND data <> ''")
    return running(blocks.withColumn("one", F.lit(1)), [key], "block", "one", "n").select(key, "n", "event", "data")


def event_stream(chunks: DataFrame, key: str) -> DataFrame:
    """The same of a stream of chunks that arrive in order of seq: what no empty line has ended yet is carried as state."""
    kind = chunks.schema[key].dataType.simpleString()

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        *lines, rest = (rest + "".join(x or "" for x in rows["chunk"])).split("\n")
        out, own, open_lines = [], {}, []
        for line in lines:
            open_lines.append(line)
            name, found, value = line.partition(": ")
            if line == "":
                if own.get("data"):
                    out.append((group[0], n, own.get("event", ""), own["data"]))
                    n += 1
                own, open_lines = {}, []
            elif found and name in ("event", "data"):
                own[name] = value
        state.update(("\n".join([*open_lines, rest]), n))
        yield pd.DataFrame(out, columns=[key, "n", "event", "data"])

    return chunks.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, event string, data string", "rest string, n long", "append", GroupStateTimeout.NoTimeout)
