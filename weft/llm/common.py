"""Helpers shared by the operators: reading tables, shared storage, and text as byte blocks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is worked on in blocks of about so many bytes, so that a task's memory doesn't follow its batch.
BLOCK_BYTES = 1 << 19
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case of letters, for columns that operators add on the way."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name = f"_{name}"
    return name


def crc_class(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys are in no class (-1)."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus, F.lit(-1))


def trim() -> None:
    """Give freed memory back to the system where the C library can: Python workers live through many tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of blocks of rows; a null is an empty text.

    A row that is longer than a block makes a block alone.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    trim()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that Python objects of a whole batch never exist at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    trim()


_POWER: dict[str, np.ndarray] = {}
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWER.get("r")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("r", _R), ("i", _RINV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWER[name] = np.multiply.accumulate(x)
    return _POWER["r"], _POWER["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray = _LOWER, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block (after mapping bytes by `lower`), and the first word of each row.

    gap: which bytes part words. The second array has one entry more than there are rows.
    """
    return word_places(data, offsets, lower, gap)[:2]


def word_places(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray = _LOWER, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes(), and where each word starts and ends in the block."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    low = lower[data]
    out = gap[low]
    starts = ~out
    starts[1:] &= out[:-1]
    ends = ~out
    ends[:-1] &= out[1:]
    # a row's edge parts words as well
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts[inner] = ~out[inner]
    ends[inner - 1] = ~out[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * inverse[s])
    # long words can be built to share a sum, whatever its base
    for k in np.flatnonzero(e - s > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(low[s[k] : e[k]].tobytes(), LONG_WORD)
    return hashes, np.searchsorted(s, offsets), s, e


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
