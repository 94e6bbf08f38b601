"""Reading, searching and editing texts by line, and pruning paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def grep(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Lines that hold the pattern; texts without it aren't cut into lines."""
    return lines(df.where(F.col(text).rlike(pattern)), key, text).where(F.col("line").rlike(pattern))


def not_ignored(df: DataFrame, path: str, ignored: list[str]) -> DataFrame:
    """Rows none of whose path's parts is ignored."""
    return df.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored))))


def edited(df: DataFrame, text: str, old: str, new: str) -> DataFrame:
    """Replace old where it occurs exactly once; outcome tells edited, missing or ambiguous."""
    n = F.floor((F.length(text) - F.length(F.replace(F.col(text), F.lit(old), F.lit("")))) / len(old))
    outcome = F.when(n == 0, "missing").when(n == 1, "edited").otherwise("ambiguous")
    return df.withColumn("outcome", outcome).withColumn(text, F.when(F.col("outcome") == "edited", F.replace(F.col(text), F.lit(old), F.lit(new))).otherwise(F.col(text)))


def find_files(spark: SparkSession, root: str, glob: str, ignored: list[str] | None = None, depth: int = 20) -> DataFrame:
    """(path, length, modificationTime) of files below root; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")
    inner = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", ""), "/")
    found = found.where(F.size(inner) <= depth)
    return not_ignored(found, "path", ignored) if ignored else found


def read_documents(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, raw) of whole text files."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
