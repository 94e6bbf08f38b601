"""A corpus pipeline of five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents. Nothing here samples or
cuts texts, and clean documents stay:

* toxicity drops documents that score THRESHOLD or more (rows with null text score as empty ones);
* line dedup cuts long lines that three documents share from all but the last of them, and counts n_chars anew;
* Jaccard join keeps the smallest doc_id of each group of near copies (rows with null doc_id or no words stay, and so
  does a text of a repeated doc_id that is near no other document's);
* decontamination cuts occurrences of benchmark windows, and drops documents that are mostly made of them;
* BPE encodes what is left.

Null texts are empty ones throughout and stay null; empty tables pass through; repeated rows share their document's fate,
row by row; further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import op1_toxicity, op4_bpe, op7_decontaminate, op9_jaccard, op10_lines
from weft.llm.common import fresh_name, materialise, table

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op1_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh_name(docs, "toxicity")
    scored = op1_toxicity.score_documents(docs, model, name)
    return scored.where(F.col(name) < op1_toxicity.THRESHOLD).select(*docs.columns)


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return (docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in columns else docs).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(op10_lines.dedup_lines(docs, counts=False), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_jaccard.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(op7_decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op4_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
