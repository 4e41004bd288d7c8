"""Corpus pipeline: language identification, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last
return the columns of ``docs`` as they are, whatever their names; an empty table gives an empty
one. NULLs in columns other than doc_id and text have no influence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import stored, text_batches
from panelyard.llm.language_id import accepted, fit_language_model, held_out
from panelyard.llm.ngram_join import one_per_class
from panelyard.llm.packing import pack, tokenized_pieces
from panelyard.llm.quality_rules import rules_column


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Texts that are NULL, empty or without a letter go.
    Equal texts share a fate. Rows with a NULL id are judged like others."""
    text_batches(spark)
    model = fit_language_model(docs.filter(~held_out()))
    return docs.filter(accepted(model))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the length and repetition rules. NULL and empty texts have no words and go;
    each row is judged by its own text, so equal rows share a fate."""
    text_batches(spark)
    return docs.filter(rules_column(F.col("text").cast("string"), spans=False)["kept"])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id; of rows equal in id
    and shingles one stays. Texts that are NULL, empty or without words all stay."""
    text_batches(spark)
    return one_per_class(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens. A NULL or empty text
    is one piece of the end id. Every row is packed, repeated ones too; columns of ``docs`` other
    than doc_id and text are left out."""
    text_batches(spark)
    packed = pack(tokenized_pieces(docs))
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

# No SQL can express the stages' models, suffix arrays and tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
