"""Table readers. Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelyard.operators.sizing import measured

ISO3 = "^[A-Z]{3}$"
FILES = 50_000   # up to so many file splits their lines' places are broadcast


def read_table(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str | None = None
) -> DataFrame:
    """A tidy table as CSV (with a header line) or Parquet; the format comes from the path unless
    given. A CSV header that does not name the schema's columns in their order is an error."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith((".parquet", ".pq")) else "csv")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("enforceSchema", "false").csv(path, header=True)
    return reader.format(fmt).load(path)


def drop_repeated_headers(df: DataFrame, code: str, pattern: str = ISO3) -> DataFrame:
    """Rows whose code matches the pattern; a header line in the middle does not."""
    return df.filter(F.col(code).rlike(pattern))


def skip_preamble(lines: DataFrame, skip: int, position: str = "position") -> DataFrame:
    """Lines behind ``skip`` preamble lines and one header line; ``position`` counts a file's
    lines from 0. Blank lines go."""
    return lines.filter((F.col(position) > skip) & (F.length(F.trim("value")) > 0))


def parse_lines(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """CSV text in ``value`` as columns."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1]
    return lines.select(F.from_csv("value", ddl).alias("_row")).select("_row.*")


def read_dim(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    code: str = "countrycode",
    pattern: str = ISO3,
) -> DataFrame:
    """A CSV lookup. Rows whose code does not match ``pattern`` (repeated header lines) are dropped."""
    return drop_repeated_headers(read_table(spark, path, schema, "csv"), code, pattern)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files under ``path``: (file, line, value), a file's lines counted from 0.

    The text scan hands out ascending row ids inside a file split. A line's number is its place in
    its split and the lines of the file's splits before, which are one row each: no file is
    read in one piece, and no RDD is needed."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits, n = measured(lines.groupBy(F.col("file").alias("_f"), F.col("_start").alias("_s")).agg(
        F.min("_id").alias("_first"), F.count("*").alias("_lines")
    ))
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    # One row per split: broadcast while that is little, whatever the files' sizes.
    found = F.broadcast(splits) if n <= FILES else splits
    placed = lines.join(found, (F.col("file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return placed.select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value", "_start")


def joined_records(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value and the split they are from) as records: a line inside an open quote
    belongs to the record before. Quotes are counted along each split, and over a file's
    splits, which are one row each. Only lines of records of several lines are brought together.
    A quote that is never closed takes the rest of its file into one record."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("_q", quotes)
    splits = counted.groupBy(F.col("file").alias("_f"), F.col("_start").alias("_s")).agg(F.sum("_q").alias("_all"))
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_open", F.coalesce(F.sum("_all").over(before), F.lit(0)) % 2)
    inside = Window.partitionBy("file", "_start").orderBy("line")
    placed = counted.join(splits, (F.col("file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    after = (F.sum("_q").over(inside) + F.col("_open")) % 2
    placed = placed.withColumn("_after", after).withColumn("_inner", (F.col("_after") + F.col("_q")) % 2 == 1)
    single = placed.filter(~F.col("_inner") & (F.col("_after") == 0)).select("file", "line", "value")
    several = placed.filter(F.col("_inner") | (F.col("_after") == 1))
    # Of what is left, a record's first line is one that no quote is open before.
    along = Window.partitionBy("file").orderBy("line")
    several = several.withColumn("_record", F.max(F.when(~F.col("_inner"), F.col("line"))).over(along))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])
    whole = several.groupBy("file", F.col("_record").alias("line")).agg(F.array_join(parts, "\n").alias("value"))
    return single.unionByName(whole)


def read_csv_checked(
    spark: SparkSession, path: str, schema: StructType | str, skip: int = 0, header: bool = True, several_lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """CSV files that open with ``skip`` preamble lines and, with ``header``, a header line, as two
    tables: the records that fit the schema, and the broken ones as (file, line, record), ``line``
    counted from 1. A record with too few or too many fields, or with text where a number belongs,
    is broken; an empty field is NULL. ``several_lines`` joins records whose quoted fields hold line
    ends. A file that ends within its preamble is an error."""
    lines = numbered_lines(spark, path)
    first = skip + int(header)
    short = lines.groupBy("file").agg(F.max("line").alias("last")).filter(F.col("last") + 1 < first).limit(1).collect()
    if short:
        raise ValueError(f"{short[0]['file']} ends within {skip} preamble lines and a header")
    body = lines.filter((F.col("line") >= first) & (F.length(F.trim("value")) > 0))
    records = joined_records(body) if several_lines else body.select("file", "line", "value")
    ddl = schema if isinstance(schema, str) else schema.simpleString()[len("struct<"):-1]
    options = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"} | ({"multiLine": "true"} if several_lines else {})
    parsed = records.select("file", "line", "value", F.from_csv("value", ddl + ", _broken string", options).alias("_row"))
    good = parsed.filter(F.col("_row._broken").isNull()).select("_row.*").drop("_broken")
    broken = parsed.filter(F.col("_row._broken").isNotNull()).select("file", (F.col("line") + 1).alias("line"), F.col("value").alias("record"))
    return good, broken


def read_csv_skip(
    spark: SparkSession, path: str, skip: int, schema: StructType | str
) -> DataFrame:
    """CSV files that open with ``skip`` preamble lines and one header line, wherever the files'
    splits end. Values that do not fit the schema are NULL; ``read_csv_checked`` finds such records."""
    lines = numbered_lines(spark, path)
    short = lines.groupBy("file").agg(F.max("line").alias("last")).filter(F.col("last") < skip).limit(1).collect()
    if short:
        raise ValueError(f"{short[0]['file']} ends within {skip} preamble lines and a header")
    return parse_lines(skip_preamble(lines, skip, "line"), schema)


def literal_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str
) -> DataFrame:
    """A parameter table typed into the program (cutoffs, classes)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
