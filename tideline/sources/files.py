"""Reading and writing tables and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW_ROWS = 10_000
PREVIEW_CHARS = 10_000
REPLACEMENT = "\ufffd"  # what a decoder puts for bytes that are no UTF-8


def read_table(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with typed columns (inferred over the whole file unless a schema is given), or Parquet."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("encoding", encoding)
    # Plain timestamps carry no zone.
    reader = reader.option("inferTimestampNTZ", True).option("preferDate", False)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with every column as text: no inference pass, split into blocks by Spark."""
    return spark.read.option("header", True).csv(path)


def preview(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in a stated order (a bounded top-k, not a full sort)."""
    return df.orderBy(*order).limit(rows)


MARK = "\U0010fffe"  # a code point that stands for no character


def decoded(raw: Column) -> Column:
    """UTF-8 text without the bytes that are none; a replacement character that the text itself holds stays."""
    escaped = F.replace(F.replace(raw, F.lit(MARK), F.lit(MARK + "0")), F.lit(REPLACEMENT), F.lit(MARK + "1"))
    valid = F.replace(F.make_valid_utf8(escaped), F.lit(REPLACEMENT), F.lit(""))
    return F.replace(F.replace(valid, F.lit(MARK + "1"), F.lit(REPLACEMENT)), F.lit(MARK + "0"), F.lit(MARK))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one row ``(path, value)``; bytes that are no UTF-8 are left out. For files
    below 2 GB; ``read_lines`` has no such bound."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("path"), decoded(F.col("value")).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line as one row ``(path, value)``, large files in many tasks; bytes that are no UTF-8 are left out."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), decoded(F.col("value")).alias("value"))


def preview_file(spark: SparkSession, path: str, chars: int = PREVIEW_CHARS) -> str:
    """The first characters of one file. At most ``4 * chars`` bytes are read, whatever its size."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    size = min(4 * chars, files.getFileStatus(place).getLen())
    stream = files.open(place)
    try:
        head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()
    return head.decode("utf-8", "ignore")[:chars]


def text_preview(df: DataFrame, column: str = "value", chars: int = PREVIEW_CHARS) -> DataFrame:
    """Add the first characters of a text column as ``preview``."""
    return df.withColumn("preview", F.substring(F.col(column), 1, chars))


def export_csv(df: DataFrame, path: str) -> str:
    """Write with a header; partitions write side by side."""
    df.write.mode("error").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)
    return path
