"""File sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.sources.storage import new_table_path


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header and a declared schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=True)


def _recode(convert) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(convert, na_action="ignore")
    return run


def read_csv_fallback(spark: SparkSession, path: str, schema, sep: str = ",",
                      encodings: tuple[str, ...] = ("utf-8", "cp949")) -> DataFrame:
    """Files in UTF-8 or in a legacy encoding, decided for each file: one whose text is not all valid UTF-8 takes the other encoding.

    Files are read byte for byte, so they stay splittable. The decision is one row per file. Python decodes legacy files only.
    """
    legacy = encodings[-1]

    def decode(value: str) -> str:
        return value.encode("latin-1").decode(legacy, errors="replace")

    raw = read_csv(spark, path, schema, sep, "ISO-8859-1")
    texts = [c for c, k in raw.dtypes if k == "string"]
    if not texts:
        return raw
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    valid = F.min(F.forall(F.array(*texts), lambda v: F.coalesce(F.is_valid_utf8(F.encode(v, "ISO-8859-1").cast("string")), F.lit(True))))
    marked = rows.join(rows.groupBy("_file").agg(valid.alias("_utf8")), "_file")
    decoded = {c: F.when(F.col("_utf8"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(_recode(decode)(F.when(~F.col("_utf8"), F.col(c)))) for c in texts}
    return marked.withColumns(decoded).select(*raw.columns)


def write_csv_encoded(df: DataFrame, label: str, sep: str, encoding: str) -> str:
    """Write text columns in an encoding outside the reader's own list."""
    def encode(value: str) -> str:
        return value.encode(encoding).decode("latin-1")

    shifted = df.withColumns({c: _recode(encode)(F.col(c)) for c, k in df.dtypes if k == "string"})
    return write_csv(shifted, label, sep, "ISO-8859-1")


def write_csv(df: DataFrame, label: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    path = new_table_path(df.sparkSession, label)
    df.write.csv(path, header=True, sep=sep, encoding=encoding)
    return path


def write_partitioned(df: DataFrame, label: str, keys: list[str]) -> str:
    """One folder per key value; each task writes its own part of a key, so a large key has many writers."""
    path = new_table_path(df.sparkSession, label)
    df.write.partitionBy(*keys).parquet(path)
    return path


def write_new(df: DataFrame, path: str) -> str:
    """Load into a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)
    return path


def write_json_documents(df: DataFrame, label: str) -> str:
    path = new_table_path(df.sparkSession, label)
    df.write.json(path)
    return path


def read_trials_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents with a nested list of trials become one row per trial."""
    docs = spark.read.json(path, schema=schema)
    return docs.select(*[c for c in docs.columns if c != "all_trials"], F.explode("all_trials").alias("t")).select(
        *[c for c in docs.columns if c != "all_trials"], "t.*")
