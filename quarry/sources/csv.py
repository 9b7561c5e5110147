"""CSV files as DataFrames of text, strictly: comma, double quotes, "" for a quote, as many cells as columns."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sql.errors import CSVError


def resolve(path: str) -> str:
    """Relative paths are against the caller's working folder."""
    return path if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else f"file://{os.path.abspath(path)}"


def read_csv(spark: SparkSession, path: str, names: list[str], header: bool) -> DataFrame:
    """All columns as text, empty cells as ''. Blank lines are skipped and CRLF is accepted.

    A first pass over the lines counts quotes: where every line has an even number no cell spans
    lines and the file can be split between tasks; an odd number in all is an unterminated quote.
    """
    path = resolve(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    try:
        told = spark.read.text(path).agg(F.sum(quotes).alias("n"), F.max(quotes % 2).alias("spans")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise CSVError(f"no such file: {path}") from e
        raise
    if (told["n"] or 0) % 2:
        raise CSVError(f"unterminated quote in {path}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    reader = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    df = reader.option("multiLine", bool(told["spans"])).option("nullValue", "\0").option("emptyValue", "").option("maxCharsPerColumn", -1).csv(path)
    return df.select(*[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(names))])
