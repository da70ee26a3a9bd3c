"""Batch readers for Parquet and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.session import written

CORRUPT, MARK = "_corrupt_record", "\u0001end"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Delimited text with a header row and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def _checked(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """Declared fields beside the raw text of every line that does not fit them."""
    declared = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    # With pruned columns the parser would not look at the whole line.
    return spark.read.schema(declared).option("header", header).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)


def _is_long(line: Column, fields: int) -> Column:
    """Whether a line has more than ``fields`` fields.

    A mark is put behind the line, which is then parsed with one field more than
    declared: the mark is among those fields unless the line is too long.
    """
    names = [f"f{k}" for k in range(fields + 1)]
    parsed = F.from_csv(F.concat(line, F.lit("," + MARK)), ", ".join(f"{n} string" for n in names))
    return ~F.exists(F.array(*(parsed[n] for n in names)), lambda x: x.eqNullSafe(F.lit(MARK)))


def read_csv_skipping_long_lines(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Delimited text where a line with too many fields is skipped, also when the surplus fields are empty.

    A line with too few fields is kept, its missing fields NULL. Spark's own
    DROPMALFORMED drops both kinds.
    """
    raw = _checked(spark, path, schema, header)
    # The parser takes no query on the raw text alone, such as a plain count: a condition that always holds
    # keeps a declared field in every query.
    parsed = F.coalesce(F.length(F.col(f"`{schema.fields[0].name}`").cast("string")), F.lit(0)) >= 0
    fits = F.col(CORRUPT).isNull() | ~_is_long(F.col(CORRUPT), len(schema.fields))
    return raw.filter(fits & parsed).drop(CORRUPT)


def malformed_csv_lines(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """The lines that do not fit the schema, for an audit of what was lost.

    Only those lines are written: the parser takes no query on the raw text alone.
    """
    return written(_checked(spark, path, schema, header).filter(F.col(CORRUPT).isNotNull()), "csv-audit")


def stacked(*frames: DataFrame) -> DataFrame:
    """All extracts as one frame, matched by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
