"""CSV sources and staged tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from samplewright.functions.nulls import quoted
from samplewright.operators.ordering import columns
from samplewright.session import settle


def _as_schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


# Quotes inside a field are doubled and a quoted field may hold line breaks, so one file is read by one task, unless the
# caller knows that no field holds one.
DIALECT = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
UNKNOWN = "\u0000NULL"  # how a staged text column tells NULL from any text


def _read(spark: SparkSession, path: str, schema: StructType, sep: str, unknown: str, **options: object) -> DataFrame:
    """The fields of ``schema`` as text, found by their names in the header."""
    raw = spark.read.csv(path, sep=sep, nullValue=unknown, emptyValue="", inferSchema=False, **{**DIALECT, **options})
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.col(quoted(f.name)) for f in schema])


def read_csv(spark: SparkSession, path: str, schema: StructType | str, line_breaks: bool = True) -> DataFrame:
    """Comma-separated file with a header; "NA" and empty fields are NULL, an empty field in quotes is an empty text.

    Columns are taken by name, in the order of ``schema``; others are passed over, a missing one is an error. What is
    not of a column's type becomes NULL. ``line_breaks`` False says that no quoted field holds a line break: a file is
    then cut into pieces that are read by many tasks.
    """
    schema = _as_schema(schema)
    raw = _read(spark, path, schema, ",", "NA", multiLine=line_breaks)
    return raw.select(*[_typed(F.col(quoted(f.name)), f) for f in schema])


def _typed(c: Column, f: StructField) -> Column:
    return (c if isinstance(f.dataType, StringType) else F.trim(c).try_cast(f.dataType)).alias(f.name)


def read_csv_decimal_comma(
    spark: SparkSession, path: str, schema: StructType | str, line_breaks: bool = True
) -> DataFrame:
    """Semicolon-separated file with decimal commas and dots between thousands; columns are taken by name.

    Numbers are read as text and converted by column arithmetic, so that they keep
    their full precision; what is not a number becomes NULL. ``line_breaks`` as for :func:`read_csv`.
    """
    schema = _as_schema(schema)
    raw = _read(spark, path, schema, ";", "NA", multiLine=line_breaks)

    def convert(f: StructField) -> Column:
        c = F.col(quoted(f.name))
        return _typed(F.translate(c, ",.", ".") if isinstance(f.dataType, NumericType) else c, f)

    return raw.select(*[convert(f) for f in schema])


def stage(
    df: DataFrame,
    path: str | None = None,
    format: str = "parquet",
    by: str | Sequence[str] | None = None,
    mode: str = "error",
) -> DataFrame:
    """Store a result between two steps and return it as read back.

    Parquet keeps later reads narrow and filtered. Without ``path`` the table goes to
    the folder shared by the session. ``by`` makes a folder per value, for columns with
    few values.
    """
    if path is None:
        if format != "parquet" or by:
            raise ValueError("a path is needed for this format or layout")
        return settle(df)
    if format not in ("parquet", "csv"):
        raise ValueError("format must be 'parquet' or 'csv'")
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*columns(by))
    spark = df.sparkSession
    if format == "csv":
        exact = {"lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        dialect = {k: DIALECT[k] for k in ("header", "quote", "escape")}
        writer.csv(path, nullValue=UNKNOWN, emptyValue="", quoteAll=True, **dialect, **exact)
        raw = _read(spark, path, df.schema, ",", UNKNOWN, **exact)
        return raw.select(*[_typed(F.col(quoted(f.name)), f) for f in df.schema])
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
