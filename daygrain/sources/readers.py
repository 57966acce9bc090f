"""Delimited survey files with fixed column types.

Types follow from the column name, never from the values: inferring them would turn the
code ``010101`` into a number and break every lookup.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrain.operators.reshape import ACTIVITY_COLUMN, WideTable, numbers

ID_COLUMN = "TUCASEID"

# fixed values: weight column of the multi-year and of the single-year file
WEIGHT_COLUMNS = ("TUFNWGTP", "TUFINLWGT")

# fixed values: columns of the survey files that the library uses, by type
INTEGER_COLUMNS = (
    "TEAGE", "TESEX", "TUYEAR", "TRYHHCHILD", "TRCHILDNUM", "TUDIARYDAY", "TRHOLIDAY",
    "TUACTIVITY_N", "TULINENO", "PEMARITL", "PTDTRACE", "PEEDUCA", "GESTFIPS", "HEFAMINC",
    "HUFAMINC", "TRTALONE", "TRTALONE_WK", "TESCHFT", "FIPS",
)


def column_type(name: str) -> T.DataType:
    if name == ID_COLUMN:
        return T.LongType()
    if name in WEIGHT_COLUMNS or re.search("^t[0-9]", name) or re.search("^TUFNWGTP[0-9]+$", name):
        return T.DoubleType()
    if name in INTEGER_COLUMNS:
        return T.IntegerType()
    return T.StringType()


def _header(spark: SparkSession, path: str, sep: str, quote: str) -> list[str]:
    """Column names of a file; reads its first line only."""
    return (
        spark.read.option("header", True).option("sep", sep).option("quote", quote)
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .csv(path).columns
    )


def read_table(
    spark: SparkSession, path: str, sep: str = ",", quote: str = '"', types: Mapping[str, T.DataType] | None = None
) -> DataFrame:
    """One delimited file with a header. ``types`` overrides the types of single columns."""
    names = _header(spark, path, sep, quote)
    types = types or {}
    schema = T.StructType([T.StructField(n, types.get(n, column_type(n))) for n in names])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", quote)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", "NA")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_wide_table(spark: SparkSession, path: str, sep: str = ",") -> WideTable:
    """A wide delimited file with its activity columns as one array, straight from the lines of text.

    The header gives the place of every column. Other columns have the types of ``column_type`` and are NULL where the
    file has ``NA`` or nothing; an activity cell that is no number counts as missing, which the estimates refuse. A line
    with quotes or with another number of values than the header is an error.
    """
    names = _header(spark, path, sep, '"')
    codes = tuple(n for n in names if re.search(ACTIVITY_COLUMN, n))
    if not codes:
        raise ValueError("a wide table needs activity columns")
    blank = "[ \\t]*"
    # every file of a folder starts with the header
    header = F.regexp_replace("value", f"{blank}{re.escape(sep)}{blank}", sep) == F.lit(sep.join(names))
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    # NULL for all that is no row, as expressions may be evaluated before a filter
    line = F.when((F.col("value") != "") & ~header, F.col("value"))
    fields = F.split(line, f"{blank}{re.escape(sep)}{blank}", -1)
    wrong = line.isNotNull() & ((F.size(fields) != len(names)) | F.contains(line, F.lit('"')))
    fails = F.raise_error(F.concat(F.lit(f"not {len(names)} plain values: "), line)).cast("array<string>")
    rows = lines.select(F.when(wrong, fails).otherwise(fields).alias("fields")).filter("fields is not null")
    place = {name: i for i, name in enumerate(names)}

    def typed(name: str) -> Column:
        text = F.get("fields", F.lit(place[name]))
        return F.when(~text.isin("", "NA"), text).cast(column_type(name)).alias(name)

    others = [n for n in names if n not in codes]
    first, last = place[codes[0]], place[codes[-1]]
    if last - first + 1 == len(codes):
        cells = F.slice("fields", first + 1, len(codes))
    else:
        cells = F.transform(numbers(place[c] for c in codes), lambda i: F.get("fields", i))
    return WideTable(rows.select(*map(typed, others), cells.try_cast("array<double>").alias("cells")), codes)


def read_directory(
    spark: SparkSession, folder: str, suffix: str = ".dat", sep: str = ",", wide: Sequence[str] = ()
) -> dict[str, DataFrame | WideTable]:
    """Every file of a folder as a table and temporary view named after the file; those in ``wide`` as wide tables."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    out = {}
    # only the names of the files are read here
    for path in sorted(row.path for row in listing.select("path").collect()):
        table = path.rsplit("/", 1)[-1][: -len(suffix)]
        out[table] = read_wide_table(spark, path, sep) if table in wide else read_table(spark, path, sep)
        view = out[table].data if table in wide else out[table]
        view.createOrReplaceTempView(table)
    return out


def read_code_table(spark: SparkSession, path: str, sep: str = "+") -> DataFrame:
    """``Code, Description`` lookup; both stay text and lose surrounding blanks."""
    table = read_table(spark, path, sep)
    return table.select(*[F.trim(c).alias(c) for c in table.columns])


def read_trend_table(spark: SparkSession, path: str) -> DataFrame:
    """The television table by age written by ``reports.tv_by_age_wide``."""
    wanted = ("age", "Male", "Female", "Male_smooth", "Female_smooth")
    table = read_table(spark, path, types={c: T.DoubleType() for c in wanted})
    return table.select(F.col("age").cast("int").alias("age"), *wanted[1:])


def weight_column(df: DataFrame) -> str:
    """The weight column of a summary file; fails if id or weight is missing."""
    present = [c for c in WEIGHT_COLUMNS if c in df.columns]
    if ID_COLUMN not in df.columns or not present:
        raise ValueError(f"data must contain {ID_COLUMN} and one of {', '.join(WEIGHT_COLUMNS)}")
    return present[0]


def without_missing(df: DataFrame, columns) -> DataFrame:
    """Fail on a missing value in columns that are summed."""
    checked = {
        c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
            F.raise_error(F.lit(f"missing value in {c}")).cast(df.schema[c].dataType)
        )
        for c in columns
    }
    return df.withColumns(checked)
