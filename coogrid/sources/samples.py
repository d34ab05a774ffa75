"""Memory sample tables and experiment time points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import int_div
from ..plans.ordered import ranked

#: Fixed value: the timestamp layout of these files; parses 1 to 6 fraction digits.
TIME_FORMAT = "yyyy/MM/dd HH:mm:ss.SSSSSS"


def _time(col: Column) -> Column:
    return F.to_timestamp_ntz(F.trim(col), F.lit(TIME_FORMAT))


def _stated(line: str) -> Column:
    """The time of a record's line, or a query failure that names the record."""
    where = F.concat(F.lit("record "), F.col("section_id").cast("string"))
    lacking = F.raise_error(F.concat(where, F.lit(" is cut off"))).cast("timestamp_ntz")
    return F.when(F.col(line).isNotNull(), _time(F.col(line))).otherwise(lacking)


def _mib(name: str) -> Column:
    return F.trim(F.regexp_replace(name, "MiB", "")).cast("long")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    return reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_mem_samples(spark: SparkSession, path: str) -> DataFrame:
    """``ts, pstate, total_mib, used_mib`` from a sampler's CSV with a header line."""
    raw = _csv(spark, path, "ts string, pstate string, total string, used string")
    return raw.select(
        _time(F.col("ts")).alias("ts"), "pstate", _mib("total").alias("total_mib"), _mib("used").alias("used_mib")
    )


def read_usage_samples(spark: SparkSession, path: str) -> DataFrame:
    """``total_mib, used_mib`` from the two-column form of the sampler's CSV."""
    raw = _csv(spark, path, "total string, used string")
    return raw.select(_mib("total").alias("total_mib"), _mib("used").alias("used_mib"))


def read_time_points(spark: SparkSession, path: str) -> DataFrame:
    """``section_id, target, matrix, name, t_begin, t_end`` from records of three lines.

    A record is a name line, whose first two words identify the experiment, a begin
    and an end time; a record that lacks a line or whose times can't be read fails the
    query.  Lines are numbered by a distributed pass, since a text file read in parallel
    has no line numbers.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )
    numbered = ranked(lines.where(F.trim("value") != ""), ["__file", "__block", "__row"], "__line")
    part = F.col("__line") % 3

    def line(i: int) -> Column:
        return F.max(F.when(part == i, F.trim("value")))

    records = numbered.groupBy(int_div(F.col("__line"), 3).alias("section_id")).agg(
        F.split(line(0), " ").alias("__names"), line(1).alias("__begin"), line(2).alias("__end")
    )
    target, matrix = F.get("__names", F.lit(0)), F.get("__names", F.lit(1))
    return records.select(
        "section_id",
        target.alias("target"),
        matrix.alias("matrix"),
        F.concat_ws(" ", target, matrix).alias("name"),
        _stated("__begin").alias("t_begin"),
        _stated("__end").alias("t_end"),
    )
