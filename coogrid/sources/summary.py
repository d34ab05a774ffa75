"""Experiment summaries and per-section reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_summary(stats: DataFrame, path: str) -> None:
    """Append ``name, iterations, expectation_ms, sd_ms`` rows of timing statistics.

    The expectation is the mean without the first iteration.  The table is created
    on first use.
    """
    stats.select(
        F.col("experiment").alias("name"),
        "iterations",
        F.col("avg_drop_first_ms").alias("expectation_ms"),
        "sd_ms",
    ).write.mode("append").parquet(path)


def read_summaries(spark: SparkSession, base: str) -> DataFrame:
    """All summaries kept as ``<base>/target=<name>`` in one report with a ``target`` column."""
    schema = "name string, iterations bigint, expectation_ms double, sd_ms double, target string"
    return spark.read.schema(schema).parquet(base)


def read_summary_text(spark: SparkSession, path: str) -> DataFrame:
    """``file, name, iterations, expectation_ms, sd_ms`` from fixed-width text summaries.

    A result line is ``name: iterations expectation sd``; title and column heads are
    skipped.
    """
    number = r"([-+0-9.eE]+|nan|inf)"
    line = rf"^\s*(.+?):\s+(\d+)\s+{number}\s+{number}\s*$"
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    found = raw.where(F.col("value").rlike(line))

    def group(i: int):
        return F.regexp_extract("value", line, i)

    return found.select(
        "file",
        F.trim(group(1)).alias("name"),
        group(2).cast("long").alias("iterations"),
        group(3).cast("double").alias("expectation_ms"),
        group(4).cast("double").alias("sd_ms"),
    )


#: Column widths of the text form of a summary.
_NAME_WIDTH, _FIGURE_WIDTH = 50, 15


def append_summary_text(stats: DataFrame, path: str, target: str) -> None:
    """Append timing statistics as fixed-width text below ``path``, one folder of text parts per target.

    Title and column heads go to a part of their own when the folder is new;
    :func:`read_summary_text` reads the folder.
    """
    spark = stats.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def aligned(value, width: int):
        text = value.cast("string")
        return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)

    if not files.exists(place):
        names = ("Friendly name", "iterations", "expectation ms", "sd ms")
        widths = (_NAME_WIDTH, *[_FIGURE_WIDTH] * 3)
        heads = "".join(f"{n:>{w}}| " for n, w in zip(names, widths, strict=True))
        title = spark.createDataFrame([(f"Benchmarking: {target}\n\n{heads}",)], "value string")
        title.write.mode("append").text(path)
    figures = ("iterations", "avg_drop_first_ms", "sd_ms")
    line = F.concat(
        aligned(F.col("experiment"), _NAME_WIDTH),
        F.lit(": "),
        F.concat_ws("  ", *(aligned(F.col(c), _FIGURE_WIDTH) for c in figures)),
    )
    stats.select(line.alias("value")).write.mode("append").text(path)


def section_lines(sections: DataFrame) -> DataFrame:
    """Report text ``section_id, line`` of ``section_id, name, min_mib, max_mib, used_mib``.

    An empty section shows ``-`` for its figures.
    """

    def figure(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("-"))

    # The words and spacing of the report.
    head = F.concat(F.lit("["), F.col("section_id").cast("string"), F.lit("] "), F.col("name"))
    body = F.concat(
        F.lit("min= "), figure("min_mib"), F.lit(" MiB max= "), figure("max_mib"),
        F.lit(" MiB used= "), figure("used_mib"), F.lit(" MiB"),
    )
    return sections.select("section_id", F.concat_ws("\n", head, body, F.lit("")).alias("line"))


def section_report(sections: DataFrame, path: str) -> None:
    """Write the report in section order: part files hold consecutive ranges of sections."""
    section_lines(sections).orderBy("section_id").select("line").write.mode("overwrite").text(path)
