"""Shared helpers of the text operators: folds, bounded samples, Arrow passes, connected components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import drop_cut, materialize

# Kernels travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Rows a task hands to Python code at a time; texts can be long, so batches of Spark are cut further.
SLICE_ROWS = 256

_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(),
}


def fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    longer = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        longer.append(name)
    return longer


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``SLICE_ROWS`` rows at most.

    The default of 10,000 rows is meant for numbers; as many texts would fill a
    worker, and the JVM's buffers beside it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= SLICE_ROWS:
        conf.set(key, str(SLICE_ROWS))
    return df


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """Rows of ``df`` through a kernel of plain lists.

    ``make()`` runs once per task and returns the kernel; the kernel gets one list
    per column of ``df`` and gives tuples in the order of ``schema``
    (``"doc_id long, score double"``).
    """
    fields = [f.split() for f in schema.split(",")]
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for part in slices(batches, rows):
            out = list(kernel(*(c.to_pylist() for c in part.columns)))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return small_batches(df).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Whole rows of ``df`` for which the kernel says so, whatever other columns there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for part in slices(batches):
            at = part.schema.get_field_index(column)
            yield part.filter(pa.array(kernel(part.column(at).to_pylist()), pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


def labelled_sample(labels: DataFrame, label: str, bound: int, held: tuple[int, int] | None = None) -> DataFrame:
    """About ``bound`` labelled ids at most, chosen by a hash of the id: ``doc_id, y``.

    Rows with a null id, a label other than 0 or 1 or a held-out id take no part; an
    id labelled twice counts once, with the larger label.  The choice is a
    threshold on the hash, so the result is as many rows as there are up to the
    bound, and the bound give or take its square root beyond.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if held:
        rows = rows.where(~fold("doc_id", *held))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = rows.count()
    if n > bound:
        share = int(bound / n * (1 << 30))
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share)
    return rows


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: ``node, root``.

    Alternating star contraction: in the large step the larger neighbours of a
    node move to its smallest neighbour, in the small step the smaller ones do.
    Every step is one pre-aggregated minimum per node and one equi-join, so a hub
    with most of the edges is split by the join and never gathered.  Each step is
    kept in the shared folder until the next one is complete; the loop ends when a
    round changes nothing.
    """

    def kept(new: DataFrame, old: DataFrame) -> DataFrame:
        new = materialize(new)
        drop_cut(old)
        return new

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e)
    state = _digest(e)
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(large.where("u <> v").distinct(), e)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        e = kept(small.distinct(), e)
        now = _digest(e)
        if now == state:
            break
        state = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
