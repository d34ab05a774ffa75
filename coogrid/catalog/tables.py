"""Matrices, vectors and series on the given tables, with the SQL that defines them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..operators.multiply import mxm


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def size(self, name: str) -> int:
        """Row count, answered from file footers."""
        return self.read(name).count()

    def raw_pairs(self) -> DataFrame:
        """Order-part pairs as listed, repeats included, with the line number."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col_id"), "l_linenumber"
        )

    def graph(self) -> Matrix:
        """Square pattern G: order -> part, part keys taken as indices again."""
        n = self.size("orders")
        return Matrix.from_edges(self.read("lineitem"), "l_orderkey", "l_partkey", n, n)

    def graph_squared(self) -> Matrix:
        g = self.graph()
        return mxm(g, g)

    def weights(self) -> Matrix:
        """Valued W: supplier x part, summed quantity."""
        shape = self.size("supplier"), self.size("part")
        return Matrix.from_edges(self.read("lineitem"), "l_suppkey", "l_partkey", *shape, "l_quantity", "sum")

    def orders_by(self, key: str, ncols: int) -> Matrix:
        """Valued order x ``key`` matrix of summed quantities; some orders have no line."""
        lines = self.read("lineitem")
        return Matrix.from_edges(lines, "l_orderkey", key, self.size("orders"), ncols, "l_quantity", "sum")

    def member(self, table: str, row: str, col: str, ncols: int) -> Matrix:
        """Pattern with one entry per row of a table."""
        return Matrix.from_edges(self.read(table), row, col, self.size(table), ncols)

    def vector(self, table: str, idx: str, val: str) -> DataFrame:
        return self.read(table).select(F.col(idx).alias("idx"), F.col(val).cast("double").alias("val"))

    def cents(self) -> DataFrame:
        """Events with the value as whole cents: ``event_id, ts, user_id, event_type, cents``."""
        return self.read("events").select(
            "event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents")
        )

    def timings(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("experiment"),
            F.col("event_id").alias("iteration"),
            F.col("value").alias("ms"),
        )

    def samples(self) -> DataFrame:
        """Sampled series ``ts, used_mib, seq``."""
        return self.cents().select("ts", F.col("cents").alias("used_mib"), F.col("event_id").alias("seq"))

    def experiments(self) -> DataFrame:
        """One section of 37 minutes from each event on."""
        return self.read("events").select(
            F.col("event_id").alias("section_id"),
            F.col("event_type").alias("name"),
            F.col("ts").alias("t_begin"),
            F.expr("ts + INTERVAL 37 MINUTE").alias("t_end"),
        )


#: Common table expressions of the definitions above.
G = "g AS (SELECT DISTINCT l_orderkey AS row_id, l_partkey AS col_id FROM lineitem)"
G2 = (
    G + ",\ng2 AS (SELECT DISTINCT x.row_id, y.col_id FROM g x JOIN g y ON x.col_id = y.row_id)"
)
W = (
    "w AS (SELECT l_suppkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS val "
    "FROM lineitem GROUP BY l_suppkey, l_partkey)"
)
CENTS = (
    "c AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
)
SECTIONS = """c AS (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
e AS (SELECT event_id AS section_id, ts AS b, ts + INTERVAL 37 MINUTE AS f FROM events),
s AS (SELECT e.section_id, e.b, c.ts AS last FROM e ASOF JOIN c ON e.f >= c.ts)"""


def orders_by_sql(key: str) -> str:
    return (
        f"a AS (SELECT l_orderkey AS row_id, {key} AS col_id, sum(l_quantity) AS val "
        f"FROM lineitem GROUP BY l_orderkey, {key})"
    )
