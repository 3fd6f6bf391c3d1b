"""Sources and sinks on the driver's tables: a labelled matrix, batches of CSV files, slices of equal row counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from breathline.catalog.binding import read
from breathline.session import use_checkpoint_dir
from breathline.sources import batches, tables
from breathline.sources.matrix_source import use_matrix_source

SLICES = 16
MATRIX_LINE = """CASE WHEN l_orderkey % 97 = 0 THEN concat_ws(' ', l_quantity, l_extendedprice) ELSE concat_ws(' ', l_quantity,
  CASE WHEN l_orderkey % 89 = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS STRING) END,
  CASE WHEN l_discount = 0 THEN '?' ELSE CAST(l_discount AS STRING) END, l_tax, l_linenumber,
  CASE WHEN l_orderkey % 83 = 0 THEN 'x y' END) END"""


def _new_folder(spark, name: str) -> str:
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def labelled_matrix_scan(spark, d):
    """Line items written as a labelled matrix with bad lines, read back by the data source."""
    folder = _new_folder(spark, "matrix")
    read(spark, d, "lineitem").selectExpr(f"{MATRIX_LINE} AS value").write.text(folder)
    use_matrix_source(spark)
    rows = spark.read.format("labelled_matrix").option("features", 4).option("label_at", 4).load(folder)
    return rows.select("x0", "x1", "x2", "x3", "label", F.col("_reason").alias("reason"))


def csv_batch_append(spark, d):
    """Orders appended in two batches, one of them twice, and read back."""
    folder = _new_folder(spark, "batches")
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    for batch, part in (("odd", "o_orderkey % 2 = 1"), ("even", "o_orderkey % 2 = 0"), ("odd", "o_orderkey % 2 = 1")):
        batches.append_batch(rows.filter(part), folder, batch)
    return batches.read_batches(spark, folder, rows.schema)


def balanced_slices(spark, d):
    """Orders per number of slices they fit, and whether the slices are even; one scan states all slices."""
    orders = read(spark, d, "orders")
    ends = orders.agg(F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high")).first()
    counts = [(r["at"], r["n"]) for r in tables.range_histogram(orders, "o_custkey", ends.low, ends.high).collect()]
    made = tables.balanced_predicates(counts, "o_custkey", ends.low, ends.high, SLICES, spread_by="o_orderkey")
    fits = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(made)]))
    sliced = orders.select(F.size(fits).alias("fits"), F.explode(fits).alias("slice")).groupBy("fits", "slice").agg(F.count(F.lit(1)).alias("n"))
    return sliced.groupBy("fits").agg(F.sum("n").alias("n"), (F.max("n") * SLICES <= 2 * F.sum("n")).alias("even"))


QUERIES = {f.__name__: f for f in (labelled_matrix_scan, csv_batch_append, balanced_slices)}

_FEW, _TEXT = "l_orderkey % 97 = 0", "l_orderkey % 89 = 0"

SQL = {
    "labelled_matrix_scan": f"""SELECT CASE WHEN NOT {_FEW} THEN l_quantity END AS x0, CASE WHEN NOT {_FEW} AND NOT {_TEXT} THEN l_extendedprice END AS x1,
  CASE WHEN NOT {_FEW} AND l_discount <> 0 THEN l_discount END AS x2, CASE WHEN NOT {_FEW} THEN l_tax END AS x3,
  CASE WHEN NOT {_FEW} THEN l_linenumber END AS label, CASE WHEN {_FEW} THEN 'few fields' WHEN {_TEXT} THEN 'not a number'
  WHEN l_orderkey % 83 = 0 THEN 'many fields' END AS reason FROM lineitem""",
    "csv_batch_append": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders",
    "balanced_slices": "SELECT 1 AS fits, CAST(count(*) AS BIGINT) AS n, TRUE AS even FROM orders",
}
