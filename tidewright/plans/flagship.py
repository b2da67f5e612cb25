"""The flagship: payloads of JSON parsed, coerced and summarised by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.ingest import typed_rows
from tidewright.operators.state import summarize
from tidewright.plans.registry import query, table


@query(
    "flagship",
    """
    WITH o AS (SELECT o_orderpriority AS priority, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 9),
    r AS (SELECT priority, v, row_number() OVER (PARTITION BY priority ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY priority) AS n FROM o)
    SELECT priority, max(n) AS n, min(v) AS min, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN v END) AS p50,
      max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN v END) AS p95, round(avg(v), 6) AS mean, max(v) AS max FROM r GROUP BY priority
    """,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order records whose price is a number or a text; summaries by priority."""
    k = F.col("o_orderkey")
    price = F.when(k % 10 == 9, F.lit("none").cast("variant")).when(k % 2 == 0, F.col("o_totalprice").cast("string").cast("variant")).otherwise(F.col("o_totalprice").cast("variant"))
    record = F.to_variant_object(F.create_map(F.lit("_id"), k.cast("variant"), F.lit("totalPrice"), price, F.lit("Priority"), F.col("o_orderpriority").cast("variant")))
    rows = typed_rows(table(spark, sf_dir, "orders").select(record.alias("record")), {"game_id": "int64", "total_price": "float64", "priority": "string"}, "jp")
    out = summarize(rows, "priority", "total_price")  # prices that are none are left out there
    return out.withColumn("mean", F.round("mean", 6))
