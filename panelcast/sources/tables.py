"""Readers for the parquet tables and the derived daily sales panel.

``daily_sales`` turns the order-line fact table into a keyed daily panel:
store = region of the supplier's nation, item = part type, one row per
(store, item, ship date) with the summed quantity.  Dimensions are joined by
key; only ``nation`` (25 rows by definition) carries an explicit broadcast
hint, ``part`` and ``supplier`` grow with the data and are left to the
planner/AQE, which broadcasts them only when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def daily_sales(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Keyed daily panel ``store INT, item STRING, date DATE, sales BIGINT``.

    ``shared=True`` returns a reliable checkpoint of the panel (written once
    to ``spark.checkpoint.dir``): for plans that reference the panel more than
    once (statistics joined back, densify), so the fact-table joins and the
    aggregation run once instead of once per reference."""
    if shared:
        from panelcast.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        return daily_sales(spark, sf_dir).checkpoint(eager=True)
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(F.broadcast(nat), F.col("s_nationkey") == nat.n_nationkey)
        .join(part, li.l_partkey == part.p_partkey)
    )
    return (
        joined.groupBy(
            F.col("n_regionkey").cast("int").alias("store"),
            F.col("p_type").alias("item"),
            F.to_date("l_shipdate").alias("date"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("sales"))
    )


DAILY_SALES_SQL = """daily_sales AS (
  SELECT CAST(n_regionkey AS INTEGER) AS store, p_type AS item,
         CAST(l_shipdate AS DATE) AS date,
         CAST(SUM(l_quantity) AS BIGINT) AS sales
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey
                JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)"""


def daily_sales_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from first to last date of each series; ``sales`` null where absent."""
    from panelcast.operators.relational import densify_daily

    return densify_daily(daily_sales(spark, sf_dir, shared=True), keys=["store", "item"], date_col="date")


DAILY_SALES_DENSE_SQL = """spine AS (
  SELECT store, item, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT store, item, MIN(date) AS lo, MAX(date) AS hi FROM daily_sales GROUP BY 1, 2)),
daily_sales_dense AS (
  SELECT sp.store, sp.item, sp.date, ds.sales
  FROM spine sp LEFT JOIN daily_sales ds
    ON ds.store = sp.store AND ds.item = sp.item AND ds.date = sp.date)"""


def with_sql(*ctes: str) -> str:
    """Join CTE definitions into one ``WITH`` prefix."""
    return "WITH " + ",\n".join(ctes) + "\n"
