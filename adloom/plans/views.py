"""Marketing-shaped views over the driver's test tables.

These are synthetic mappings, declared as such: the engine is schema-agnostic,
so we give it marketing-like input derived from the TPC-H-ish tables.  The same
SQL text runs in Spark (``spark.sql`` with DataFrame arguments) and in DuckDB
(table names substituted), so the oracle sees exactly the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Campaign names for ad_facts, indexed by user_id % 12 (a mapping of users to
# campaigns, not a filter: every event is used).
AD_FACTS_SQL = """
SELECT CAST(ts AS DATE) AS date,
       CASE user_id % 12
         WHEN 0 THEN 'US_Retargeting_Display'
         WHEN 1 THEN 'UK_RTG_Email'
         WHEN 2 THEN 'EU_RMKT_Social'
         WHEN 3 THEN 'FR_Bot_Scraper'
         WHEN 4 THEN 'US_Brand_Search'
         WHEN 5 THEN 'DE_Prospecting_Video'
         WHEN 6 THEN 'CA_BotNet_Display'
         WHEN 7 THEN 'JP_Launch_Social'
         WHEN 8 THEN 'AU_Newsletter_Email'
         WHEN 9 THEN 'BR_Generic_Search'
         WHEN 10 THEN 'IN_Awareness_Video'
         ELSE 'NL_Promo' END AS campaign_name,
       CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS impressions,
       CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
       CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS conversions,
       CAST(ROUND(SUM(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 2) AS DOUBLE) AS spend,
       CAST(COALESCE(MAX(CASE WHEN event_type = 'purchase' THEN value END), 0) AS DOUBLE) AS price,
       CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS quantity
FROM {events}
GROUP BY CAST(ts AS DATE), user_id % 12
"""

# Row-level facts, one row per lineitem (all lineitem columns kept, so the full
# row is unique and serves as the declared total order after the date).
SALES_FACTS_SQL = """
SELECT l.l_shipdate AS date,
       concat(p.p_brand, '_',
              CASE WHEN l.l_returnflag = 'R' THEN 'Retargeting_' ELSE '' END,
              p.p_type, '_',
              CASE p.p_size % 6 WHEN 0 THEN 'Search' WHEN 1 THEN 'Display' WHEN 2 THEN 'Social'
                                WHEN 3 THEN 'Email' WHEN 4 THEN 'Video' ELSE 'Print' END) AS campaign_name,
       CAST(p.p_size * 100 AS BIGINT) AS impressions,
       CAST((l.l_partkey * 7 + l.l_orderkey) % 300 AS BIGINT) AS clicks,
       CAST(l.l_orderkey % 11 AS BIGINT) AS conversions,
       l.l_extendedprice * l.l_discount AS spend,
       l.l_extendedprice AS price,
       l.l_quantity AS quantity,
       l.l_orderkey, l.l_partkey, l.l_suppkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber,
       l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
"""

# Orders with missing values and duplicate rows injected by value rules.
DIRTY_ORDERS_SQL = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority
FROM {orders}
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority
FROM {orders}
WHERE o_orderpriority = '1-URGENT'
"""

# Orders as a text export: the date arrives as text and the amount under an alias.
ORDERS_TEXT_SQL = """
SELECT o_orderkey, CAST(o_orderdate AS STRING) AS order_date, o_totalprice AS amount, o_orderstatus
FROM {orders}
"""

# The sales rows with columns that features overwrite: their own values are wrong on purpose.
SALES_OVERWRITE_SQL = SALES_FACTS_SQL.replace("l.l_returnflag, l.l_linestatus", """l.l_returnflag, l.l_linestatus,
       9999.0 + l.l_linenumber AS revenue, 0.5 AS ctr, 'raw month' AS month, 'raw quarter' AS quarter""")

# The same sales with prices far below one.
SALES_TINY_SQL = SALES_FACTS_SQL.replace("l.l_extendedprice AS price", "l.l_extendedprice * 1e-15 AS price")

# Orders as a text export with day-first dates.
ORDERS_DAYFIRST_SQL = """
SELECT o_orderkey, concat(lpad(CAST(day(o_orderdate) AS VARCHAR(9)), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS VARCHAR(9)), 2, '0'), '/',
                          CAST(year(o_orderdate) AS VARCHAR(9))) AS order_date, o_orderstatus
FROM {orders}
"""

SMALL_RATES_SQL = """
SELECT CAST(l_linenumber * (l_partkey % 9) AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS rate, l_orderkey FROM {lineitem}
"""

ZERO_RATES_SQL = """
SELECT 0.0 * l_quantity AS conversion_rate, l_discount AS ctr, l_orderkey FROM {lineitem}
"""

LARGE_NUMBERS_SQL = """
SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * 100000.0 AS scaled FROM {orders}
"""

SPARSE_ORDERS_SQL = """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS o_orderdate,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderdate END AS updated FROM {orders}
"""

EMPTY_COLUMNS_SQL = """
SELECT o_orderkey, CAST(NULL AS DOUBLE) AS nothing, CAST(NULL AS VARCHAR(9)) AS no_text FROM {orders}
"""

# Orders with an empty column, a half-empty one, many copies and a few huge amounts.
ODD_ORDERS_SQL = """
SELECT CAST(NULL AS DOUBLE) AS nothing, CASE WHEN o_orderkey % 4 = 0 THEN o_clerk_no END AS sometimes, o_orderstatus,
       CASE WHEN o_clerk_no % 97 = 5 THEN 1e6 ELSE 1.0 * (o_clerk_no % 7) END AS amount_paid
FROM (SELECT o_orderkey, o_orderstatus, o_custkey % 200 AS o_clerk_no FROM {orders}) o
"""

VIEWS = {
    "sales_overwrite": (SALES_OVERWRITE_SQL, ("lineitem", "part")),
    "sales_tiny": (SALES_TINY_SQL, ("lineitem", "part")),
    "orders_dayfirst": (ORDERS_DAYFIRST_SQL, ("orders",)),
    "small_rates": (SMALL_RATES_SQL, ("lineitem",)),
    "zero_rates": (ZERO_RATES_SQL, ("lineitem",)),
    "large_numbers": (LARGE_NUMBERS_SQL, ("orders",)),
    "sparse_orders": (SPARSE_ORDERS_SQL, ("orders",)),
    "empty_columns": (EMPTY_COLUMNS_SQL, ("orders",)),
    "odd_orders": (ODD_ORDERS_SQL, ("orders",)),
    "ad_facts": (AD_FACTS_SQL, ("events",)),
    "sales_facts": (SALES_FACTS_SQL, ("lineitem", "part")),
    "dirty_orders": (DIRTY_ORDERS_SQL, ("orders",)),
    "orders_text": (ORDERS_TEXT_SQL, ("orders",)),
}

# Declared total order after the date, per view (all raw columns).
SALES_ORDER = ["date", "campaign_name", "impressions", "clicks", "conversions", "spend", "price",
               "quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount",
               "l_tax", "l_returnflag", "l_linestatus"]
AD_ORDER = ["date", "campaign_name", "impressions", "clicks", "conversions", "spend", "price",
            "quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Paths, sizes and times of the files a view reads: a change of the source shows here."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for source in VIEWS[name][1]:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{source}.parquet")
        fs = root.getFileSystem(hadoop)
        for f in fs.listStatus(root):
            state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (sf_dir, *sorted(state))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, sources = VIEWS[name]
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def view_sql(name: str) -> str:
    """The view as DuckDB SQL over the pre-registered tables."""
    sql, sources = VIEWS[name]
    return sql.format(**{s: s for s in sources})
