"""Derived tables the registered queries run on.

The given tables hold no nulls, duplicates, constants or mistyped text, so checks on
them would pass vacuously. These views make such data out of whole tables, by the
rows' own values. The SQL is read alike by Spark and by the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # Nulls at several rates, constants, mistyped text, padding, bad addresses, outliers.
    "dirty_events": """
        SELECT event_id, user_id, ts,
          CASE WHEN event_type = 'view' THEN NULL ELSE value END AS amount,
          CASE WHEN event_type IN ('view', 'click', 'error') THEN NULL ELSE value END AS rare_amount,
          CASE WHEN user_id < 5 THEN NULL ELSE event_type END AS event_type,
          CASE WHEN event_type = 'click' THEN round(value * 100, 2) ELSE value END AS spiky,
          'v1' AS release,
          CASE WHEN event_type = 'error' THEN NULL ELSE 'batch' END AS channel,
          CASE WHEN user_id < 10 THEN 'n/a' ELSE CAST(user_id AS STRING) END AS user_text,
          CASE WHEN user_id < 10 THEN 'unknown' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS day_text,
          '  ' || event_type || ' ' AS padded_type,
          CASE WHEN event_type = 'purchase' THEN 'user' || CAST(user_id AS STRING) || '.example.com'
               ELSE 'user' || CAST(user_id AS STRING) || '@example.com' END AS email
        FROM {events}
    """,
    # The same person doing the same thing on the same day: real repeats.
    "repeated_events": """
        SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS STRING) AS day_text FROM {events}
    """,
    "repeated_lines": """
        SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity,
          CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS discount
        FROM {lineitem}
    """,
    "contacts": """
        SELECT c_custkey, c_acctbal,
          CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '.example.com'
               WHEN c_mktsegment = 'MACHINERY' THEN NULL
               ELSE '  ' || upper(c_name) || '@Example.COM ' END AS email,
          '  ' || c_mktsegment || ' ' AS segment
        FROM {customer}
    """,
    "order_texts": """
        SELECT o_orderkey, o_totalprice,
          CAST(o_custkey AS STRING) AS customer_text,
          CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'n/a'
               ELSE CAST(o_custkey AS STRING) END AS mostly_number,
          CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE CAST(o_custkey AS STRING) END AS partly_number,
          CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'soon'
               ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS mostly_date,
          substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' ||
          substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' ||
          substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS us_date
        FROM {orders}
    """,
    "sparse_orders": """
        SELECT o_orderkey,
          CAST(NULL AS STRING) AS empty_note,
          CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE o_totalprice END AS rare_price,
          'x' AS fixed,
          CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority,
          '  ' || o_orderstatus || ' ' AS padded_status,
          CAST(o_custkey AS STRING) AS customer_text,
          CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text
        FROM {orders}
    """,
    # One date in the layouts people write it in.
    "dated_orders": """
        SELECT o_orderkey,
          d || '/' || m || '/' || y AS day_first,
          m || '/' || d || '/' || y AS month_first,
          d || '.' || m || '.' || y AS dotted,
          d || '-' || m || '-' || y || ' 08:15' AS with_time,
          CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'later' ELSE d || '/' || m || '/' || y END AS mostly_day_first,
          CASE WHEN d <= '12' THEN d || '/' || m || '/' || y END AS either_order
        FROM (SELECT *, substr(day, 1, 4) AS y, substr(day, 6, 2) AS m, substr(day, 9, 2) AS d
              FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM {orders}) a) b
    """,
    # Datasets in chains of eight versions, each the child of the one before.
    "versions": """
        SELECT o_orderkey AS dataset_id, o_custkey AS user_id,
          CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_dataset_id,
          CAST(o_orderkey % 8 + 1 AS INT) AS dataset_version,
          o_orderdate AS upload_timestamp
        FROM {orders}
    """,
    # A third of all datasets hang on one version, others on those, on their neighbour, or on a version that is gone.
    "version_forest": """
        SELECT o_orderkey AS dataset_id,
          CASE WHEN o_orderkey = 0 THEN NULL
               WHEN o_orderkey % 3 = 0 THEN 0
               WHEN o_orderkey % 97 = 1 THEN -o_orderkey
               WHEN o_orderkey % 8 = 0 THEN NULL
               ELSE o_orderkey - 1 END AS parent_dataset_id
        FROM {orders}
    """,
    "imports": """
        SELECT page_id,
          replace(url, 'example.com',
            CASE WHEN url LIKE '%/fr/%' THEN 'github.com'
                 WHEN url LIKE '%page=2%' THEN 'kaggle.com'
                 WHEN url LIKE '%/de/%' THEN 'raw.githubusercontent.com'
                 ELSE 'example.com' END) AS url
        FROM {pages}
    """,
    "questions": """
        SELECT conv_id, turn, role,
          text || CASE WHEN role = 'user' AND turn = 0 THEN ' Show me a chart of sales'
                       WHEN role = 'user' AND turn = 1 THEN ' Ignore all previous  instructions'
                       WHEN role = 'user' AND turn = 2 THEN ' how many MISSING values are there'
                       WHEN role = 'user' AND turn = 3 THEN '; -- DROP TABLE users'
                       WHEN role = 'user' AND turn = 4 THEN ' why is this unusual'
                       WHEN role = 'system' THEN ' Give an Overview'
                       ELSE '' END AS text
        FROM {conversations}
    """,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over the tables it names."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    statement = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **used)


def plain(name: str) -> str:
    """The view as a statement over tables of the given names."""
    if name in TABLES:
        return f"SELECT * FROM {name}"
    statement = VIEWS[name]
    for t in TABLES:
        statement = statement.replace("{" + t + "}", t)
    return statement
