"""Fixture views over the driver's TPC-H-like tables.

``ratings`` / ``pairs`` / ``items`` map the reference's train, test and catalogue files onto
``lineitem``, ``orders`` and ``part``.  The SQL text is kept once, with ``{table}`` slots:
Spark fills them with DataFrames (``spark.sql(..., lineitem=df)``), the DuckDB oracle with the
plain view names, so both engines run the very same statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RATINGS_SQL = """
SELECT o_custkey AS user_id, l_partkey AS item_id,
       CAST(max(floor((l_quantity - 1) / 5)) AS INT) + 1 AS score
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_partkey
"""

# 1/16 of the users go to test entirely (cold users); 3/16 of the other users' rows go to test.
PAIRS_SQL = """
SELECT user_id, item_id, score,
       CASE WHEN substring(md5(concat('u', CAST(user_id AS STRING))), 1, 1) = '0' THEN 'test'
            WHEN substring(md5(concat(CAST(user_id AS STRING), '_', CAST(item_id AS STRING))), 1, 1) IN ('1','2','3') THEN 'test'
            ELSE 'train' END AS split
FROM {ratings}
"""

ITEMS_SQL = """
WITH s AS (
  SELECT l_partkey, count(*) AS members,
         count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS watching,
         count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS completed,
         count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS on_hold,
         count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS dropped,
         count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS plan_to_watch,
         min(l_shipdate) AS d0, max(l_shipdate) AS d1
  FROM {lineitem} GROUP BY l_partkey), f AS (
  SELECT s.*,
    concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(d0) AS INT) * 3 - 2, 3), ' ',
           CAST(day(d0) AS STRING), ', ', CAST(year(d0) AS STRING)) AS t0,
    concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(d1) AS INT) * 3 - 2, 3), ' ',
           CAST(day(d1) AS STRING), ', ', CAST(year(d1) AS STRING)) AS t1
  FROM s)
SELECT p_partkey AS item_id, p_name AS name,
  concat(replace(p_name, ' ', ', '), ', ', p_type) AS genres,
  CASE WHEN p_partkey % 11 = 0 THEN 'Unknown'
       ELSE concat(p_brand, ', Brand#', CAST(p_partkey % 25 + 1 AS STRING)) END AS producers,
  CASE WHEN p_partkey % 13 = 0 THEN 'Unknown' ELSE p_brand END AS studios,
  CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE concat('Lic (', CAST(p_size % 7 AS STRING), ')') END AS licensors,
  p_type AS type, p_brand AS source,
  CASE p_size % 8 WHEN 0 THEN 'G - All Ages' WHEN 1 THEN 'PG - Children' WHEN 2 THEN 'R+ - Mild Nudity'
    WHEN 3 THEN 'PG-13 - Teens 13 or older' WHEN 4 THEN 'Rx - Hentai'
    WHEN 5 THEN 'R - 17+ (violence & profanity)' WHEN 6 THEN 'Unknown' ELSE 'not in map' END AS rating,
  CASE WHEN p_size % 10 = 0 THEN 'Unknown' ELSE CAST(p_size AS STRING) END AS episodes,
  CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), ' min. per ep.')
    WHEN 1 THEN concat('1 hr. ', CAST(p_size AS STRING), ' min.')
    WHEN 2 THEN concat(CAST(p_size % 3 + 1 AS STRING), ' hr.') ELSE 'Unknown' END AS duration,
  CASE WHEN p_partkey % 17 = 0 THEN 'Unknown' WHEN p_partkey % 17 = 1 THEN concat(t0, ' to ?')
    WHEN p_partkey % 17 = 2 THEN CAST(year(d0) AS STRING)
    WHEN p_partkey % 2 = 0 THEN t0 ELSE concat(t0, ' to ', t1) END AS aired,
  coalesce(members, 0) AS members, coalesce(watching, 0) AS watching, coalesce(completed, 0) AS completed,
  coalesce(on_hold, 0) AS on_hold, coalesce(dropped, 0) AS dropped, coalesce(plan_to_watch, 0) AS plan_to_watch
FROM {part} LEFT JOIN f ON p_partkey = l_partkey
"""

# The three views as a CTE prefix for DuckDB oracle statements (only base tables exist there).
ORACLE_CTES = (
    "ratings AS (" + RATINGS_SQL.format(lineitem="lineitem", orders="orders") + "),\n"
    "pairs AS (" + PAIRS_SQL.format(ratings="ratings") + "),\n"
    "items AS (" + ITEMS_SQL.format(lineitem="lineitem", part="part") + ")"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id BIGINT, item_id BIGINT, score INT`` with key ``(user_id, item_id)``."""
    return spark.sql(RATINGS_SQL, lineitem=table(spark, sf_dir, "lineitem"),
                     orders=table(spark, sf_dir, "orders"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ratings`` plus ``split`` in ``{'train', 'test'}``."""
    return spark.sql(PAIRS_SQL, ratings=ratings(spark, sf_dir))


def split_frame(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Rows of one split.  Test rows keep ``score`` only for evaluation; operators never read it."""
    return pairs(spark, sf_dir).where(f"split = '{split}'").drop("split")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item catalogue, one row per ``part``."""
    return spark.sql(ITEMS_SQL, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def oracle(body: str) -> str:
    """Prefix a DuckDB statement with the fixture views; ``body`` may add its own CTEs after a comma."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ORACLE_CTES + ",\n" + body[5:]
    return "WITH " + ORACLE_CTES + "\n" + body
