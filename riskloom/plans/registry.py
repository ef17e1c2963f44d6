"""Registry of named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The test tables as credit-research tables, as in ``bindings``.
PRELUDE = """
WITH companies AS (
  SELECT c_custkey AS u3_company_number, c_name AS company_name,
         'T' || CAST(c_custkey AS VARCHAR) AS ticker, c_mktsegment AS market_status,
         c_nationkey AS industry_subgroup_num
  FROM customer
), industry AS (
  SELECT n_nationkey AS industry_subgroup_num, n_name AS industry_subgroup,
         n_regionkey AS industry_sector_num, r_name AS industry_sector
  FROM nation JOIN region ON n_regionkey = r_regionkey
), sector_companies AS (
  SELECT c.*, i.industry_sector_num FROM companies c JOIN industry i USING (industry_subgroup_num)
), described AS (
  SELECT c.*, i.industry_sector AS sector, i.industry_subgroup AS industry
  FROM companies c LEFT JOIN industry i USING (industry_subgroup_num)
), credit_events AS (
  SELECT o_orderkey AS id, o_custkey AS u3_company_number,
         CAST(o_orderdate AS DATE) AS announcement_date,
         CAST(o_orderdate AS DATE) + 30 AS effective_date,
         o_orderstatus AS event_type, o_orderpriority AS action_name,
         CASE WHEN o_orderstatus = 'P' THEN ''
              WHEN o_orderstatus = 'F' THEN 'Total: ' || CAST(o_totalprice AS VARCHAR) END AS subcategory
  FROM orders
), undated AS (
  SELECT * REPLACE (CASE WHEN event_type <> 'P' THEN announcement_date END AS announcement_date)
  FROM credit_events
), risk_panel AS (
  SELECT o_custkey AS u3_company_number, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(month(o_orderdate) AS INTEGER) AS month, max(o_totalprice) AS dtd
  FROM orders GROUP BY 1, 2, 3
), panel_text AS (
  SELECT o_orderkey, (o_custkey + 25) * 1000 + o_orderkey % 1000 AS company_number,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN NULL
              ELSE o_totalprice END AS dtd,
         o_totalprice AS stk_index
  FROM orders
), macro_long AS (
  SELECT CAST(ts AS DATE) AS date, event_type AS series, event_id AS position,
         CASE WHEN CAST(round(value * 100) AS BIGINT) % 10 <> 0 THEN value END AS value
  FROM events
), macro_wide AS (
  SELECT CAST(ts AS DATE) AS date,
         max(value) FILTER (WHERE event_type = 'click') AS click,
         max(value) FILTER (WHERE event_type = 'error') AS error,
         max(value) FILTER (WHERE event_type = 'purchase') AS purchase,
         max(value) FILTER (WHERE event_type = 'signup') AS signup,
         max(value) FILTER (WHERE event_type = 'view') AS view
  FROM events GROUP BY 1
)"""


def query(name: str, sql: str | None = None, tables: bool = True):
    """Register a query; ``sql`` may use the tables of ``PRELUDE``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            if not tables:
                SQL[name] = text
            elif text.upper().startswith("WITH "):
                SQL[name] = PRELUDE.strip() + ",\n" + text[5:]
            else:
                SQL[name] = PRELUDE.strip() + "\n" + text
        return fn

    return add
