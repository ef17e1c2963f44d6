"""Registered reports: joins, aggregates, rankings."""

from __future__ import annotations

from riskloom.functions.clean import iso_frame
from riskloom.operators import guarded_sql
from riskloom.plans import bindings as b, reports as r
from riskloom.plans.registry import query

URGENT = "1-URGENT"


@query("top_defaults", """
SELECT u3_company_number, company_name, ticker, count(*) AS n_events
FROM companies JOIN credit_events USING (u3_company_number)
WHERE action_name = '1-URGENT' GROUP BY ALL
ORDER BY n_events DESC, u3_company_number LIMIT 10
""")
def top_defaults(spark, sf):
    return r.top_companies(b.companies(spark, sf), b.credit_events(spark, sf), URGENT)


@query("recent_events", """
SELECT id, company_name, ticker, CAST(announcement_date AS VARCHAR) AS announcement_date, subcategory
FROM undated JOIN companies USING (u3_company_number) WHERE action_name = '1-URGENT'
ORDER BY undated.announcement_date DESC NULLS FIRST, id LIMIT 50
""")
def recent_events(spark, sf):
    return iso_frame(r.recent_events(b.companies(spark, sf), b.undated_events(spark, sf), URGENT))


@query("company_events", """
SELECT id, action_name, subcategory, CAST(announcement_date AS VARCHAR) AS announcement_date,
       CAST(effective_date AS VARCHAR) AS effective_date, company_name, ticker
FROM undated JOIN companies USING (u3_company_number) WHERE u3_company_number = 7
ORDER BY undated.announcement_date DESC NULLS FIRST, id LIMIT 10
""")
def company_events(spark, sf):
    return iso_frame(r.company_events(b.companies(spark, sf), b.undated_events(spark, sf), 7))


@query("latest_n_per_company", """
SELECT u3_company_number, id, CAST(announcement_date AS VARCHAR) AS announcement_date, action_name, rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY u3_company_number
        ORDER BY announcement_date DESC NULLS FIRST, id) AS INTEGER) AS rank FROM undated)
WHERE rank <= 3
""")
def latest_n_per_company(spark, sf):
    latest = r.latest_per_company(b.undated_events(spark, sf), 3)
    return iso_frame(latest.select("u3_company_number", "id", "announcement_date", "action_name", "rank"))


@query("events_in_year", """
SELECT count(*) AS event_count FROM credit_events
WHERE announcement_date >= DATE '1998-01-01' AND announcement_date < DATE '1999-01-01'
""")
def events_in_year(spark, sf):
    return r.count_events_in_year(b.credit_events(spark, sf), 1998)


BY_YEAR = """
SELECT CAST(year(announcement_date) AS INTEGER) AS year, count(*) AS n_events
FROM undated WHERE action_name = '1-URGENT' GROUP BY 1
"""


@query("events_by_year", BY_YEAR)
def events_by_year(spark, sf):
    return r.events_by_year(b.undated_events(spark, sf), URGENT)


@query("last_years", f"SELECT * FROM ({BY_YEAR}) ORDER BY year DESC NULLS FIRST LIMIT 3")
def last_years(spark, sf):
    return r.last_groups(r.events_by_year(b.undated_events(spark, sf), URGENT), "year", 3)


@query("events_by_month", """
SELECT CAST(year(announcement_date) AS INTEGER) AS year, CAST(month(announcement_date) AS INTEGER) AS month,
       count(*) AS n_events
FROM credit_events WHERE action_name = '1-URGENT'
  AND announcement_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1, 2
""")
def events_by_month(spark, sf):
    return r.events_by_month(b.credit_events(spark, sf), URGENT, "1997-01-01", "1998-12-31")


@query("status_distribution", """
SELECT market_status, count(*) AS n_companies FROM companies GROUP BY 1
""")
def status_distribution(spark, sf):
    return r.status_distribution(b.companies(spark, sf))


@query("distinct_actions", """
SELECT 'count' AS metric, action_name, count(*) AS n FROM credit_events GROUP BY action_name
UNION ALL SELECT 'distinct', NULL, count(DISTINCT action_name) FROM credit_events
""")
def distinct_actions(spark, sf):
    return r.action_counts(b.credit_events(spark, sf))


def _sector_sql(key: str) -> str:
    return f"""
SELECT c.u3_company_number, company_name, ticker, industry_sector, count(*) AS event_count
FROM sector_companies c JOIN industry i ON c.{key} = i.{key}
JOIN credit_events e ON c.u3_company_number = e.u3_company_number
WHERE industry_sector ILIKE '%asia%' GROUP BY ALL
ORDER BY event_count DESC, c.u3_company_number LIMIT 10
"""


@query("sector_events", _sector_sql("industry_subgroup_num"))
def sector_events(spark, sf):
    return r.sector_companies(
        b.companies(spark, sf), b.industry(spark, sf), b.credit_events(spark, sf), "%asia%"
    )


@query("sector_events_fanout", _sector_sql("industry_sector_num"))
def sector_events_fanout(spark, sf):
    return r.sector_companies(
        b.companies_in_sectors(spark, sf), b.industry(spark, sf), b.credit_events(spark, sf), "%asia%",
        by_subgroup=False,
    )


@query("sector_risk", """
SELECT u3_company_number, company_name, ticker,
       CAST(sum(CAST(round(dtd * 100) AS BIGINT)) AS DOUBLE) / (count(dtd) * 100) AS avg_dtd, min(dtd) AS min_dtd
FROM risk_panel JOIN sector_companies c USING (u3_company_number)
JOIN industry i ON c.industry_sector_num = i.industry_sector_num
WHERE industry_sector = 'ASIA' AND year = 1998 GROUP BY 1, 2, 3
ORDER BY avg_dtd ASC NULLS LAST, u3_company_number LIMIT 50
""")
def sector_risk(spark, sf):
    return r.sector_risk(
        b.companies_in_sectors(spark, sf), b.industry(spark, sf), b.risk_panel(spark, sf), "ASIA", 1998,
        scale=2,
    )


@query("sector_recent", """
SELECT id, u3_company_number, company_name, ticker, action_name,
       CAST(announcement_date AS VARCHAR) AS announcement_date
FROM credit_events e JOIN companies c USING (u3_company_number) JOIN industry USING (industry_subgroup_num)
WHERE industry_sector = 'ASIA'
  AND e.announcement_date > (SELECT max(announcement_date) FROM credit_events) - 365
ORDER BY e.announcement_date DESC NULLS FIRST, id LIMIT 50
""")
def sector_recent(spark, sf):
    return iso_frame(r.sector_recent(
        b.companies(spark, sf), b.industry(spark, sf), b.credit_events(spark, sf), "ASIA"
    ))


@query("companies_recent", """
SELECT DISTINCT u3_company_number, company_name, ticker
FROM credit_events JOIN companies USING (u3_company_number)
WHERE action_name = '1-URGENT'
  AND announcement_date > (SELECT max(announcement_date) FROM credit_events) - 365
""")
def companies_recent(spark, sf):
    return r.companies_with_recent(b.companies(spark, sf), b.credit_events(spark, sf), URGENT)


@query("series_window", """
SELECT CAST(date AS VARCHAR) AS date, purchase AS value FROM macro_wide
WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' AND purchase IS NOT NULL
""")
def series_window(spark, sf):
    return iso_frame(r.series_window(b.macro_wide(spark, sf), "purchase", "2024-01-08", "2024-01-21"))


@query("series_window_stats", """
SELECT count(*) AS n_days, max(purchase) AS peak,
       CAST(sum(CAST(round(purchase * 100) AS BIGINT)) AS DOUBLE) / (count(purchase) * 100) AS average,
       max(purchase) > 30 AS above
FROM macro_wide WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' AND purchase IS NOT NULL
""")
def series_window_stats(spark, sf):
    return r.series_window_stats(
        b.macro_wide(spark, sf), "purchase", "2024-01-08", "2024-01-21", 30.0, scale=2
    )


@query("series_on_date", """
SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM macro_wide WHERE date = DATE '2024-01-15' LIMIT 1
""")
def series_on_date(spark, sf):
    return iso_frame(r.series_on_date(b.macro_wide(spark, sf), "2024-01-15"))


@query("table_counts", """
SELECT 'companies' AS table_name, count(*) AS n_rows FROM companies
UNION ALL SELECT 'industry_mapping', count(*) FROM industry
UNION ALL SELECT 'credit_events', count(*) FROM credit_events
UNION ALL SELECT 'risk_indicators', count(*) FROM risk_panel
UNION ALL SELECT 'macro_us', count(*) FROM macro_wide
""")
def table_counts(spark, sf):
    return r.table_counts({
        "companies": b.companies(spark, sf),
        "industry_mapping": b.industry(spark, sf),
        "credit_events": b.credit_events(spark, sf),
        "risk_indicators": b.risk_panel(spark, sf),
        "macro_us": b.macro_wide(spark, sf),
    })


@query("date_spans", """
SELECT 'credit_events' AS table_name, strftime(min(announcement_date), '%Y-%m-%d') AS first_date,
       strftime(max(announcement_date), '%Y-%m-%d') AS last_date FROM undated
UNION ALL SELECT 'macro_us', strftime(min(date), '%Y-%m-%d'), strftime(max(date), '%Y-%m-%d') FROM macro_wide
""")
def date_spans(spark, sf):
    return iso_frame(r.date_spans({
        "credit_events": (b.undated_events(spark, sf), "announcement_date"),
        "macro_us": (b.macro_wide(spark, sf), "date"),
    }))


@query("events_per_company", """
WITH numbered AS (
  SELECT u3_company_number, announcement_date, action_name, id,
         row_number() OVER (PARTITION BY u3_company_number ORDER BY announcement_date NULLS LAST, id) - 1 AS pos
  FROM undated
)
SELECT u3_company_number, CAST(pos // 10 AS BIGINT) AS page_no, count(*) AS n_events,
       string_agg(coalesce(CAST(announcement_date AS VARCHAR), 'undated') || ' ' || action_name || ' ' || id,
                  chr(10) ORDER BY pos) AS events
FROM numbered GROUP BY 1, 2
""")
def events_per_company(spark, sf):
    return r.nested_events(b.undated_events(spark, sf), page_size=10)


def _views(sf):
    return lambda own: {"companies": b.companies(own, sf), "credit_events": b.credit_events(own, sf)}


@query("capped_query", """
SELECT id, u3_company_number, strftime(announcement_date, '%Y-%m-%d') AS announcement_date, action_name
FROM credit_events ORDER BY id LIMIT 100
""")
def capped_query(spark, sf):
    sql = """```sql
SELECT id, u3_company_number, announcement_date, action_name FROM credit_events ORDER BY id;
```"""
    return guarded_sql.run_select(spark, sql, _views(sf))


WINDOW_SQL = """
SELECT month_start, n_events, n_events - lag(n_events) OVER (ORDER BY month_start) AS change
FROM (SELECT date_trunc('month', announcement_date) AS month_start, count(*) AS n_events
      FROM credit_events GROUP BY 1) AS monthly
"""


@query("k3_window", f"""
SELECT strftime(month_start, '%Y-%m') AS month, n_events, change FROM ({WINDOW_SQL})
ORDER BY month
""")
def k3_window(spark, sf):
    sql = f"SELECT date_format(month_start, 'yyyy-MM') AS month, n_events, change FROM ({WINDOW_SQL}) ORDER BY month"
    return guarded_sql.run_select(spark, sql, _views(sf), rows=None)


SETOPS_SQL = """
SELECT u3_company_number FROM companies WHERE market_status = 'BUILDING'
EXCEPT SELECT u3_company_number FROM credit_events WHERE action_name = '1-URGENT'
"""


@query("k3_setops", f"SELECT * FROM ({SETOPS_SQL}) ORDER BY u3_company_number")
def k3_setops(spark, sf):
    sql = f"SELECT * FROM ({SETOPS_SQL}) ORDER BY u3_company_number"
    return guarded_sql.run_select(spark, sql, _views(sf), rows=None)
