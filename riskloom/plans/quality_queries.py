"""Registered data-quality jobs, table profile and SQL audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fv
from riskloom.functions.clean import iso_frame
from riskloom.operators import guarded_sql, plan_audit, profile, profile_parts, quality as q
from riskloom.plans import bindings as b
from riskloom.plans.registry import query
from riskloom.session import scratch_path

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def _row(check: str, passed: str, value: str, detail: str, source: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", {passed} AS passed, CAST({value} AS DOUBLE) AS value, "
        f"'{detail}' AS detail FROM {source}"
    )


def _union(*rows: str) -> str:
    return "\nUNION ALL ".join(rows)


@query("dq_row_counts", _union(
    _row("rows:companies", "count(*) > 0 AND count(*) < 1000", "count(*)", "row count", "companies"),
    _row("rows:industry_mapping", "count(*) = 25", "count(*)", "row count", "industry"),
    _row("rows:credit_events", "count(*) > 100", "count(*)", "row count", "credit_events"),
))
def dq_row_counts(spark, sf):
    return q.all_checks(
        q.row_count(b.companies(spark, sf), "companies", low=0, high=1000),
        q.row_count(b.industry(spark, sf), "industry_mapping", exact=25),
        q.row_count(b.credit_events(spark, sf), "credit_events", low=100),
    )


def _unique_sql(name: str, keys: str, source: str) -> str:
    return _row(f"unique:{name}", "count(*) = count(DISTINCT k)", "count(*) - count(DISTINCT k)", keys,
                f"(SELECT row({keys}) AS k FROM {source})")


@query("dq_unique", _union(
    _unique_sql("companies", "u3_company_number", "companies"),
    _unique_sql("industry_mapping", "industry_subgroup_num", "industry"),
    _unique_sql("sectors", "industry_sector_num", "industry"),
    _unique_sql("panel_file", "u3_company_number,year,month",
                "(SELECT floor(company_number / 1000) AS u3_company_number, year, month FROM panel_text)"),
))
def dq_unique(spark, sf):
    from riskloom.plans import loads

    return q.all_checks(
        q.unique_key(b.companies(spark, sf), "companies", ["u3_company_number"]),
        q.unique_key(b.industry(spark, sf), "industry_mapping", ["industry_subgroup_num"]),
        q.unique_key(b.industry(spark, sf), "sectors", ["industry_sector_num"]),
        q.unique_key(loads.panel_rows(b.panel_text(spark, sf)), "panel_file", loads.PANEL_KEY),
    )


def _fk_sql(name: str, key: str, child: str, parent: str) -> str:
    bad = f"count(*) FILTER (WHERE {key} NOT IN (SELECT {key} FROM {parent}))"
    return _row(f"fk:{name}", f"{bad} = 0", bad, key, child)


@query("dq_fk", _union(
    _fk_sql("credit_events", "u3_company_number", "credit_events", "companies"),
    _fk_sql("panel_file", "u3_company_number",
            "(SELECT floor(company_number / 1000) AS u3_company_number FROM panel_text)", "companies"),
    _fk_sql("companies", "industry_subgroup_num", "companies", "industry"),
))
def dq_fk(spark, sf):
    from riskloom.plans import loads

    companies = b.companies(spark, sf)
    return q.all_checks(
        q.foreign_key(b.credit_events(spark, sf), companies, "credit_events", "u3_company_number"),
        q.foreign_key(loads.panel_rows(b.panel_text(spark, sf)), companies, "panel_file", "u3_company_number"),
        q.foreign_key(companies, b.industry(spark, sf), "companies", "industry_subgroup_num"),
    )


@query("dq_coverage", _row(
    "coverage:companies", "count(DISTINCT c.industry_sector_num) > 0", "count(DISTINCT c.industry_sector_num)",
    "industry_sector_num", "sector_companies c JOIN industry i ON c.industry_sector_num = i.industry_sector_num",
))
def dq_coverage(spark, sf):
    return q.coverage(
        b.companies_in_sectors(spark, sf), b.industry(spark, sf), "companies", "industry_sector_num"
    )


def _rule_sql(kind: str, table: str, column: str, bad: str, detail: str, source: str) -> str:
    n = f"count(*) FILTER (WHERE {bad})"
    return _row(f"{kind}:{table}.{column}", f"{n} = 0", n, detail, source)


@query("dq_nulls", _union(*[
    _rule_sql("not_null", "credit_events", c, f"{c} IS NULL", "missing values", "undated")
    for c in ("id", "u3_company_number", "announcement_date", "subcategory")
]))
def dq_nulls(spark, sf):
    columns = ["id", "u3_company_number", "announcement_date", "subcategory"]
    return q.column_rules(b.undated_events(spark, sf), "credit_events", not_null=columns)


LIMITS = {"company_name": 200, "ticker": 30, "market_status": 9}


@query("dq_lengths", _union(*[
    _rule_sql("length", "companies", c, f"length({c}) > {n}", f"longer than {n}", "companies")
    for c, n in LIMITS.items()
]))
def dq_lengths(spark, sf):
    declared = fv.MAX_LENGTHS["companies"]
    limits = {c: declared[c] for c in ("company_name", "ticker")} | {"market_status": 9}
    return q.column_rules(b.companies(spark, sf), "companies", max_length=limits)


@query("dq_domain", _union(
    _rule_sql("domain", "companies", "market_status",
              "market_status NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')",
              "outside the domain", "companies"),
    _rule_sql("domain", "risk_indicators", "month", "month NOT BETWEEN 1 AND 12", "outside the domain", "risk_panel"),
))
def dq_domain(spark, sf):
    return q.all_checks(
        q.column_rules(b.companies(spark, sf), "companies",
                       domain={"market_status": F.col("market_status").isin(SEGMENTS)}),
        q.column_rules(b.risk_panel(spark, sf), "risk_indicators", domain={"month": F.col("month").between(1, 12)}),
    )


@query("dq_domain_violations", """
SELECT market_status, count(*) AS n_rows FROM companies
WHERE market_status NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') GROUP BY 1
""")
def dq_domain_violations(spark, sf):
    return q.domain_violations(b.companies(spark, sf), "market_status", F.col("market_status").isin(SEGMENTS))


@query("dq_min_distinct", _row(
    "distinct:credit_events", "count(DISTINCT action_name) >= 3", "count(DISTINCT action_name)", "action_name",
    "credit_events"))
def dq_min_distinct(spark, sf):
    return q.min_distinct(b.credit_events(spark, sf), "credit_events", "action_name", 3)


@query("dq_peak", _row("peak:macro_us", "max(purchase) > 30", "max(purchase)", "purchase",
                       "macro_wide WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'"))
def dq_peak(spark, sf):
    macro = b.macro_wide(spark, sf).filter(F.col("date").between("2024-01-08", "2024-01-21"))
    return q.peak_above(macro, "macro_us", "purchase", 30.0)


@query("dq_vector_width", _row(
    "width:embeddings", "count(*) FILTER (WHERE len(embedding) <> 64) = 0",
    "count(*) FILTER (WHERE len(embedding) <> 64)", "embedding", "embeddings"))
def dq_vector_width(spark, sf):
    return q.vector_width(b.table(spark, sf, "embeddings"), "embeddings", "embedding", 64)


def _dates_sql(name: str, column: str, year: int, source: str) -> str:
    return _row(
        f"dates:{name}", f"year(min({column})) >= {year} AND max({column}) <= DATE '2024-06-30'",
        f"date_diff('day', min({column}), max({column}))", column, source,
    )


@query("date_ranges", _union(
    _dates_sql("credit_events", "announcement_date", 1980, "credit_events"),
    _dates_sql("macro_us", "date", 1990, "macro_wide"),
))
def date_ranges(spark, sf):
    return q.all_checks(
        q.date_range(b.credit_events(spark, sf), "credit_events", "announcement_date", 1980, "2024-06-30"),
        q.date_range(b.macro_wide(spark, sf), "macro_us", "date", 1990, "2024-06-30"),
    )


def _profile_sql(table: str, source: str, columns: dict[str, str], key: str) -> str:
    return _union(*[
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, "
        f"{str(c == key).lower()} AS is_key, count(*) AS n_rows, count({c}) AS n_present, "
        f"count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS min_value, "
        f"CAST(max({c}) AS VARCHAR) AS max_value, max(length(CAST({c} AS VARCHAR))) AS max_width FROM {source}"
        for c, kind in columns.items()
    ])


@query("table_profile", _union(
    _profile_sql("companies", "companies", {
        "u3_company_number": "bigint", "company_name": "string", "ticker": "string",
        "market_status": "string", "industry_subgroup_num": "int",
    }, "u3_company_number"),
    _profile_sql("credit_events", "undated", {
        "id": "bigint", "u3_company_number": "bigint", "announcement_date": "date", "effective_date": "date",
        "event_type": "string", "action_name": "string", "subcategory": "string",
    }, "id"),
))
def table_profile(spark, sf):
    return profile.table_profile(
        {"companies": b.companies(spark, sf), "credit_events": b.undated_events(spark, sf)},
        {"companies": ["u3_company_number"], "credit_events": ["id"]},
        exact=True,
    )


_EVENT_COLUMNS = {
    "id": "bigint", "u3_company_number": "bigint", "announcement_date": "date", "effective_date": "date",
    "event_type": "string", "action_name": "string", "subcategory": "string", "effective_month": "string",
}


@query("profile_by_month", "SELECT * EXCLUDE (table_name, data_type, is_key, n_distinct), true AS estimate_holds FROM ("
       + _profile_sql("credit_events", "(SELECT *, strftime(effective_date, '%Y-%m') AS effective_month FROM undated)",
                      _EVENT_COLUMNS, "id") + ")")
def profile_by_month(spark, sf):
    """The last month arrives after the others; the profile of all is put together from states."""
    events = b.undated_events(spark, sf).withColumn("effective_month", F.date_format("effective_date", "yyyy-MM"))
    target = scratch_path(spark, "profile-states")
    last = events.agg(F.max("effective_month")).first()[0]
    for months in (events.where(F.col("effective_month") < last), events.where(F.col("effective_month") == last)):
        profile_parts.store_parts(months, "effective_month", target)
    united = profile_parts.united_profile(spark, target, "credit_events", events.schema, ["id"])
    exact = profile.table_profile({"credit_events": events}, exact=True).select("column_name", F.col("n_distinct").alias("exact"))
    holds = F.abs(F.col("n_distinct") - F.col("exact")) <= 4 * profile_parts.STANDARD_ERROR * F.col("exact")
    return united.join(exact, "column_name").withColumn("estimate_holds", holds).select(
        "column_name", "n_rows", "n_present", "min_value", "max_value", "max_width", "estimate_holds"
    )


# A query log: one SQL text per event, its form chosen by the kind of event.
_LOG = {
    "click": "SELECT * FROM companies WHERE id = {}",
    "error": "DELETE FROM companies WHERE id = {}",
    "purchase": "SELECT created_at FROM credit_events WHERE id = {}",
    "signup": "SELECT 1; DROP TABLE t{}",
    "view": "   ",
}


# The same with words that harm nothing and constructs that harm without such words.
_PLAN_LOG = {
    "click": "SELECT 'DROP TABLE t' AS t, created_at FROM companies WHERE id = {}",
    "error": "DELETE FROM companies WHERE id = {}",
    "purchase": "WITH a AS (SELECT * FROM credit_events) SELECT count(*) FROM a /* UPDATE */ WHERE id = {} -- ALTER",
    "signup": "SELECT * FROM parquet.`/x` WHERE id = {}",
    "view": "SELECT reflect('java.lang.Math', 'abs', {})",
}


def _query_log(spark, sf, forms=_LOG):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    text = F.lit(None)
    for k, form in forms.items():
        before, _, after = form.partition("{}")
        whole = F.concat(F.lit(before), number, F.lit(after)) if "{}" in form else F.lit(form)
        text = F.when(kind == k, whole).otherwise(text)
    return b.table(spark, sf, "events").select("event_id", text.alias("sql"))


_LOG_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN " + (f"'{form.partition('{}')[0]}' || event_id" if "{}" in form else f"'{form}'")
    for k, form in _LOG.items()
) + " END"


@query("sql_audit", f"""
SELECT event_id, {_LOG_SQL} AS sql, event_type IN ('click', 'purchase') AS is_safe,
       CASE event_type WHEN 'error' THEN 'Only SELECT queries allowed, got: DELETE'
            WHEN 'signup' THEN 'Only SELECT queries allowed, got: DROP'
            WHEN 'view' THEN 'Empty SQL query' END AS error,
       CASE event_type WHEN 'error' THEN 'Only SELECT queries allowed, got: DELETE'
            WHEN 'signup' THEN 'Only SELECT queries allowed, got: DROP'
            WHEN 'purchase' THEN 'Dangerous keyword detected: CREATE'
            WHEN 'view' THEN 'Empty SQL query' END AS substring_error
FROM events
""")
def sql_audit(spark, sf):
    log = guarded_sql.audit_sql(_query_log(spark, sf), "sql")
    return log.withColumn("substring_error", guarded_sql.sql_error(F.col("sql"), "substring"))


@query("sql_plan_audit", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'Not a query: DeleteFromTable'
            WHEN 'signup' THEN 'Table not allowed: parquet./x'
            WHEN 'view' THEN 'Function not allowed: reflect' END AS plan_error
FROM events
""")
def sql_plan_audit(spark, sf):
    log = _query_log(spark, sf, _PLAN_LOG)
    return plan_audit.audit_plans(log, "sql", ["companies", "credit_events"]).select("event_id", "plan_error")


@query("sql_strip_fences", """
SELECT event_id, 'SELECT ' || event_id || ' AS n' AS sql FROM events
""")
def sql_strip_fences(spark, sf):
    core = F.concat(F.lit("SELECT "), F.col("event_id").cast("string"), F.lit(" AS n"))
    kind = F.col("event_type")
    fenced = (
        F.when(kind == "click", F.concat(F.lit("```sql\n"), core, F.lit("\n```")))
        .when(kind == "view", F.concat(F.lit("```\n"), core, F.lit("\n```\n")))
        .when(kind == "error", F.concat(F.lit("  "), core, F.lit("\n\n")))
        .otherwise(core)
    )
    return b.table(spark, sf, "events").select("event_id", guarded_sql.strip_fences(fenced).alias("sql"))
