import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import quality as q
from riskloom.plans import reports as r


@pytest.fixture(scope="module")
def tables(spark):
    companies = spark.createDataFrame(
        [(1, "A", "TA", 11, 1), (2, "B", None, 12, 1), (3, "C", "TC", 21, 2), (4, "D", "TD", None, None)],
        "u3_company_number int, company_name string, ticker string, industry_subgroup_num int, industry_sector_num int",
    )
    industry = spark.createDataFrame(
        [(11, 1, "Energy"), (12, 1, "Energy"), (13, 1, "Energy"), (21, 2, "Tech")],
        "industry_subgroup_num int, industry_sector_num int, industry_sector string",
    )
    rows = [
        (1, 1, "2008-01-31", "Default"), (2, 1, None, "Default"), (3, 2, "2008-12-31", "Default"),
        (4, 2, "2009-01-01", "Default"), (5, 3, "2008-06-01", "Delisting"), (6, 99, "2009-05-01", "Default"),
        (7, 1, "2007-12-31", "Delisting"),
    ]
    events = spark.createDataFrame(rows, "id int, u3_company_number int, d string, action_name string").select(
        "id", "u3_company_number", F.col("d").cast("date").alias("announcement_date"),
        F.lit(None).cast("date").alias("effective_date"), "action_name", F.lit("s").alias("subcategory"),
    )
    panel = spark.createDataFrame(
        [(1, 2008, 1, 2.0), (1, 2008, 2, 4.0), (2, 2008, 1, None), (3, 2008, 1, 0.5), (1, 2007, 1, -9.0)],
        "u3_company_number int, year int, month int, dtd double",
    )
    return companies, industry, events, panel


def rows(df):
    return [tuple(x) for x in df.collect()]


def test_top_companies_break_ties_by_key_and_skip_orphans(tables):
    companies, _, events, _ = tables
    assert rows(r.top_companies(companies, events, "Default")) == [(1, 2, "A", "TA"), (2, 2, "B", None)]


def test_recent_events_put_undated_first(tables):
    companies, _, events, _ = tables
    assert [x["id"] for x in r.recent_events(companies, events, "Default").collect()] == [2, 4, 3, 1]
    assert [x["id"] for x in r.company_events(companies, events, 1, 2).collect()] == [2, 1]
    latest = {(x["u3_company_number"], x["rank"]): x["id"] for x in r.latest_per_company(events, 1).collect()}
    assert latest == {(1, 1): 2, (2, 1): 4, (3, 1): 5, (99, 1): 6}


def test_year_and_month_counts(tables):
    _, _, events, _ = tables
    assert rows(r.count_events_in_year(events, 2008)) == [(3,)]
    by_year = r.events_by_year(events, "Default")
    assert rows(by_year) == [(2008, 2), (2009, 2), (None, 1)]
    assert rows(r.last_groups(by_year, "year", 2)) == [(2009, 2), (None, 1)]
    assert rows(r.events_by_month(events, "Default", "2008-01-31", "2008-12-31")) == [(2008, 1, 1), (2008, 12, 1)]
    assert sorted(rows(r.action_counts(events)), key=str) == [
        ("count", "Default", 5), ("count", "Delisting", 2), ("distinct", None, 2),
    ]


def test_sector_join_fans_out_on_the_sector_key_only(tables):
    companies, industry, events, _ = tables
    by_subgroup = r.sector_companies(companies, industry, events, "%energy%")
    assert [(x[0], x["event_count"]) for x in by_subgroup.collect()] == [(1, 3), (2, 2)]
    by_sector = r.sector_companies(companies, industry, events, "%energy%", by_subgroup=False)
    assert [(x[0], x["event_count"]) for x in by_sector.collect()] == [(1, 9), (2, 6)]


def test_sector_risk_orders_missing_averages_last(tables):
    companies, industry, _, panel = tables
    for scale in (None, 2):
        got = rows(r.sector_risk(companies, industry, panel, "Energy", 2008, scale=scale))
        assert got == [(1, "A", "TA", 3.0, 2.0), (2, "B", None, None, None)]


def test_recent_by_date(tables):
    companies, industry, events, _ = tables
    got = r.sector_recent(companies, industry, events, "Energy", days=365)
    assert [x["id"] for x in got.collect()] == [4, 3]
    given = r.sector_recent(companies, industry, events, "Energy", days=30, as_of=F.lit(dt.date(2008, 2, 1)))
    assert [x["id"] for x in given.collect()] == [1]
    assert rows(r.companies_with_recent(companies, events, "Default")) == [(2, "B", None)]


def test_series(spark):
    macro = spark.createDataFrame(
        [("2008-09-14", 25.0), ("2008-09-15", 31.7), ("2008-09-16", None), ("2008-09-17", 36.3)], "d string, vix double"
    ).select(F.col("d").cast("date").alias("date"), "vix")
    assert [x["value"] for x in r.series_window(macro, "vix", "2008-09-15", "2008-09-17").collect()] == [31.7, 36.3]
    assert rows(r.series_window_stats(macro, "vix", "2008-09-15", "2008-09-17", 30, scale=1)) == [(2, 36.3, 34.0, True)]
    assert rows(r.series_on_date(macro, "2008-09-16")) == [(dt.date(2008, 9, 16), None)]
    assert rows(r.series_window_stats(macro, "vix", "1999-01-01", "1999-01-02", 30, scale=1)) == [(0, None, None, None)]


def test_quality_checks(tables):
    companies, industry, events, panel = tables
    got = {x["check"]: (x["passed"], x["value"]) for x in q.all_checks(
        q.row_count(companies, "companies", low=3, high=5),
        q.row_count(industry, "industry", exact=64),
        q.unique_key(industry, "sector", ["industry_sector_num"]),
        q.unique_key(panel, "panel", ["u3_company_number", "year", "month"]),
        q.foreign_key(events, companies, "events", "u3_company_number"),
        q.coverage(companies, industry, "sector", "industry_sector_num"),
        q.min_distinct(events, "action", "action_name", 3),
        q.date_range(events, "events", "announcement_date", 1980),
        q.date_range(events, "late", "announcement_date", 2008),
        q.peak_above(panel, "dtd", "dtd", 3.0),
        q.column_rules(companies, "companies", not_null=["ticker"], max_length={"company_name": 0},
                       domain={"u3_company_number": F.col("u3_company_number") < 4}),
    ).collect()}
    assert got == {
        "rows:companies": (True, 4.0), "rows:industry": (False, 4.0), "unique:sector": (False, 2.0),
        "unique:panel": (True, 0.0), "fk:events": (False, 1.0), "coverage:sector": (True, 2.0),
        "distinct:action": (False, 2.0), "dates:events": (True, 487.0), "dates:late": (False, 487.0),
        "peak:dtd": (True, 4.0), "not_null:companies.ticker": (False, 1.0),
        "length:companies.company_name": (False, 4.0), "domain:companies.u3_company_number": (False, 1.0),
    }


def test_checks_on_empty_tables(tables):
    companies, _, events, _ = tables
    none = events.limit(0)
    got = [(x["passed"], x["value"]) for x in q.all_checks(
        q.unique_key(none, "e", ["id"]), q.foreign_key(none, companies, "e", "u3_company_number"),
        q.date_range(none, "e", "announcement_date", 1980),
    ).collect()]
    assert got == [(True, 0.0), (True, 0.0), (False, None)]
    vectors = none.sparkSession.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    assert q.vector_width(vectors, "v", "v", 2).first()["value"] == 2.0
