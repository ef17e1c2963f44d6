"""Named reports over companies, industries, credit events, risk panel and macro series.

Tables come in with the columns of ``riskloom.schemas``. Wherever a report counts events
per company, events are counted before the join: the shuffle then carries one partial
count per company and task, and a company that owns a third of all events is one row.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators import context, ranking

KEY = "u3_company_number"


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def mean(col: Column, scale: int | None = None) -> Column:
    """Average; with ``scale`` values of that many decimals are added up as whole units,
    so the result does not depend on the order of summation."""
    if scale is None:
        return F.avg(col)
    units = F.sum(F.round(col * 10**scale).cast("long"))
    return F.try_divide(units.cast("double"), F.count(col) * 10**scale)


def events_in(events: DataFrame, first: str, last: str) -> DataFrame:
    """Events of a closed date range."""
    day = F.col("announcement_date")
    return events.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _newest_first() -> list[Column]:
    return [F.col("announcement_date").desc_nulls_first(), F.col("id").asc()]


def top_companies(companies: DataFrame, events: DataFrame, action: str, n: int = 10) -> DataFrame:
    """Companies with most events of one kind."""
    counts = events.filter(F.col("action_name") == action).groupBy(KEY).agg(_count("n_events"))
    named = counts.join(companies.select(KEY, "company_name", "ticker"), KEY)
    return ranking.top_k(named, [F.col("n_events").desc(), F.col(KEY).asc()], n)


def recent_events(companies: DataFrame, events: DataFrame, action: str, n: int = 50) -> DataFrame:
    """Latest events of one kind, with their companies."""
    found = events.filter(F.col("action_name") == action).join(
        companies.select(KEY, "company_name", "ticker"), KEY
    )
    return ranking.top_k(found, _newest_first(), n).select(
        "id", "company_name", "ticker", "announcement_date", "subcategory"
    )


def company_events(companies: DataFrame, events: DataFrame, company: int, n: int = 10) -> DataFrame:
    """Latest events of one company; the key filter reaches both scans."""
    found = events.filter(F.col(KEY) == company).join(companies.select(KEY, "company_name", "ticker"), KEY)
    return ranking.top_k(found, _newest_first(), n).select(
        "id", "action_name", "subcategory", "announcement_date", "effective_date", "company_name", "ticker"
    )


def latest_per_company(events: DataFrame, n: int = 10) -> DataFrame:
    """Latest events of every company."""
    return ranking.top_k_per_group(events, [KEY], _newest_first(), n)


def count_events_in_year(events: DataFrame, year: int) -> DataFrame:
    day = F.col("announcement_date")
    start, end = datetime.date(year, 1, 1), datetime.date(year + 1, 1, 1)
    return events.filter((day >= F.lit(start)) & (day < F.lit(end))).agg(_count("event_count"))


def events_by_year(events: DataFrame, action: str) -> DataFrame:
    """Events of one kind per year; undated ones form a group, listed last."""
    return (
        events.filter(F.col("action_name") == action)
        .groupBy(F.year("announcement_date").alias("year"))
        .agg(_count("n_events"))
        .orderBy(F.col("year").asc_nulls_last())
    )


def last_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` rows of a result ordered by ``key`` with NULL last."""
    kept = ranking.top_k(df, [F.col(key).desc_nulls_first()], n)
    return kept.orderBy(F.col(key).asc_nulls_last())


def events_by_month(events: DataFrame, action: str, first: str, last: str) -> DataFrame:
    """Events of one kind per month of a date range."""
    day = F.col("announcement_date")
    return (
        events_in(events.filter(F.col("action_name") == action), first, last)
        .groupBy(F.year(day).alias("year"), F.month(day).alias("month"))
        .agg(_count("n_events"))
        .orderBy("year", "month")
    )


def status_distribution(companies: DataFrame) -> DataFrame:
    return (
        companies.groupBy("market_status").agg(_count("n_companies"))
        .orderBy(F.col("n_companies").desc(), F.col("market_status").asc_nulls_last())
    )


def action_counts(events: DataFrame) -> DataFrame:
    """Events per kind, and a row ``distinct`` with the number of kinds."""
    per_kind = events.groupBy("action_name").agg(_count("n"))
    kinds = per_kind.agg(F.count("action_name").alias("n"))
    return per_kind.select(F.lit("count").alias("metric"), "action_name", "n").unionByName(
        kinds.select(F.lit("distinct").alias("metric"), F.lit(None).cast("string").alias("action_name"), "n")
    )


def sector_companies(companies: DataFrame, industry: DataFrame, events: DataFrame, pattern: str,
                     n: int = 10, by_subgroup: bool = True) -> DataFrame:
    """Companies of a sector with most events.

    ``by_subgroup`` joins on the unique subgroup key. Otherwise the join is on the sector
    key, which several mapping rows share, and counts are multiplied by their number, as
    a plain join would do; the factor is computed on the mapping, not by repeating events.
    """
    code = "industry_subgroup_num" if by_subgroup else "industry_sector_num"
    factor = (
        industry.filter(F.col("industry_sector").ilike(pattern))
        .groupBy(code, "industry_sector").agg(_count("n_mappings"))
    )
    members = companies.select(KEY, "company_name", "ticker", code).join(factor, code)
    counts = events.groupBy(KEY).agg(_count("n"))
    counted = members.join(counts, KEY).select(
        KEY, "company_name", "ticker", "industry_sector",
        (F.col("n") * F.col("n_mappings")).alias("event_count"),
    )
    order = [F.col("event_count").desc(), F.col(KEY).asc(), F.col("industry_sector").asc()]
    return ranking.top_k(counted, order, n)


def sector_risk(companies: DataFrame, industry: DataFrame, panel: DataFrame, sector: str, year: int,
                n: int = 50, scale: int | None = None) -> DataFrame:
    """Riskiest companies of a sector in a year: lowest average distance to default.

    Several mapping rows per sector would only repeat each company's rows evenly, which
    changes neither average nor minimum, so a semi-join stands in for the join.
    """
    of_sector = industry.filter(F.col("industry_sector") == sector).select("industry_sector_num")
    members = companies.select(KEY, "company_name", "ticker", "industry_sector_num").join(
        of_sector, "industry_sector_num", "left_semi"
    )
    dtd = F.col("dtd")
    yearly = panel.filter(F.col("year") == year).groupBy(KEY).agg(
        mean(dtd, scale).alias("avg_dtd"), F.min(dtd).alias("min_dtd")
    )
    ranked = yearly.join(members, KEY)
    return ranking.top_k(ranked, [F.col("avg_dtd").asc_nulls_last(), F.col(KEY).asc()], n).select(
        KEY, "company_name", "ticker", "avg_dtd", "min_dtd"
    )


def latest_date(events: DataFrame) -> Column:
    """The latest event date, as a scalar subquery that Spark evaluates once."""
    return events.agg(F.max("announcement_date")).scalar()


def sector_recent(companies: DataFrame, industry: DataFrame, events: DataFrame, sector: str,
                  days: int = 365, n: int = 50, as_of: Column | None = None) -> DataFrame:
    """Latest events of a sector within so many days before a date."""
    end = latest_date(events) if as_of is None else as_of
    of_sector = industry.filter(F.col("industry_sector") == sector).select("industry_subgroup_num")
    members = companies.select(KEY, "company_name", "ticker", "industry_subgroup_num").join(
        of_sector, "industry_subgroup_num", "left_semi"
    )
    day = F.col("announcement_date")
    recent = events.filter((day > F.date_sub(end, days)) & (day <= end))
    return ranking.top_k(recent.join(members, KEY), _newest_first(), n).select(
        "id", KEY, "company_name", "ticker", "action_name", "announcement_date"
    )


def companies_with_recent(companies: DataFrame, events: DataFrame, action: str, days: int = 365,
                          as_of: Column | None = None) -> DataFrame:
    """Companies with an event of one kind within so many days before a date."""
    end = latest_date(events) if as_of is None else as_of
    day = F.col("announcement_date")
    recent = events.filter((F.col("action_name") == action) & (day > F.date_sub(end, days)) & (day <= end))
    found = recent.select(KEY).distinct()
    return companies.select(KEY, "company_name", "ticker").join(found, KEY, "left_semi")


def series_window(macro: DataFrame, series: str, first: str, last: str, key: str = "date") -> DataFrame:
    """Present values of one series in a closed date range, in date order."""
    day = F.col(key)
    return (
        macro.filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col(series).isNotNull())
        .select(key, F.col(series).alias("value"))
        .orderBy(F.col(key).asc_nulls_last())
    )


def series_window_stats(macro: DataFrame, series: str, first: str, last: str, threshold: float,
                        key: str = "date", scale: int | None = None) -> DataFrame:
    """Size, peak and average of a series in a date range, and whether it passed a level."""
    value = F.col("value")
    return series_window(macro, series, first, last, key).agg(
        _count("n_days"),
        F.max(value).alias("peak"),
        mean(value, scale).alias("average"),
        (F.max(value) > threshold).alias("above"),
    )


def series_on_date(macro: DataFrame, day: str, key: str = "date") -> DataFrame:
    """All series on one date."""
    return macro.filter(F.col(key) == F.lit(day).cast("date")).limit(1)


def nested_events(events: DataFrame, page_size: int = 100) -> DataFrame:
    """The events of every company as nested rows, in pages of bounded size."""
    line = F.concat_ws(
        " ", F.coalesce(F.col("announcement_date").cast("string"), F.lit("undated")), "action_name",
        F.col("id").cast("string"),
    )
    return context.event_pages(events, line, page_size)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(
        DataFrame.unionByName,
        [df.agg(_count("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()],
    )


def date_spans(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last date of each table."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.min(c).alias("first_date"), F.max(c).alias("last_date"))
            .select(F.lit(t).alias("table_name"), "first_date", "last_date")
            for t, (df, c) in columns.items()
        ],
    )
