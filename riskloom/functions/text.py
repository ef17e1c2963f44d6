"""Text renderings of companies and credit events."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATOR = " | "


def _present(col: Column) -> Column:
    return F.nullif(col.cast("string"), F.lit(""))


def _labelled(label: str, col: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), col.cast("string"))


def _always(label: str, col: Column | None) -> Column:
    text = F.lit("") if col is None else F.coalesce(col.cast("string"), F.lit(""))
    return F.concat(F.lit(f"{label}: "), text)


def truncate(col: Column, width: int = 200) -> Column:
    """The first ``width`` characters."""
    return F.substring(col, 1, width)


def event_text(name: Column, action: Column, subcategory: Column, date: Column,
               sector: Column, country: Column) -> Column:
    """One line per event; parts that are NULL or empty are left out."""
    return F.concat_ws(
        SEPARATOR,
        _present(name),
        _present(action),
        truncate(_present(subcategory)),
        _labelled("Date", date),
        _labelled("Sector", _present(sector)),
        _labelled("Country", _present(country)),
    )


def event_text_labelled(event_type: Column, date: Column, company: Column,
                        rating: Column | None = None, description: Column | None = None) -> Column:
    """One line per event with every label shown, also where the value is missing."""
    return F.concat_ws(
        SEPARATOR,
        _always("Event Type", event_type),
        _always("Date", date),
        _always("Company", company),
        _always("Rating", rating),
        _always("Description", description),
    )


def company_text(name: Column, ticker: Column, industry: Column, sector: Column,
                 description: Column | None = None, revenue: Column | None = None,
                 market_cap: Column | None = None) -> Column:
    """One line per company; revenue and market value appear only where known."""
    parts = [
        _always("Company", name),
        _always("Ticker", ticker),
        _always("Industry", industry),
        _always("Sector", sector),
        _always("Description", description),
    ]
    for label, col in (("Revenue", revenue), ("Market Cap", market_cap)):
        if col is not None:
            parts.append(_labelled(label, col))
    return F.concat_ws(SEPARATOR, *parts)
