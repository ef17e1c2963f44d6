"""Declared schemas of the target tables and of the raw inputs."""

from __future__ import annotations

from pyspark.sql import types as T

from riskloom.functions import fixed_values as fv


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_int, _str, _dbl, _date = T.IntegerType(), T.StringType(), T.DoubleType(), T.DateType()
_ts = T.TimestampNTZType()

INDUSTRY_MAPPING = _struct(
    id=T.LongType(),
    industry_sector=_str, industry_sector_num=_int,
    industry_group=_str, industry_group_num=_int,
    industry_subgroup=_str, industry_subgroup_num=_int,
)

COMPANIES = _struct(
    u3_company_number=_int, id_bb_unique=_str, id_bb_company=_int, ticker=_str,
    company_name=_str, country_name=_str, security_type=_str, market_status=_str,
    prime_exchange=_str, domicile=_str, industry_sector_num=_int,
    industry_group_num=_int, industry_subgroup_num=_int, id_isin=_str, id_cusip=_str,
    created_at=_ts, updated_at=_ts,
)

CREDIT_EVENTS = _struct(
    id=T.LongType(), u3_company_number=_int, id_bb_company=_int,
    announcement_date=_date, effective_date=_date, event_type=_int, action_name=_str,
    subcategory=_str, created_at=_ts,
)

RISK_INDICATORS = _struct(
    id=T.LongType(), u3_company_number=_int, year=_int, month=_int,
    **{m: _dbl for m in fv.PANEL_MEASURES},
)

MACRO_COMMODITIES = _struct(date=_date, **{f: _dbl for _, f in fv.COMMODITY_SERIES})
MACRO_BOND_YIELDS = _struct(data_date=_date, **{f: _dbl for f in fv.YIELD_COLUMNS.values()})
MACRO_US = _struct(date=_date, **{f: _dbl for _, f in fv.US_MACRO_SERIES})
MACRO_FX = _struct(date=_date, **{f: _dbl for f in fv.FX_PAIRS})

CREDIT_EVENT_EMBEDDINGS = _struct(
    id=T.LongType(), credit_event_id=T.LongType(), embedding=T.ArrayType(T.FloatType()),
    text_content=_str, embedding_model=_str, created_at=_ts,
)

TABLES = {
    "industry_mapping": INDUSTRY_MAPPING,
    "companies": COMPANIES,
    "credit_events": CREDIT_EVENTS,
    "risk_indicators": RISK_INDICATORS,
    "macro_commodities": MACRO_COMMODITIES,
    "macro_bond_yields": MACRO_BOND_YIELDS,
    "macro_us": MACRO_US,
    "macro_fx": MACRO_FX,
    "credit_event_embeddings": CREDIT_EVENT_EMBEDDINGS,
}

# Fields of the raw panel file, in the order of ``fixed_values.PANEL_HEADINGS``.
PANEL_FIELDS = ["company_number", "year", "month", *fv.PANEL_MEASURES]


def panel_layout(headings: list[str]) -> list[str]:
    """Field of each column of a panel file by its heading.

    The n-th column of a repeated heading is the n-th field of that name. Columns with
    other headings get names of their own and are not used.
    """
    waiting: dict[str, list[str]] = {}
    for heading, field in zip(fv.PANEL_HEADINGS, PANEL_FIELDS):
        waiting.setdefault(heading.lower(), []).append(field)
    fields = []
    for place, heading in enumerate(headings):
        same = waiting.get(heading.strip().lower())
        fields.append(same.pop(0) if same else f"_other{place}")
    absent = {"company_number", "year", "month"} - set(fields)
    if absent:
        raise ValueError(f"panel file without {', '.join(sorted(absent))}: {headings}")
    return fields


def text_schema(names: list[str]) -> T.StructType:
    """Schema of a sheet exported as text: every column a string."""
    return T.StructType([T.StructField(n, _str) for n in names])


def missing_columns(table: str, columns: list[str]) -> list[str]:
    """Declared columns of ``table`` that are absent from ``columns``."""
    have = set(columns)
    return [n for n in TABLES[table].names if n not in have]
