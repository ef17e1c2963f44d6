"""From raw sheets to typed tables."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom import schemas
from riskloom.functions import clean, fixed_values as fv
from riskloom.operators import integrity, ranking, reshape
from riskloom.sources import sheets, sinks

log = logging.getLogger(__name__)


def _maybe(raw: DataFrame, name: str) -> Column:
    """A column that the sheet may lack."""
    return F.col(name) if name in raw.columns else F.lit(None).cast("string")


def industry_mapping(raw: DataFrame) -> DataFrame:
    table = raw.select(
        clean.clean_blank(_maybe(raw, "industry_sector")).alias("industry_sector"),
        clean.to_int(_maybe(raw, "industry_sector_num")).alias("industry_sector_num"),
        clean.clean_blank(_maybe(raw, "industry_group")).alias("industry_group"),
        clean.to_int(_maybe(raw, "industry_group_num")).alias("industry_group_num"),
        clean.clean_blank(_maybe(raw, "industry_subgroup")).alias("industry_subgroup"),
        clean.to_int(_maybe(raw, "industry_subgroup_num")).alias("industry_subgroup_num"),
    )
    return sinks.conform(ranking.content_ids(table), schemas.INDUSTRY_MAPPING)


def companies(raw: DataFrame) -> DataFrame:
    whole = ["id_bb_company", "industry_sector_num", "industry_group_num", "industry_subgroup_num"]
    text = [
        "id_bb_unique", "ticker", "company_name", "country_name", "security_type",
        "market_status", "prime_exchange", "domicile", "id_isin", "id_cusip",
    ]
    table = raw.select(
        clean.required_int(F.col("u3_company_number"), "u3_company_number").alias("u3_company_number"),
        *[clean.clean_blank(_maybe(raw, c)).alias(c) for c in text],
        *[clean.to_int(_maybe(raw, c)).alias(c) for c in whole],
    )
    return sinks.conform(sinks.with_audit_columns(table, "created_at", "updated_at"), schemas.COMPANIES)


def credit_events(raw: DataFrame, known_companies: DataFrame | None = None) -> DataFrame:
    """Typed events; with ``known_companies`` events of other companies are left out."""
    table = raw.select(
        clean.required_int(F.col("u3_company_number"), "u3_company_number").alias("u3_company_number"),
        clean.to_int(_maybe(raw, "id_bb_company")).alias("id_bb_company"),
        clean.to_date_lenient(_maybe(raw, "announcement_date")).alias("announcement_date"),
        clean.to_date_lenient(_maybe(raw, "effective_date")).alias("effective_date"),
        clean.to_int(_maybe(raw, "event_type")).alias("event_type"),
        clean.clean_blank(_maybe(raw, "action_name")).alias("action_name"),
        clean.strip(clean.clean_blank(_maybe(raw, "subcategory"))).alias("subcategory"),
    )
    if known_companies is not None:
        table = integrity.keep_known(table, known_companies, "u3_company_number")
    return sinks.conform(
        sinks.with_audit_columns(ranking.content_ids(table), "created_at"), schemas.CREDIT_EVENTS
    )


def panel_rows(raw: DataFrame) -> DataFrame:
    """Typed panel rows with their company key; the file's own number stays beside it.

    Rows without a whole year or month are skipped.
    """
    number = clean.to_double(F.col("company_number"))
    rows = raw.select(
        number.try_cast("long").alias("company_number"),
        clean.company_key(number).alias("u3_company_number"),
        clean.to_int(F.col("year")).alias("year"),
        clean.to_int(F.col("month")).alias("month"),
        *[clean.to_double(F.col(m)).alias(m) for m in fv.PANEL_MEASURES],
    )
    return rows.filter(F.col("year").isNotNull() & F.col("month").isNotNull())


PANEL_KEY = ["u3_company_number", "year", "month"]


def one_row_per_month(rows: DataFrame) -> DataFrame:
    """Keep the row with the lowest company number per company and month.

    Rows equal in that number are ordered by their measures, so the choice never depends
    on the order of arrival. ``min`` combines before the shuffle.
    """
    others = ["company_number", *fv.PANEL_MEASURES]
    return rows.groupBy(*PANEL_KEY).agg(F.min(F.struct(*others)).alias("r")).select(
        *PANEL_KEY, *[F.col(f"r.{c}").alias(c) for c in others]
    )


def risk_panel(raw: DataFrame, known_companies: DataFrame) -> DataFrame:
    """The cleaned panel of the known companies, unique by company and month.

    Duplicates go first: that aggregation already spreads a company over its months, and
    the semi-join then meets far fewer rows of a hot company.
    """
    rows = one_row_per_month(panel_rows(raw))
    return integrity.keep_known(rows, known_companies, "u3_company_number")


def panel_summary(raw: DataFrame, known_companies: DataFrame) -> DataFrame:
    """One row about a panel file: lines read and kept, and lines rejected by reason.

    A line without a whole year or month is skipped; of the others, those of unknown
    companies are, and those that repeat a company month. ``n_bad_numbers`` counts lines
    kept or not with a measure that is neither a number nor a known blank; it becomes
    NULL. Lines are counted per company month before the join.
    """
    number = clean.to_double(F.col("company_number"))
    bad = F.lit(False)
    for measure in fv.PANEL_MEASURES:
        bad = bad | F.coalesce(clean.is_rejected_number(F.col(measure)), F.lit(False))
    per_month = raw.groupBy(
        clean.company_key(number).alias("u3_company_number"),
        clean.to_int(F.col("year")).alias("year"), clean.to_int(F.col("month")).alias("month"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    known = known_companies.select(F.col("u3_company_number").alias("_known")).distinct()
    judged = per_month.join(known, F.col("u3_company_number") == F.col("_known"), "left")
    dated = F.col("year").isNotNull() & F.col("month").isNotNull()
    kept = dated & F.col("_known").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return judged.agg(
        total("n").alias("n_read"),
        F.count_if(kept).alias("n_kept"),
        total(F.when(~dated, F.col("n"))).alias("n_without_month"),
        total(F.when(dated & F.col("_known").isNull(), F.col("n"))).alias("n_unknown_company"),
        total(F.when(kept, F.col("n") - 1)).alias("n_repeated"),
        total("bad").alias("n_bad_numbers"),
    )


def panel_rejects(raw: DataFrame, known_companies: DataFrame) -> DataFrame:
    """Companies of the panel file that are unknown, with their number of rows."""
    keys = raw.select(clean.company_key(clean.to_double(F.col("company_number"))).alias("u3_company_number"))
    return integrity.reject_counts(keys, known_companies, "u3_company_number")


def commodities(sheet: DataFrame) -> DataFrame:
    names = [c for c in sheet.columns if c != sheets.ROW]
    date = clean.to_date_lenient(F.col(f"`{names[0]}`"))
    cells = reshape.unpivot_sheet(
        sheet.select(*[F.col(f"`{c}`") for c in names], sheets.ROW),
        date, [None, *names[1:]], fv.COMMODITY_SERIES, sheets.ROW,
    )
    return reshape.long_to_wide(cells, [f for _, f in fv.COMMODITY_SERIES], keep="first")


def bond_yields(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean.to_date_lenient(F.col("data_date")).alias("data_date"),
        *[
            clean.to_double(_maybe(raw, heading)).alias(field)
            for heading, field in fv.YIELD_COLUMNS.items()
        ],
    ).filter(F.col("data_date").isNotNull())


US_MACRO_FIELDS = list(dict.fromkeys(f for _, f in fv.US_MACRO_SERIES))


def us_macros(sheet: DataFrame) -> DataFrame:
    names = [c for c in sheet.columns if c != sheets.ROW]
    cells = reshape.unpair_sheet(sheet, names, fv.US_MACRO_SERIES, sheets.ROW)
    return reshape.long_to_wide(cells, US_MACRO_FIELDS, keep="last", since="1990-01-01")


def fx_rates(matrix: DataFrame, headings: list[str | None]) -> DataFrame:
    return reshape.select_matrix(matrix, headings, fv.FX_PAIRS, matrix.columns[0])


# Sheet file of each table, in load order: companies before what refers to them.
SHEET_FILES = {
    "industry_mapping": "industry_mapping.csv",
    "companies": "companies.csv",
    "credit_events": "credit_events.csv",
    "macro_commodities": "commodities.csv",
    "macro_bond_yields": "bond_yields.csv",
    "macro_us": "us_macros.csv",
    "macro_fx": "fx_rates.csv",
    "risk_indicators": "risk_indicators.csv",
}


def _known_companies(spark: SparkSession, path: str) -> DataFrame | None:
    """The loaded companies, or None where none are."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _plan(spark: SparkSession, table: str, path: str, companies_path: str) -> DataFrame:
    if table == "industry_mapping":
        return industry_mapping(sheets.read_sheet(spark, path))
    if table == "companies":
        return companies(sheets.read_sheet(spark, path))
    if table == "credit_events":
        return credit_events(sheets.read_sheet(spark, path), _known_companies(spark, companies_path))
    if table == "macro_commodities":
        return commodities(sheets.read_numbered_sheet(spark, path))
    if table == "macro_bond_yields":
        return bond_yields(sheets.read_sheet(spark, path))
    if table == "macro_us":
        return us_macros(sheets.read_numbered_sheet(spark, path))
    if table == "macro_fx":
        return fx_rates(*sheets.read_matrix(spark, path))
    known = spark.read.parquet(companies_path)
    panel = risk_panel(sheets.read_panel_csv(spark, path), known)
    return sinks.conform(_numbered_panel(panel), schemas.RISK_INDICATORS)


def _numbered_panel(panel: DataFrame) -> DataFrame:
    """Dense ids in the order of year, month and company; a slice is a span of companies."""
    slices = {c: F.col(c) for c in ("_year", "_month")}
    slices["_span"] = F.floor(F.col("u3_company_number") / 1_000_000.0)
    keyed = panel.withColumns({"_year": F.col("year"), "_month": F.col("month")})
    numbered = ranking.number_rows(keyed, [], slices, [F.col("u3_company_number").asc()], name="_position")
    return numbered.withColumn("id", F.col("_position") + 1)


_LAYOUT = {
    "risk_indicators": {"partition_by": ["year"], "sort_by": ["u3_company_number", "month"]},
    "credit_events": {"cluster_by": ["u3_company_number", "announcement_date", "id"]},
    "companies": {"cluster_by": ["u3_company_number"]},
    "macro_commodities": {"sort_by": ["date"]},
    "macro_us": {"sort_by": ["date"]},
}


def _wanted(only: Iterable[str] | None) -> list[str]:
    wanted = set(SHEET_FILES if only is None else only)
    if unknown := wanted - set(SHEET_FILES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return [t for t in SHEET_FILES if t in wanted]


def load_all(spark: SparkSession, source: str, target: str, only: Iterable[str] | None = None,
             companies_path: str | None = None) -> DataFrame:
    """Load all tables (or some) in order of dependence; gives ``(table_name, n_rows)``.

    Events and panel rows of companies that are not loaded are left out (``quarantine``
    lists them). A missing or broken input stops the load; tables written before it stay,
    see ``refresh_all``. ``companies_path`` is where companies lie if not in ``target``.
    """
    stats = []
    for table in _wanted(only):
        started = time.monotonic()
        plan = _plan(spark, table, f"{source}/{SHEET_FILES[table]}", companies_path or f"{target}/companies")
        rows = sinks.write_table(plan, f"{target}/{table}", **_LAYOUT.get(table, {}))
        log.info("%s: %d rows in %.2f s", table, rows, time.monotonic() - started)
        stats.append((table, rows))
    return spark.createDataFrame(stats, "table_name string, n_rows long")


def refresh_all(spark: SparkSession, source: str, root: str, only: Iterable[str] | None = None) -> DataFrame:
    """Load into a new version below ``root`` and make it the valid one when all is written.

    Gives ``(table_name, n_rows, seconds, path)``. Tables not in ``only`` stay those of the
    version before. If any table fails, readers go on seeing the old version of all of
    them; what was written is left in a folder that no version names.
    """
    before = sinks.published(spark, root)
    folder = f"{root}/version-{uuid.uuid4().hex}"
    known = f"{folder}/companies" if "companies" in _wanted(only) else before.get("companies", f"{folder}/companies")
    stats = []
    for table in _wanted(only):
        started = time.monotonic()
        rows = load_all(spark, source, folder, [table], known).first()["n_rows"]
        stats.append((table, rows, time.monotonic() - started, f"{folder}/{table}"))
    sinks.publish(spark, root, before | {table: path for table, _, _, path in stats})
    return spark.createDataFrame(stats, "table_name string, n_rows long, seconds double, path string")


def open_current(spark: SparkSession, root: str, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the valid version by name."""
    paths = sinks.published(spark, root)
    return {
        name: spark.read.schema(schemas.TABLES[name]).parquet(paths[name])
        for name in (paths if only is None else only)
    }


def open_tables(spark: SparkSession, target: str, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The loaded tables by name, ready for reports or guarded SQL."""
    return {
        name: spark.read.schema(schemas.TABLES[name]).parquet(f"{target}/{name}")
        for name in (SHEET_FILES if only is None else only)
    }
