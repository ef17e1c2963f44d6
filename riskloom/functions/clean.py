"""Cleaning expressions: Column -> Column, all evaluated inside Spark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Date spellings accepted besides ISO, each with its outline; month comes before day. A
# format is tried only where the outline fits, as a failed parse costs far more.
DATE_FORMATS = {
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
}

_ISO_DATE = (
    r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?)?)?$"
)


# Everything that counts as white space in Unicode, not only the space character.
_WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(col: Column) -> Column:
    """Text without white space at either end."""
    return F.trim(col, F.lit(_WHITE_SPACE))


def clean_blank(col: Column) -> Column:
    """Blank text becomes NULL; any other text stays as it is, spaces included."""
    return F.when(strip(col) != "", col)


def clean_nan(col: Column) -> Column:
    """NaN becomes NULL."""
    return F.nullif(col, F.lit(float("nan")))


def clean_na(col: Column, ignore_case: bool = True) -> Column:
    """Blank, ``NA`` and ``N/A`` become NULL."""
    key = strip(col)
    if ignore_case:
        key = F.upper(key)
    return F.when(~key.isin("", "NA", "N/A"), col)


def clean_na_frame(df: DataFrame, ignore_case: bool = True) -> DataFrame:
    """``clean_na`` over every text column, in one projection."""
    return df.select(
        *[
            clean_na(F.col(f.name), ignore_case).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def to_double(col: Column) -> Column:
    """Text to double; NA tokens, dates, other text and NaN become NULL.

    The usual tokens are taken out first, since a failed cast costs far more. The cast
    itself passes over outer spaces, tabs and line breaks.
    """
    return clean_nan(F.when(~F.upper(F.trim(col)).isin("", "NA", "N/A"), col).try_cast("double"))


def is_rejected_number(col: Column, ignore_case: bool = True) -> Column:
    """True where text is present, is no NA token, and still is not a number."""
    return clean_na(col, ignore_case).isNotNull() & to_double(col).isNull()


def to_int(col: Column) -> Column:
    """Text such as ``10`` or ``10.0`` to int; anything else becomes NULL."""
    number = col.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def required_int(col: Column, name: str) -> Column:
    """As ``to_int``, but a missing or malformed value fails the job."""
    value = to_int(col)
    problem = F.concat(F.lit(f"{name}: integer required, got "), F.coalesce(col.cast("string"), F.lit("NULL")))
    return F.coalesce(value, F.raise_error(problem).cast("int"))


def to_date_lenient(col: Column, formats: Mapping[str, str] = DATE_FORMATS) -> Column:
    """Text to date by ISO form first, then a fixed list of formats; otherwise NULL."""
    text = strip(col)
    return F.coalesce(
        F.when(text.rlike(_ISO_DATE), text.try_cast("date")),
        *[F.when(text.rlike(outline), F.try_to_date(text, f)) for f, outline in formats.items()],
    )


def quarter_end(col: Column) -> Column:
    """``Q3 2008`` to the last day of that quarter; text after the year is ignored."""
    text = strip(col)
    pattern = r"^Q([1-4])\s+(\d{4})"
    quarter = F.regexp_extract(text, pattern, 1).try_cast("int")
    year = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(text.rlike(pattern), F.last_day(F.make_date(year, quarter * 3, F.lit(1))))


def period_date(col: Column) -> Column:
    """A date cell that may hold a quarter instead of a date."""
    return F.when(strip(col).startswith("Q"), quarter_end(col)).otherwise(to_date_lenient(col))


def yyyymmdd_to_date(col: Column) -> Column:
    """An eight-digit number (also ``20080915.0``) to date; anything else becomes NULL."""
    digits = F.regexp_replace(strip(col.cast("string")), r"\.0*$", "")
    # Most impossible dates fail the outline, which is far cheaper than a failed parse.
    return F.when(digits.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"), F.try_to_date(digits, "yyyyMMdd"))


def company_key(company_number: Column) -> Column:
    """Company key of a panel row: the number without its last three digits; NULL beyond int."""
    return F.floor(company_number / 1000).try_cast("int")


def label_or_na(col: Column) -> Column:
    """``N/A`` for a missing or empty label."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("N/A"))


def decode(col: Column, names: dict) -> Column:
    """Replace a code by its name; unknown codes become NULL."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)


def match_series(name: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    """Field of the first pattern contained in ``name``, upper and lower case alike.

    One CASE expression: no join is needed, so nothing is shuffled or broadcast.
    """
    lowered = F.lower(name)
    return F.coalesce(*[F.when(lowered.contains(p.lower()), F.lit(f)) for p, f in patterns])


def iso_text(col: Column, data_type: T.DataType) -> Column:
    """ISO 8601 text of a date or timestamp; microseconds are shown only if present."""
    text = col.cast("string")
    if isinstance(data_type, T.DateType):
        return text
    text = F.replace(text, F.lit(" "), F.lit("T"))
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def iso_frame(df: DataFrame) -> DataFrame:
    """Replace every temporal column by its ISO text."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            iso_text(F.col(f.name), f.dataType).alias(f.name)
            if isinstance(f.dataType, temporal)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def normalize_headers(df: DataFrame) -> DataFrame:
    """Lower-case the column names and put ``_`` for spaces."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
