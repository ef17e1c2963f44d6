"""Context documents: companies and their events as text, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import clean
from riskloom.operators import ranking

# Fixed wording of the documents; the labels of the blocks below are fixed as well.
NOTHING_FOUND = "No relevant data found."
_COMPANIES = "## Relevant Companies:"
_EVENTS = "\n## Relevant Credit Events:"


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def company_block(name: Column, ticker: Column, sector: Column, industry: Column,
                  description: Column | None = None) -> Column:
    """The lines about one company."""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    parts = [
        F.concat(F.lit("- "), shown(name), F.lit(" ("), shown(ticker), F.lit(")")),
        F.concat(F.lit("  Sector: "), clean.label_or_na(sector)),
        F.concat(F.lit("  Industry: "), clean.label_or_na(industry)),
    ]
    if description is not None:
        parts.append(F.concat(F.lit("  Description: "), F.nullif(description, F.lit(""))))
    return _lines(*parts)


def event_block(date: Column, event_type: Column, company: Column,
                rating: Column | None = None, description: Column | None = None) -> Column:
    """The lines about one event."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    parts = [
        F.concat(F.lit("- Date: "), shown(date)),
        F.concat(F.lit("  Type: "), shown(event_type)),
        F.concat(F.lit("  Company ID: "), shown(company)),
    ]
    if rating is not None:
        parts.append(F.concat(F.lit("  Rating: "), F.nullif(rating, F.lit(""))))
    if description is not None:
        parts.append(F.concat(F.lit("  Description: "), F.nullif(description, F.lit(""))))
    return _lines(*parts)


def join_blocks(companies: Column | None, events: Column | None) -> Column:
    """The document made of the company blocks and the event blocks given."""
    parts = []
    if companies is not None:
        parts.append(F.when(companies != "", F.concat(F.lit(_COMPANIES + "\n\n"), companies)))
    if events is not None:
        parts.append(F.when(events != "", F.concat(F.lit(_EVENTS + "\n\n"), events)))
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.lit(NOTHING_FOUND))


def _in_order(position: str, text: str, glue: str) -> Column:
    """Texts joined in order of position; only used on groups of bounded size."""
    pairs = F.sort_array(F.collect_list(F.struct(position, text)))
    return F.array_join(F.transform(pairs, lambda p: p[text]), glue)


def latest_events(events: DataFrame, n: int) -> DataFrame:
    """The ``n`` latest events of every company; undated ones come first."""
    return ranking.top_k_per_group(
        events, ["u3_company_number"],
        [F.col("announcement_date").desc_nulls_first(), F.col("id").asc()], n,
    )


def company_context(companies: DataFrame, events: DataFrame, n_events: int | None = None,
                    page_size: int = 100) -> DataFrame:
    """Documents of companies: their own block and their events, the latest first.

    ``companies`` has ``sector`` and ``industry`` columns. With ``n_events`` only so many
    events of a company are shown, as one page of a question's context. Pages are as
    ``company_profile`` describes them, and companies without events keep their document.
    """
    if n_events is not None:
        events = latest_events(events, n_events)
        page_size = n_events
    return _pages(companies, events, page_size, latest_first=True)


def _numbered(events: DataFrame, latest_first: bool = False, id_span: int = 1_000_000) -> DataFrame:
    """Position of every event among those of its company, by date and id.

    Undated events come last in time, so they open a list of the latest ones. Days cut a company's events into slices, and spans of ids cut a day, so even one
    company that owns a third of all events, or one day of it, spreads over many tasks.
    """
    day = F.coalesce(F.unix_date("announcement_date"), F.lit(2**31 - 1))
    if latest_first:
        day = -day
    return ranking.number_rows(
        events, ["u3_company_number"],
        {"_day": day, "_span": F.floor(F.col("id") / float(id_span))},
        [F.col("id").asc()],
    )


def event_children(events: DataFrame, page_size: int = 100) -> DataFrame:
    """The events of every company as arrays of structs, in pages of bounded size."""
    numbered = _numbered(events).withColumn("page_no", F.floor(F.col("position") / page_size))
    child = F.struct("position", "id", "announcement_date", "action_name")
    fields = ["id", "announcement_date", "action_name"]
    return numbered.groupBy("u3_company_number", "page_no").agg(
        F.sort_array(F.collect_list(child)).alias("events")
    ).withColumn("events", F.transform("events", lambda e: F.struct(*[e[f].alias(f) for f in fields])))


def query_context(hits: DataFrame, companies: DataFrame, events: DataFrame, id_col: str = "id") -> DataFrame:
    """One document per question from the hits of a hybrid search, in order of rank.

    ``companies`` has ``sector`` and ``industry`` columns. A question has at most ``k``
    hits of a kind, so its document is bounded. Hits that no table knows are left out; a
    question without known hits says so.
    """
    wanted = hits.select("query_id", "entity", "rank", F.col(id_col).alias("_hit"))
    named = wanted.filter("entity = 'company'").join(companies, F.col("_hit") == F.col("u3_company_number")).select(
        "query_id", "entity", "rank",
        company_block(F.col("company_name"), F.col("ticker"), F.col("sector"), F.col("industry")).alias("block"),
    )
    dated = wanted.filter("entity = 'event'").join(events, F.col("_hit") == F.col("id")).select(
        "query_id", "entity", "rank",
        event_block(F.col("announcement_date"), F.col("action_name"), F.col("u3_company_number")).alias("block"),
    )
    blocks = named.unionByName(dated).groupBy("query_id").pivot("entity", ["company", "event"]).agg(
        _in_order("rank", "block", "\n\n")
    )
    return wanted.select("query_id").distinct().join(blocks, "query_id", "left").select(
        "query_id", join_blocks(F.coalesce("company", F.lit("")), F.coalesce("event", F.lit(""))).alias("context")
    )


def event_pages(events: DataFrame, line: Column, page_size: int = 100) -> DataFrame:
    """All events of every company as text lines, cut into pages of bounded size."""
    numbered = _numbered(events).select(
        "u3_company_number",
        F.floor(F.col("position") / page_size).alias("page_no"),
        "position",
        line.alias("line"),
    )
    return numbered.groupBy("u3_company_number", "page_no").agg(
        F.count(F.lit(1)).alias("n_events"),
        _in_order("position", "line", "\n").alias("events"),
    )


def company_profile(companies: DataFrame, events: DataFrame, company: int | None = None,
                    page_size: int = 100) -> DataFrame:
    """A company with all its events, as one or more pages of a document.

    Without ``company`` the profile of every company is built. An unknown company gives
    no row. The first page opens with the company block; pages have at most
    ``page_size`` events each. Pages are the left side of an inner join, which Spark can
    split where one company owns very many of them; companies without events come apart.
    """
    if company is not None:
        companies = companies.filter(F.col("u3_company_number") == company)
        events = events.filter(F.col("u3_company_number") == company)
    return _pages(companies, events, page_size)


def _pages(companies: DataFrame, events: DataFrame, page_size: int, latest_first: bool = False) -> DataFrame:
    block = event_block(F.col("announcement_date"), F.col("action_name"), F.col("u3_company_number"))
    numbered = _numbered(events, latest_first).select(
        "u3_company_number", F.floor(F.col("position") / page_size).alias("page_no"),
        "position", block.alias("block"),
    )
    pages = numbered.groupBy("u3_company_number", "page_no").agg(
        F.count(F.lit(1)).alias("n_events"), _in_order("position", "block", "\n\n").alias("event_blocks")
    )
    own = company_block(F.col("company_name"), F.col("ticker"), F.col("sector"), F.col("industry"))
    with_events = pages.join(companies, "u3_company_number").select(
        "u3_company_number", "page_no", "n_events",
        join_blocks(F.when(F.col("page_no") == 0, own).otherwise(F.lit("")), F.col("event_blocks")).alias("context"),
    )
    quiet = companies.join(events.select("u3_company_number").distinct(), "u3_company_number", "left_anti").select(
        "u3_company_number", F.lit(0).cast("long").alias("page_no"), F.lit(0).cast("long").alias("n_events"),
        join_blocks(own, F.lit("")).alias("context"),
    )
    return with_events.unionByName(quiet)
