from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import context, embedding


def test_event_text_drops_null_and_empty_parts(spark):
    df = spark.createDataFrame(
        [("Acme", "Default", "x" * 300, "2008-09-15", "Energy", "US"), (None, "", None, None, "", None),
         ("Acme", None, "", "2008-09-15", None, "")],
        "n string, a string, s string, d string, i string, c string",
    )
    got = [r[0] for r in df.select(text.event_text(
        F.col("n"), F.col("a"), F.col("s"), F.col("d").cast("date"), F.col("i"), F.col("c"))).collect()]
    assert got == [
        f"Acme | Default | {'x' * 200} | Date: 2008-09-15 | Sector: Energy | Country: US",
        "", "Acme | Date: 2008-09-15",
    ]


def test_labels_always_show(spark):
    df = spark.createDataFrame([(None, "T", 5.0), ("Acme", None, None)], "n string, t string, m double")
    got = [r[0] for r in df.select(text.company_text(
        F.col("n"), F.col("t"), F.lit("Oil"), F.lit(None), market_cap=F.col("m"))).collect()]
    assert got == [
        "Company:  | Ticker: T | Industry: Oil | Sector:  | Description:  | Market Cap: 5.0",
        "Company: Acme | Ticker:  | Industry: Oil | Sector:  | Description: ",
    ]
    labelled = df.select(text.event_text_labelled(F.lit("Default"), F.lit(None), F.col("n"))).first()[0]
    assert labelled == "Event Type: Default | Date:  | Company:  | Rating:  | Description: "


def _tables(spark):
    companies = spark.createDataFrame(
        [(1, "Acme", "AC", "Energy", ""), (2, "Bolt", None, None, "Oil")],
        "u3_company_number int, company_name string, ticker string, sector string, industry string",
    )
    events = spark.createDataFrame(
        [(i, 1, None if i == 3 else f"2008-01-0{i}", "Default") for i in (1, 2, 3)],
        "id int, u3_company_number int, d string, action_name string",
    ).select("id", "u3_company_number", F.col("d").cast("date").alias("announcement_date"), "action_name")
    return companies, events


def _event(day):
    return f"- Date: {day}\n  Type: Default\n  Company ID: 1"


OWN = "## Relevant Companies:\n\n- Acme (AC)\n  Sector: Energy\n  Industry: N/A"
HEAD = "\n## Relevant Credit Events:"


def test_company_context(spark):
    companies, events = _tables(spark)
    got = {r["u3_company_number"]: r["context"] for r in context.company_context(companies, events, 2).collect()}
    assert got == {
        1: "\n\n".join([OWN, HEAD, _event("None"), _event("2008-01-02")]),
        2: "## Relevant Companies:\n\n- Bolt (None)\n  Sector: N/A\n  Industry: Oil",
    }


def test_company_context_holds_all_events(spark):
    companies, events = _tables(spark)
    got = {(r[0], r[1]): r[3] for r in context.company_context(companies, events, page_size=2).collect()}
    assert got[1, 0] == "\n\n".join([OWN, HEAD, _event("None"), _event("2008-01-02")])
    assert got[1, 1] == "\n\n".join([HEAD, _event("2008-01-01")])
    assert set(got) == {(1, 0), (1, 1), (2, 0)}


def test_company_profile_pages_hold_all_events(spark):
    companies, events = _tables(spark)
    got = {(r[0], r[1]): (r[2], r[3]) for r in context.company_profile(companies, events, page_size=2).collect()}
    assert got == {
        (1, 0): (2, "\n\n".join([OWN, HEAD, _event("2008-01-01"), _event("2008-01-02")])),
        (1, 1): (1, "\n\n".join([HEAD, _event("None")])),
        (2, 0): (0, "## Relevant Companies:\n\n- Bolt (None)\n  Sector: N/A\n  Industry: Oil"),
    }
    assert context.company_profile(companies, events, company=7).count() == 0
    assert context.company_profile(companies, events, company=1).count() == 1


def test_optional_parts_and_empty_documents(spark):
    row = spark.range(1).select(
        context.company_block(F.lit("A"), F.lit("T"), F.lit("S"), F.lit("I"), F.lit("makes A")).alias("c"),
        context.event_block(F.lit("d"), F.lit("t"), F.lit(1), F.lit("BB"), F.lit("")).alias("e"),
        context.join_blocks(F.lit(""), F.lit("")).alias("none"),
        context.join_blocks(None, F.lit("x")).alias("events"),
    ).first()
    assert row["c"] == "- A (T)\n  Sector: S\n  Industry: I\n  Description: makes A"
    assert row["e"] == "- Date: d\n  Type: t\n  Company ID: 1\n  Rating: BB"
    assert row["none"] == "No relevant data found."
    assert row["events"] == "\n## Relevant Credit Events:\n\nx"


def test_embedding_batches_and_short_texts(spark):
    df = spark.createDataFrame(
        [(i, f"text number {i}") for i in range(250)] + [(900, "short"), (901, None)], "id int, text string"
    ).coalesce(1)
    sizes = spark.sparkContext.accumulator(0)

    def fn(texts):
        assert len(texts) <= 100
        sizes.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: r for r in embedding.embed_texts(df, fn, "toy").collect()}
    assert len(got) == 250 and sizes.value == 250
    assert got[7]["embedding"] == [13.0, 1.0] and got[7]["embedding_model"] == "toy"
    assert tuple(embedding.text_counters(df, "text").first()) == (250, 2, 252)


def test_embedding_resumes(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(5)], "id int, text string")
    first = embedding.embed_pending(df, df.limit(0), embedding.embed_by_hashing, limit=2)
    assert sorted(r["id"] for r in first.collect()) == [0, 1]
    rest = embedding.embed_pending(df, first, embedding.embed_by_hashing)
    rows = rest.collect()
    assert sorted(r["id"] for r in rows) == [2, 3, 4]
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-6 and len(r["embedding"]) == 1024 for r in rows)


def test_refresh_appends_only_what_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(5)] + [(9, "short")], "id int, text string")
    target = str(tmp_path / "vectors")

    def refresh(items, **options):
        return tuple(embedding.refresh_embeddings(items, target, embedding.embed_by_hashing, **options).first())

    assert refresh(df, limit=2) == (2, 0, 2)
    assert refresh(df) == (3, 1, 4)
    assert refresh(df) == (0, 1, 1)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]
    found = embedding.search_texts(spark.read.parquet(target), {1: "text number 3"}, embedding.embed_by_hashing, 1)
    assert found.first()["id"] == 3
