import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import fixed_values as fv
from riskloom.operators import guarded_sql, profile
from riskloom.plans import loads
from riskloom.sources import sheets, sinks
from riskloom.streaming import panel_stream

PANEL_HEAD = ",".join(fv.PANEL_HEADINGS)


def panel_line(number, year, month, dtd="1.5", median="2.5", median_i="3.5"):
    return f"{number},{year},{month},100,0.01,1.1,0.2,{median},{median_i},{dtd},0.3,0.4,5.0,0.6"


@pytest.fixture
def source(tmp_path):
    files = {
        "industry_mapping.csv": "Industry Sector,Industry Sector Num,Industry Group,Industry Group Num,"
        "Industry Subgroup,Industry Subgroup Num\nEnergy,10.0,Oil,100,Integrated,1000\nEnergy,10,Oil,100,  ,1001\n",
        "companies.csv": "U3 Company Number,Company Name,Ticker,Market Status,Industry Sector Num\n"
        '26978,"Acme, ""The"" Co",ACME US,ACTV,10.0\n5,Bolt,  ,DLST,\n',
        "credit_events.csv": "U3 Company Number,Announcement Date,Event Type,Action Name,Subcategory\n"
        "26978,9/15/2008,110,Bankruptcy Filing,  Reason: x  \n5,soon,301.0,Default Corp Action,\n",
        "commodities.csv": "Dates,Generic WTI Crude,Gold spot,Other\n2008-09-15,95.7,NA,1\n2008-09-15,99,780,1\nbad,1,1,1\n",
        "bond_yields.csv": "Data Date,US Generic Govt 10 Year Yield\n2008-09-15,3.4\n,9\n2008-09-16,N/A\n",
        "us_macros.csv": "d1,VIX,d2,Real GDP\n2008-09-15,31.7,Q3 2008,14.5\n1980-01-01,9,Q1 1980,3\n",
        "fx_rates.csv": "t,,\n,AUDUSD Curncy,EURUSD Curncy\n20080915,0.8,1.4\nx,1,1\n",
        "risk_indicators.csv": "\n".join([
            PANEL_HEAD, panel_line(26978004, 2008, 9), panel_line(26978001, "2008.0", 9, dtd="NA"),
            panel_line(26978001, 2009, 1, "n/a"), panel_line(5000, 2008, 9), panel_line(777001, 2008, 9),
            panel_line(5000, "x", 9),
        ]) + "\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    return tmp_path


def test_load_all(spark, source, tmp_path):
    target = str(tmp_path / "tables")
    stats = {r[0]: r[1] for r in loads.load_all(spark, str(source), target).collect()}
    assert stats == {
        "industry_mapping": 2, "companies": 2, "credit_events": 2, "macro_commodities": 1, "macro_bond_yields": 2,
        "macro_us": 2, "macro_fx": 1, "risk_indicators": 3,
    }
    tables = {name: spark.read.parquet(f"{target}/{name}") for name in stats}
    for name, df in tables.items():
        assert schemas.missing_columns(name, df.columns) == []
        kinds = {f.name: f.dataType for f in schemas.TABLES[name].fields}
        assert all(kinds[f.name] == f.dataType for f in df.schema.fields), name

    acme = tables["companies"].filter("u3_company_number = 26978").first()
    assert acme["company_name"] == 'Acme, "The" Co' and acme["industry_sector_num"] == 10
    assert acme["id_isin"] is None and acme["created_at"] is not None
    assert tables["companies"].filter("ticker IS NULL").count() == 1
    assert tables["industry_mapping"].filter("industry_subgroup IS NULL").count() == 1
    events = {r["u3_company_number"]: r for r in tables["credit_events"].collect()}
    assert events[26978]["announcement_date"] == dt.date(2008, 9, 15)
    assert events[26978]["subcategory"] == "Reason: x"
    assert events[5]["announcement_date"] is None and events[5]["event_type"] == 301
    gold = tables["macro_commodities"].first()
    assert (gold["wti_crude"], gold["gold"], gold["corn"]) == (95.7, 780.0, None)
    assert {r["data_date"]: r["us_10y"] for r in tables["macro_bond_yields"].collect()} == {
        dt.date(2008, 9, 15): 3.4, dt.date(2008, 9, 16): None,
    }
    assert {r["date"]: (r["vix"], r["gdp"]) for r in tables["macro_us"].collect()} == {
        dt.date(2008, 9, 15): (31.7, None), dt.date(2008, 9, 30): (None, 14.5),
    }
    panel = {(r["u3_company_number"], r["year"], r["month"]): r for r in tables["risk_indicators"].collect()}
    assert set(panel) == {(26978, 2008, 9), (26978, 2009, 1), (5, 2008, 9)}
    first = panel[26978, 2008, 9]
    assert (first["dtd"], first["dtd_median"], first["dtd_median_i"]) == (None, 2.5, 3.5)

    opened = loads.open_tables(spark, target)
    one_year = opened["risk_indicators"].filter("year = 2009")
    assert one_year.count() == 1
    assert "(year#" in one_year._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    top = guarded_sql.run_select(spark, "SELECT action_name, announcement_date FROM credit_events ORDER BY 2", opened)
    assert [r[1] for r in top.collect()] == [None, "2008-09-15"]

    described = {(r["table_name"], r["column_name"]): r for r in profile.table_profile(tables).collect()}
    assert described["risk_indicators", "dtd"]["n_present"] == 1
    assert described["companies", "company_name"]["max_width"] == 14
    assert described["companies", "id_isin"]["n_distinct"] == 0
    counted = profile.table_profile(tables, exact=True).collect()
    assert {(r["table_name"], r["column_name"]): r for r in counted} == described


def test_selected_tables_and_missing_input(spark, source, tmp_path):
    target = str(tmp_path / "some")
    stats = loads.load_all(spark, str(source), target, only=["macro_fx"])
    assert [tuple(r) for r in stats.collect()] == [("macro_fx", 1)]
    (source / "bond_yields.csv").unlink()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        loads.load_all(spark, str(source), target)
    with pytest.raises(ValueError):
        loads.load_all(spark, str(source), target, only=["nothing"])


def test_required_key_stops_the_load(spark, source, tmp_path):
    (source / "companies.csv").write_text("U3 Company Number,Ticker\n,X\n")
    with pytest.raises(Exception, match="u3_company_number: integer required"):
        loads.load_all(spark, str(source), str(tmp_path / "t"), only=["companies"])


def test_events_of_unknown_companies_can_be_left_out(spark, source):
    raw = sheets.read_sheet(spark, str(source / "credit_events.csv"))
    known = spark.createDataFrame([(5,)], "u3_company_number int")
    assert [r["u3_company_number"] for r in loads.credit_events(raw, known).collect()] == [5]
    assert loads.credit_events(raw).count() == 2


def test_rejects_are_counted(spark, source):
    raw = sheets.read_panel_csv(spark, str(source / "risk_indicators.csv"))
    known = spark.createDataFrame([(26978,), (5,)], "u3_company_number int")
    assert [tuple(r) for r in loads.panel_rejects(raw, known).collect()] == [(777, 1)]
    summary = loads.panel_summary(raw, known).first().asDict()
    assert summary == {"n_read": 6, "n_kept": 3, "n_without_month": 1, "n_unknown_company": 1, "n_repeated": 1,
                       "n_bad_numbers": 0}
    assert set(loads.panel_summary(raw.limit(0), known).first()) == {0}


def test_positional_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,a\n1,2\n")
    df = sheets.read_sheet(spark, str(tmp_path / "s.csv"), columns=["x", "y"])
    assert df.first().asDict() == {"x": "1", "y": "2"}


def test_write_table_overwrites_and_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("year"))
    assert sinks.write_table(df, path, partition_by=["year"], sort_by=["id"]) == 100
    assert sinks.write_table(df.limit(5), path, partition_by=["year"]) == 5
    assert spark.read.parquet(path).count() == 5
    with_time = sinks.with_audit_columns(df, "created_at").schema["created_at"].dataType.simpleString()
    assert with_time == "timestamp_ntz"


@pytest.mark.parametrize("names", ["ab", "ba"])
def test_stream_holds_what_a_batch_load_would(spark, tmp_path, names):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), tmp_path / "progress"
    source.mkdir()
    known = spark.createDataFrame([(1,), (2,)], "u3_company_number int")
    files = {
        "a": [panel_line(1002, 2008, 1, "7"), panel_line(1001, 2008, 1, "5"), panel_line(9001, 2008, 1)],
        "b": [panel_line(1000, 2008, 1, "9"), panel_line(2000, 2008, 1, "NA"), panel_line(1000, 2009, 1, "3")],
    }

    def run(checkpoint=progress):
        panel_stream.stream_panel(spark, str(source), known, target, str(checkpoint)).awaitTermination()
        rows = panel_stream.stored_panel(spark, target).collect()
        return {(r["u3_company_number"], r["year"], r["month"]): r["dtd"] for r in rows}, len(rows)

    for name in names:
        (source / f"{name}.csv").write_text("\n".join([PANEL_HEAD, *files[name]]) + "\n")
        run()
    expected = {(1, 2008, 1): 9.0, (2, 2008, 1): None, (1, 2009, 1): 3.0}
    assert run() == (expected, 3)

    # A batch that is run again changes nothing, nor does a lost checkpoint.
    again = sheets.read_panel_csv(spark, str(source / "b.csv"))
    for _ in range(2):
        panel_stream.settle_batch(again, known, target)
    assert panel_stream.stored_panel(spark, target).count() == 3
    assert run(tmp_path / "restarted") == (expected, 3)
    # With a new checkpoint and only later files there, earlier months stay.
    later = tmp_path / "later"
    later.mkdir()
    (later / "c.csv").write_text("\n".join([PANEL_HEAD, panel_line(2001, 2010, 2, "4")]) + "\n")
    source = later
    assert run(tmp_path / "lost") == (expected | {(2, 2010, 2): 4.0}, 4)
    assert "Exchange" not in panel_stream.stored_panel(spark, target)._jdf.queryExecution().executedPlan().toString()
    assert {(r["year"], r["month"]) for r in panel_stream.stored_panel(spark, target, [2009, 2010]).collect()} == {(2009, 1), (2010, 2)}


def test_stream_writes_touched_months_only_and_whole_batches(spark, tmp_path):
    target, known = str(tmp_path / "out"), spark.createDataFrame([(1,)], "u3_company_number int")
    assert panel_stream.stored_panel(spark, target).collect() == []

    def batch(name, *lines):
        (tmp_path / f"{name}.csv").write_text("\n".join([PANEL_HEAD, *lines]) + "\n")
        return sheets.read_panel_csv(spark, str(tmp_path / f"{name}.csv"))

    panel_stream.settle_batch(batch("a", panel_line(1001, 2008, 1, "1"), panel_line(1001, 2008, 2, "2")), known, target)
    first = sinks.published(spark, target)
    panel_stream.settle_batch(batch("b", panel_line(1000, 2008, 2, "3")), known, target)
    second = sinks.published(spark, target)
    assert second["2008-1"] == first["2008-1"] and second["2008-2"] != first["2008-2"]
    panel_stream.settle_batch(batch("c", panel_line(9001, 2008, 2, "4")), known, target)  # nothing of a known company
    assert sinks.published(spark, target) == second
    broken = batch("d", panel_line(1000, 2008, 1, "9")).withColumn("dtd", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        panel_stream.settle_batch(broken, known, target)
    assert sorted((r["month"], r["dtd"]) for r in panel_stream.stored_panel(spark, target).collect()) == [(1, 1.0), (2, 3.0)]
    assert sinks.unused_folders(spark, target, keep=1) == [first["2008-2"]]


def test_panel_columns_go_by_heading(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("dtd,DTDmedian,note,Year,MONTH,company_number,DTDmedian\n9,1,x,2008,1,1001,2\n,,,2008,2,1001,3\n")
    rows = [r.asDict() for r in sheets.read_panel_csv(spark, str(path)).collect()]
    assert (rows[0]["dtd"], rows[0]["dtd_median"], rows[0]["dtd_median_i"], rows[0]["stk_index"]) == ("9", "1", "2", None)
    assert len(rows) == 2 and rows[1]["dtd_median_i"] == "3"
    with pytest.raises(ValueError, match="company_number"):
        schemas.panel_layout(["year", "month", "dtd"])
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "1.csv").write_text(PANEL_HEAD + "\n" + panel_line(1001, 2008, 1) + "\n")
    (folder / "2.csv").write_text("year,month,Company_Number,dtd\n2008,1,1001,9\n")
    with pytest.raises(Exception, match="other headings"):
        sheets.read_panel_csv(spark, str(folder)).collect()


def test_rows_of_a_sheet_in_two_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "sheet"
    folder.mkdir()
    (folder / "1.csv").write_text("Dates,Gold spot\n2008-09-15,1\n")
    (folder / "2.csv").write_text("Dates,Gold spot\n" + "2008-09-15,2\n" * 5000)
    got = loads.commodities(sheets.read_numbered_sheet(spark, str(folder)))
    assert [r["gold"] for r in got.collect()] == [1.0]


def test_event_ids_do_not_depend_on_files(spark, source, tmp_path):
    whole = sheets.read_sheet(spark, str(source / "credit_events.csv"))
    key = lambda df: sorted((r["id"], r["action_name"]) for r in loads.credit_events(df).collect())
    assert key(whole.coalesce(1)) == key(whole.repartition(7))


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("u3_company_number"), "id")
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        assert sinks.write_table(df, name, catalog=True, buckets=(4, "u3_company_number")) == 1000
    a, other = spark.table("bucketed_a").hint("merge"), spark.table("bucketed_b")
    joined = a.join(other, "u3_company_number").groupBy("u3_company_number").count()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.agg(F.sum("count")).first()[0] == 50 * 20 * 20
    with pytest.raises(ValueError):
        sinks.write_table(df, "/nowhere", buckets=(4, "id"))
