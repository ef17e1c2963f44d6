"""Whole refreshes behind a manifest, and what the loads refuse."""

import json

import pytest
from pyspark.errors import AnalysisException
from test_loads import panel_line, source  # noqa: F401

from riskloom.plans import loads, quarantine
from riskloom.sources import sinks


def counts(tables):
    return {name: t.count() for name, t in tables.items()}


def test_a_failed_refresh_changes_nothing(spark, source, tmp_path):  # noqa: F811
    root = str(tmp_path / "root")
    assert sinks.published(spark, root) == {} and loads.open_current(spark, root) == {}
    stats = loads.refresh_all(spark, str(source), root)
    assert {r["table_name"] for r in stats.collect()} == set(loads.SHEET_FILES) and all(r["seconds"] > 0 for r in stats.collect())
    before, paths = counts(loads.open_current(spark, root)), sinks.published(spark, root)
    companies = (source / "companies.csv").read_text()
    (source / "companies.csv").write_text(companies + "77,Third,T US,ACTV,10\n")
    (source / "risk_indicators.csv").unlink()  # the last table of the load
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        loads.refresh_all(spark, str(source), root)
    assert counts(loads.open_current(spark, root)) == before and sinks.published(spark, root) == paths
    (source / "credit_events.csv").write_text("U3 Company Number,Action Name\nx,bad key\n")
    with pytest.raises(Exception, match="integer required"):
        loads.refresh_all(spark, str(source), root, ["companies", "credit_events"])
    assert counts(loads.open_current(spark, root)) == before
    loads.refresh_all(spark, str(source), root, ["companies"])
    now = loads.open_current(spark, root)
    assert counts(now) == before | {"companies": 3}
    assert sinks.published(spark, root, 1) == paths
    # Only the first version's companies are named by no later version.
    assert sinks.unused_folders(spark, root, keep=1) == [paths["companies"]]
    assert sinks.unused_folders(spark, root) == []


def test_events_and_panel_use_the_companies_of_the_version_before(spark, source, tmp_path):  # noqa: F811
    root = str(tmp_path / "root")
    loads.refresh_all(spark, str(source), root, ["companies"])
    (source / "credit_events.csv").write_text("U3 Company Number,Action Name\n5,kept\n6,orphan\n")
    stats = {r["table_name"]: r["n_rows"] for r in loads.refresh_all(spark, str(source), root, ["credit_events", "risk_indicators"]).collect()}
    assert stats == {"credit_events": 1, "risk_indicators": 3}


def test_rejects_of_all_sheets(spark, source, tmp_path):  # noqa: F811
    (source / "industry_mapping.csv").write_text("Industry Sector,Industry Sector Num\nEnergy,ten\nOil,10.5\nGas, \n")
    (source / "companies.csv").write_text("U3 Company Number,Industry Sector Num,ID BB Company\n26978,10.0,x\n5,,7\n")
    (source / "credit_events.csv").write_text(
        "U3 Company Number,Announcement Date,Effective Date,Event Type\n26978,soon,,1\n6,9/15/2008,N/A,2\n5,2008-09-15,never,two\n"
    )
    (source / "commodities.csv").write_text("Dates,Generic WTI Crude,Other\n2008-09-15,x,y\nbad,1,1\n2008-09-16,NA,z\n")
    (source / "us_macros.csv").write_text("d1,VIX,d2,Real GDP\n2008-09-15,high,Q3 2008,14.5\n,9,,\nsoon,8,Q1 1980,3\n")
    (source / "fx_rates.csv").write_text("t,,\n,AUDUSD Curncy,EURUSD Curncy\n20080915,0.8,?\nx,1,1\nnote,,\n")
    lines = [panel_line(5000, 2008, 9), panel_line(5001, 2008, 9), panel_line(5002, 2008, 9), panel_line(777001, 2008, 9),
             panel_line(5000, "x", 9, dtd="bad"), panel_line("9e15", 2008, 9)]
    panel = (source / "risk_indicators.csv").read_text().split("\n")[0]
    (source / "risk_indicators.csv").write_text("\n".join([panel, *lines]) + "\n")
    target = str(tmp_path / "t")
    loads.load_all(spark, str(source), target, only=["companies"])
    got = quarantine.write_rejects(spark, str(source), f"{target}/rejects", f"{target}/companies")
    assert {(r["table_name"], r["reason"]): r["n"] for r in got.collect()} == {
        ("industry_mapping", "not_a_whole_number"): 2, ("companies", "not_a_whole_number"): 1,
        ("credit_events", "not_a_date"): 2, ("credit_events", "not_a_whole_number"): 1, ("credit_events", "unknown_company"): 1,
        ("macro_commodities", "no_date"): 1, ("macro_commodities", "not_a_number"): 1,
        ("macro_bond_yields", "no_date"): 1,
        ("macro_us", "no_date"): 2, ("macro_us", "not_a_number"): 1,
        ("macro_fx", "no_date"): 1, ("macro_fx", "not_a_number"): 1,
        ("risk_indicators", "no_month"): 1, ("risk_indicators", "not_a_number"): 1,
        ("risk_indicators", "unknown_company"): 2, ("risk_indicators", "repeated_month"): 2,
    }
    kept = {(r["table_name"], r["reason"], r["column_name"]): r for r in spark.read.parquet(f"{target}/rejects").collect()}
    event = kept["credit_events", "unknown_company", "u3_company_number"]
    assert event["value"] == "6" and json.loads(event["line"])["event_type"] == "2"
    assert kept["macro_us", "not_a_number", "VIX"]["value"] == "high"
    # An oversized company number does not end the load.
    loads.load_all(spark, str(source), target, only=["risk_indicators"])


def test_nothing_refused(spark, source, tmp_path):  # noqa: F811
    target = str(tmp_path / "t")
    loads.load_all(spark, str(source), target, only=["companies"])
    got = quarantine.write_rejects(spark, str(source), f"{target}/rejects", f"{target}/companies", only=["industry_mapping", "companies"])
    assert got.collect() == [] and got.columns == ["table_name", "reason", "n"]
