import pytest

from riskloom.operators import guarded_sql, plan_audit


@pytest.fixture(scope="module")
def audit(spark):
    return plan_audit.PlanAudit(spark, ["companies", "credit_events"])


ACCEPTED = [
    "SELECT 'DROP TABLE x; DELETE' AS t, created_at, `update` FROM companies /* INSERT */ -- ALTER",
    "-- note\nSELECT 1", "(SELECT 1)", "SELECT 1;", "VALUES (1), (2)",
    "WITH a AS (SELECT * FROM Companies), b AS (SELECT * FROM a) SELECT count(*) FROM b JOIN credit_events USING (id)",
    "SELECT * FROM companies WHERE id IN (SELECT id FROM credit_events) AND EXISTS (SELECT 1 FROM companies)",
    "SELECT x, sum(y) OVER (PARTITION BY x ORDER BY y) FROM companies GROUP BY ALL HAVING max(y) > 3 ORDER BY 1 LIMIT 5 OFFSET 2",
    "SELECT * FROM companies LATERAL VIEW explode(array(1, 2)) e AS v",
    "SELECT * FROM (SELECT a, b FROM companies) PIVOT (sum(b) FOR a IN (1, 2))",
    "SELECT 1 UNION SELECT 2 INTERSECT SELECT 3 EXCEPT SELECT 4",
    "SELECT CASE WHEN a LIKE 'x%' THEN DATE '2008-09-15' END FROM companies TABLESAMPLE (10 PERCENT)",
    "FROM companies |> WHERE id > 3 |> SELECT id",
]
REFUSED = {
    "": plan_audit.EMPTY, " \n": plan_audit.EMPTY, None: plan_audit.EMPTY,
    "SELECT 1; DROP TABLE companies": plan_audit.NOT_PARSED, "nonsense here": plan_audit.NOT_PARSED,
    "SELECT * FROM parquet.`/x`": "Table not allowed: parquet./x",
    "SELECT * FROM `csv` . /* a */ `/x`": "Table not allowed: csv./x",
    "SELECT * FROM secrets": "Table not allowed: secrets",
    "SELECT * FROM db.companies": "Table not allowed: db.companies",
    "SELECT (SELECT max(a) FROM secrets) FROM companies": "Table not allowed: secrets",
    "SELECT * FROM companies WHERE a IN (SELECT a FROM json.`/x`)": "Table not allowed: json./x",
    # A name given inside a subquery is not known outside it.
    "SELECT * FROM (WITH secrets AS (SELECT 1) SELECT * FROM secrets) JOIN secrets": "Table not allowed: secrets",
    "WITH a AS (SELECT * FROM a) SELECT * FROM a": "Table not allowed: a",
    "SELECT reflect('java.lang.System', 'exit', 1)": "Function not allowed: reflect",
    "SELECT upper(JAVA_METHOD('a', 'b')) FROM companies": "Function not allowed: JAVA_METHOD",
    "SELECT a FROM companies ORDER BY my_udf(a)": "Function not allowed: my_udf",
    "SELECT * FROM my_tvf(3)": "Function not allowed: my_tvf",
}
COMMANDS = [
    "DROP TABLE companies", "DELETE FROM companies", "UPDATE companies SET a = 1", "INSERT INTO companies VALUES (1)",
    "INSERT OVERWRITE DIRECTORY '/x' USING csv SELECT 1", "CREATE TABLE x AS SELECT 1", "CREATE TEMP VIEW x AS SELECT 1",
    "TRUNCATE TABLE companies", "ALTER TABLE companies RENAME TO x", "SHOW TABLES", "DESCRIBE companies", "SET a = b",
    "EXPLAIN SELECT 1", "CACHE TABLE companies", "USE x", "ADD JAR '/x'", "REFRESH TABLE companies", "MSCK REPAIR TABLE x",
    "LOAD DATA INPATH '/x' INTO TABLE companies", "ANALYZE TABLE companies COMPUTE STATISTICS",
    "MERGE INTO companies USING credit_events ON true WHEN MATCHED THEN DELETE",
    "WITH a AS (SELECT 1) INSERT INTO companies SELECT * FROM a", "EXECUTE IMMEDIATE 'DROP TABLE x'", "DECLARE x INT",
    "SELECT TRANSFORM(a) USING 'cat' AS b FROM companies", "SELECT * FROM IDENTIFIER('sec' || 'rets')",
    "SELECT IDENTIFIER('reflect')('a', 'b')", "SELECT * FROM STREAM companies", "BEGIN SELECT 1; END",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(audit, sql):
    assert audit.error(sql) is None


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(audit, sql):
    assert audit.error(sql) == REFUSED[sql]


@pytest.mark.parametrize("sql", COMMANDS)
def test_commands_and_dynamic_names(audit, sql):
    assert audit.error(sql) is not None


def test_functions_given(spark):
    audit = plan_audit.PlanAudit(spark, [], ["my_udf", "count"])
    assert audit.error("SELECT MY_UDF(1), count(*)") is None
    assert audit.error("SELECT upper('a')") == "Function not allowed: upper"


def test_table_of_texts_in_pages(spark, monkeypatch):
    monkeypatch.setattr(plan_audit, "PAGE", 2)
    texts = [None, "", "SELECT 1", "SELECT 22", "DROP TABLE x", "SELECT a1 FROM t2 WHERE d = DATE '2008-09-15' AND n = 15",
             "SELECT 'it''s' FROM companies LIMIT 7", "SELECT 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    got = plan_audit.audit_plans(df, "sql", ["companies"]).orderBy("i").collect()
    assert [r.plan_error for r in got] == [
        plan_audit.EMPTY, plan_audit.EMPTY, None, None, "Not a query: DropTable", "Table not allowed: t2", None, None]
    assert plan_audit.audit_plans(df.limit(0), "sql", ["companies"]).collect() == []


def test_run_select_by_plan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(7).write.parquet(path)
    opened = lambda own: {"mine": own.read.parquet(path)}
    spark.range(2).createOrReplaceTempView("others")
    kept = guarded_sql.run_select(spark, "SELECT id, 'DROP it' AS t FROM mine -- DELETE", opened, mode="plan")
    assert kept.count() == 7
    for text in (f"SELECT * FROM parquet.`{path}`", "SELECT * FROM others", "DROP VIEW mine", "CREATE VIEW x AS SELECT 1"):
        with pytest.raises(guarded_sql.UnsafeSql):
            guarded_sql.run_select(spark, text, opened, mode="plan")
    with pytest.raises(guarded_sql.UnsafeSql):
        guarded_sql.run_select(spark, "SELECT * FROM others", {"given": spark.range(3)}, mode="plan")
