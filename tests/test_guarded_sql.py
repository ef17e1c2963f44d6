import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom.functions.fixed_values import FORBIDDEN_WORDS
from riskloom.operators import guarded_sql as g


def errors(spark, texts, mode):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    return [r["error"] for r in g.audit_sql(df, "sql", mode).orderBy("i").collect()]


SAFE = [
    "SELECT n_name, count(*) FROM nation GROUP BY n_name",
    "\n\tselect r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > 7",
    "SELECT 40 + 2;",
    "SELECT 'a;b' AS quoted",
    "SELECT 'it''s; fine' AS t; SELECT 2",
]
UNSAFE = [
    "", " \t ", None, "SHOW TABLES", "-- note\nSELECT 1", "(SELECT 1)", "SELECT 40; DROP VIEW region",
    "SELECT 2 UNION SELECT 3; REVOKE ALL ON region FROM x",
    *[f"{w} region" for w in FORBIDDEN_WORDS], *[f"{w.lower()} region" for w in FORBIDDEN_WORDS],
    *[f"SELECT * FROM nation WHERE n_name IN ({w.title()} region)" for w in FORBIDDEN_WORDS],
]
PATHS = [
    "SELECT * FROM parquet.`/x`", "SELECT * FROM `parquet`.`/x`", "SELECT * FROM parquet/**/.`/x`",
    "SELECT * FROM `csv` . /* a */ `/x`", "SELECT * FROM json -- note\n.`/x`",
]


def test_tables_by_path_are_refused(spark):
    assert all(e is not None for e in errors(spark, PATHS, "word"))
    with pytest.raises(g.UnsafeSql):
        g.run_select(spark, PATHS[1])


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_safe_and_unsafe(spark, mode):
    assert errors(spark, SAFE, mode) == [None] * len(SAFE)
    assert all(e is not None for e in errors(spark, UNSAFE, mode))


def test_messages(spark):
    assert errors(spark, ["", "DROP TABLE t", "SELECT x FROM t; update t", "SELECT EXECUTE, ALTER"], "substring") == [
        "Empty SQL query", "Only SELECT queries allowed, got: DROP", "Only SELECT queries allowed, got: update",
        "Dangerous keyword detected: ALTER",
    ]


def test_modes_differ_on_parts_of_names(spark):
    texts = ["SELECT created_at FROM t", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT a INTO b FROM c",
             "SELECT TRANSFORM(a) USING 'x' FROM t", "SELECT reflect('a', 'b')", "SELECT * FROM parquet.`/x`",
             "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"]
    assert [e is None for e in errors(spark, texts, "word")] == [True, True, False, False, False, False, False]
    assert [e is None for e in errors(spark, texts, "substring")] == [False, False, True, True, True, True, False]
    with pytest.raises(ValueError):
        g.sql_error(F.lit("x"), "loose")


def test_long_text_is_read_whole(spark):
    text = "SELECT '" + "a''b;" * 20000 + "' AS t"
    assert errors(spark, [text, text + "; DROP TABLE x"], "word") == [None, "Only SELECT queries allowed, got: DROP"]


def test_fences(spark):
    texts = ["```sql\nSELECT 1\n```", "```\nSELECT 1\n```  ", "  SELECT 1\n", "SELECT 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(g.strip_fences(F.col("t"))).collect()] == ["SELECT 1"] * 4


def test_run_select(spark):
    tables = {"numbers": spark.range(300).withColumn("d", F.lit("2008-09-15").cast("date"))}
    assert g.run_select(spark, "SELECT * FROM numbers", tables).count() == 100
    assert g.run_select(spark, "SELECT * FROM numbers LIMIT 10;", tables, rows=50).count() == 10
    assert g.run_select(spark, "SELECT * FROM numbers", tables, rows=None).count() == 300
    # A limit inside does not lift the cap.
    inner = "SELECT a.id FROM numbers a JOIN (SELECT id FROM numbers LIMIT 200) b ON a.id = b.id"
    assert g.run_select(spark, inner, tables, rows=50).count() == 50
    assert g.run_select(spark, "```sql\nSELECT d FROM numbers WHERE id = 1\n```", tables).first()[0] == "2008-09-15"
    with pytest.raises(g.UnsafeSql, match="Only SELECT queries allowed, got: DROP"):
        g.run_select(spark, "DROP VIEW numbers", tables)
    assert spark.table("numbers").count() == 300


def test_tables_can_be_opened_in_a_session_of_their_own(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(7).write.parquet(path)
    spark.range(3).createOrReplaceTempView("others_view")
    opened = lambda own: {"mine": own.read.parquet(path)}
    assert g.run_select(spark, "SELECT * FROM mine", opened).count() == 7
    assert not spark.catalog.tableExists("mine")
    for text in ("SELECT * FROM others_view", f"SELECT * FROM parquet.`{path}`", f"SELECT * FROM `parquet`.`{path}`",
                 f"SELECT * FROM parquet/**/.`{path}`"):
        with pytest.raises((g.UnsafeSql, AnalysisException)):
            g.run_select(spark, text, opened)
        if "parquet" in text:  # also where the audit is the lenient one
            with pytest.raises(AnalysisException):
                g.run_select(spark, text, opened, mode="substring")
