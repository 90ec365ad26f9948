import pytest
from pyspark.sql import functions as F

import tarnflow.operators  # noqa: F401
from tarnflow.functions.coerce import eq_coerced
from tarnflow.plans.dialect import average_as_decimal, rewrite
from tarnflow.plans.evidence import inspect, statistics
from tarnflow.plans.frontend import NotASelect, check_select, mentioned, run_sql
from tarnflow.registry import QUERIES, table
from tarnflow.session import metadata_session


@pytest.mark.parametrize(
    ("text", "spark_text"),
    [
        ("d >= '1994-01-01'::date", "d >= DATE '1994-01-01'"),
        ("d >= ?::date", "d >= CAST(? AS DATE)"),
        ("x > '0.05'::decimal", "x > 0.05"),
        ("x > '0.05'::decimal(4,2)", "x > CAST('0.05' AS DECIMAL(4,2))"),
        ("x > ?::numeric(15,2)", "x > CAST(? AS DECIMAL(15,2))"),
        ("d + concat(?, ' days')::interval", "d + INTERVAL ? DAY"),
        ("d + interval '90 days'", "d + INTERVAL '90' DAY"),
        ("d + '3 months'::interval", "d + INTERVAL '3' MONTH"),
        ("d + interval '1' years", "d + INTERVAL '1' year"),
        ("exists ( select * from t)", "EXISTS (SELECT 1 FROM t)"),
        ("create view v as select 1", "CREATE OR REPLACE TEMPORARY VIEW v as select 1"),
        ("a::text", "CAST(a AS STRING)"),
        ("x = '::date'", "x = '::date'"),
        ("x = 'it''s interval ''1 day'''", "x = 'it''s interval ''1 day'''"),
        ("SHOW ALL", "SELECT 'server' AS name, 'spark' AS setting"),
        ("select * from pg_stat_bgwriter", "SELECT 'server' AS name, 'spark' AS setting"),
    ],
)
def test_rewrites(text, spark_text):
    assert rewrite(text) == spark_text


def test_average_rule():
    assert average_as_decimal("0.2 * avg(l.l_quantity)", "l_quantity") == "0.2 * AVG(CAST(l.l_quantity AS DECIMAL(28,2)))"


@pytest.mark.parametrize("text", ["INSERT INTO t VALUES (1)", "DROP TABLE t", "SELECT 1; SELECT 2", "", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "MERGE INTO t USING s ON 1 = 1"])
def test_only_selects(text):
    with pytest.raises(NotASelect):
        check_select(text)


def test_selects_pass():
    assert check_select("-- why\nSELECT ';' AS x /* c */ ;") == "SELECT ';' AS x"
    assert mentioned("select * from Orders o join lineitem") == ["orders", "lineitem"]


@pytest.mark.parametrize("value", ["a--b", "/* k */", "a;b", "--", "x */ y /*", 'say "hi" -- now', "`"])
def test_comment_marks_in_literals_are_kept(spark, value):
    assert run_sql(spark, f"SELECT '{value}' AS x -- a 'comment'\n /* and ; more */ ;").first().x == value
    assert run_sql(spark, "SELECT 1 AS `a--b` /* c */").columns == ["a--b"]


def test_views_and_server_questions(spark, sf):
    assert run_sql(spark, "-- asks\nSHOW ALL").first().setting == "spark"
    assert run_sql(spark, "SELECT * FROM pg_stat_bgwriter;").count() == 1
    assert run_sql(spark, "CREATE VIEW low_orders AS SELECT o_orderkey FROM orders WHERE o_totalprice < 5000", sf).count() == 0
    assert run_sql(spark, "SELECT count(*) AS n FROM low_orders").first().n > 0
    for text in ("CREATE VIEW v AS DROP TABLE t", "CREATE VIEW v AS SELECT 1; DROP TABLE t", "CREATE TABLE v AS SELECT 1", "SHOW ALL; DROP TABLE t"):
        with pytest.raises(NotASelect):
            run_sql(spark, text)


def test_parameters_are_values(spark, sf):
    assert run_sql(spark, "SELECT ? AS x, ?::date AS d", args=["a' OR 1 = 1 --", "2001-02-03"]).first().x == "a' OR 1 = 1 --"
    n = run_sql(spark, "SELECT count(*) AS n FROM orders WHERE o_totalprice > :least", sf, {"least": 1000.0}).first().n
    assert n == table(spark, sf, "orders").where("o_totalprice > 1000").count()


def test_dropped_clauses_are_honoured(spark, sf):
    rows = run_sql(spark, "SELECT DISTINCT o_orderstatus FROM orders ORDER BY 1 LIMIT 2", sf).collect()
    assert [r[0] for r in rows] == sorted(r[0] for r in rows) and len(rows) == 2


def test_footers_answer_counts(spark, sf):
    s = metadata_session(spark)
    t = table(s, sf, "lineitem")
    assert inspect(t.agg(F.count("*"))).label == "footer-count"
    assert inspect(t.agg(F.min("l_orderkey"), F.max("l_orderkey"), F.count("l_tax"))).label == "footer-stats"
    assert inspect(t.where("l_quantity > 3").agg(F.count("*"))).label == "aggregation"
    assert inspect(t.agg(F.min("l_returnflag"))).label == "aggregation"
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_fallbacks_say_why(spark, sf):
    t = table(metadata_session(spark), sf, "lineitem")
    e = inspect(t.where("l_quantity > 3").agg(F.count("*")), footers_wanted=True)
    assert (e.label, e.target, e.pushdown) == ("fallback", "aggregation", False) and "filter" in e.reason
    e = inspect(t.agg(F.max("l_returnflag")), footers_wanted=True)
    assert e.label == "fallback" and "l_returnflag" in e.reason
    e = inspect(spark.range(2))
    assert e.label == "unknown" and e.reason and not e.pushdown and inspect(t.agg(F.count("*")), footers_wanted=True).pushdown


def test_pushdown_and_pruning(spark, sf):
    e = inspect(QUERIES["project_pruned"](spark, sf))
    assert any("GreaterThan(c_acctbal,5000.0)" in f for f in e.pushed_filters)
    assert set(e.read_columns) == {"c_name", "c_mktsegment", "c_acctbal"}
    e = inspect(QUERIES["filter_starts"](spark, sf))
    assert any("StringStartsWith(o_orderpriority,1)" in f for f in e.pushed_filters)
    assert any("In(" in f for f in inspect(QUERIES["filter_in"](spark, sf)).pushed_filters)
    assert inspect(QUERIES["filter_always_false"](spark, sf)).exchanges == 0


def test_partial_aggregates_before_the_shuffle(spark, sf):
    plan = QUERIES["group_by_multi"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.index("partial_sum") > plan.index("Exchange")


def test_top_k_keeps_no_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in QUERIES["top_k"](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("left", "right", "n"), [("tinyint_col", "id", 1000), ("bool_col", "tinyint_col", 100_000), ("float_col", "double_col", 1000)])
def test_joins_across_types(spark, left, right, n):
    i = F.col("id")
    t = spark.range(1000).select(i.cast("int").alias("id"), (i % 2 == 0).alias("bool_col"), (i % 10).cast("tinyint").alias("tinyint_col"), i.cast("float").alias("float_col"), i.cast("double").alias("double_col"))
    a, b = t.alias("a"), t.select(*[F.col(c).alias(c) for c in t.columns])
    assert t.join(b, eq_coerced(t, left, b, right)).count() == n


def test_statistics(spark, sf):
    _, size = statistics(table(spark, sf, "lineitem"))
    assert size > 0
