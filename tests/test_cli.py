import pytest

from tarnflow.cli import main
from tarnflow.plans.frontend import NotASelect
from tarnflow.plans.metrics import METRICS, Metrics, measured
from tarnflow.settings import Settings
from tarnflow.sources.writer import VersionedTable


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("root"))
    spark.range(7).selectExpr("id", "id % 2 AS odd").write.parquet(f"{base}/shop/things")
    return base


@pytest.mark.parametrize(
    ("words", "found"),
    [
        (["execute", "SELECT odd, count(*) AS n FROM things GROUP BY odd"], "|0  |4  |"),
        (["schema", "SELECT odd FROM things"], "|odd        |bigint   |1      |"),
        (["get-catalogs"], "spark_catalog"),
        (["get-schemas", "s%"], "shop"),
        (["get-tables", "shop", "th%"], "things"),
        (["get-table-types"], "TABLE"),
        (["get-columns", "shop", "things"], "odd"),
        (["get-ddl", "shop", "things"], 'CREATE TABLE shop.things("id" BIGINT, "odd" BIGINT)'),
        (["get-types", "4"], "INTEGER"),
        (["get-sql-info"], "sorted at end"),
        (["get-primary-keys", "shop", "things"], "key_name"),
    ],
)
def test_commands(spark, root, words, found):
    assert found in main(["--root", root, *words], spark)


def test_refusals_are_counted(spark, root):
    failed = METRICS.failed["execute"]
    with pytest.raises(NotASelect):
        main(["--root", root, "execute", "DROP TABLE things"], spark)
    with pytest.raises(ValueError):
        main(["--root", root, "fly"], spark)
    assert METRICS.failed["execute"] == failed + 1 and METRICS.active == 0


def test_update(spark, root):
    VersionedTable(spark, f"{root}/kept").write(spark.createDataFrame([(1, "a")], "k long, s string"))
    assert "|2   |" in main(["--root", root, "execute-update", "kept", "k,s", "2,b", "3,c"], spark)
    assert sorted(map(tuple, VersionedTable(spark, f"{root}/kept").read().collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_settings_by_tier(spark, tmp_path):
    file = tmp_path / "conf"
    file.write_text("# a comment\nroot = /file\nlimit: 7\nblank =\nold.name = yes\n")
    environment = {"TARNFLOW_ROOT": "/env", "TARNFLOW_BLANK": "here", "TARNFLOW_CONFIG": str(file), "TARNFLOW_OTHER_NAME": " 3 "}
    s = Settings(spark, {"root": "/given"}, environment=environment)
    assert s.text("root") == "/given" and s.number("limit", 1) == 7 and s.text("blank") == "here" and s.text("none", "d") == "d"
    s = Settings(environment=environment)
    assert s.text("root") == "/file" and s.number("other.name", 1) == 3 and s.flag("new.name", False, "old.name")
    assert Settings(environment={}).text("root") is None and Settings(environment={}).number("x", 4) == 4
    with pytest.raises(ValueError, match="root"):
        s.number("root", 1)


def test_metric_text():
    m = Metrics()
    with measured("scan", m):
        pass
    with pytest.raises(KeyError), measured("scan", m):
        raise KeyError
    text = m.text()
    assert 'tarnflow_queries_total{kind="scan"} 2' in text and 'tarnflow_queries_failed_total{kind="scan"} 1' in text
    assert 'tarnflow_query_seconds_bucket{le="+Inf"} 2' in text and "tarnflow_queries_active 0" in text
