"""``python -m tarnflow VERB ...``: statements and metadata from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tarnflow.plans.frontend import check_select, run_sql
from tarnflow.plans.metrics import measured
from tarnflow.session import build_session
from tarnflow.settings import Settings
from tarnflow.sources.catalog import Catalog, query_schema
from tarnflow.sources.writer import insert_into


def keys(spark: SparkSession, *_: str) -> DataFrame:
    """Primary, imported and exported keys: Parquet tables declare none."""
    return spark.createDataFrame([], "db_schema_name string, table_name string, column_name string, key_name string")


def run(spark: SparkSession, root: str, verb: str, words: list[str]) -> DataFrame:
    """The rows of one command over the schemas below ``root``."""
    catalog = Catalog(spark, root)
    word = dict(enumerate(words)).get
    if verb in ("execute", "schema"):
        text = check_select(words[0])
        for entry in catalog.tables():
            catalog.read(entry.schema, entry.table).createOrReplaceTempView(entry.table)
        rows = run_sql(spark, text)
        return query_schema(rows) if verb == "schema" else rows
    if verb == "execute-update":  # TABLE COLUMN,COLUMN VALUE,VALUE ...
        table, columns, *values = words
        insert_into(spark, f"{root}/{table}", columns.split(","), [tuple(v.split(",")) for v in values])
        return spark.createDataFrame([(len(values),)], "rows long")
    verbs = {
        "get-catalogs": lambda: catalog.info_catalogs(),
        "get-schemas": lambda: catalog.info_schemas(word(0)),
        "get-table-types": lambda: catalog.info_table_types(),
        "get-tables": lambda: catalog.info_tables(schema_pattern=word(0), table_pattern=word(1)),
        "get-columns": lambda: catalog.info_columns(words[0], words[1]),
        "get-ddl": lambda: catalog.info_ddl(words[0], words[1]),
        "get-types": lambda: catalog.info_types(int(words[0]) if words else None),
        "get-sql-info": lambda: catalog.info_sql(),
        "get-primary-keys": lambda: keys(spark, *words),
        "get-imported-keys": lambda: keys(spark, *words),
        "get-exported-keys": lambda: keys(spark, *words),
    }
    if verb not in verbs:
        raise ValueError(f"no such command: {verb}; there are execute, execute-update, schema, {', '.join(verbs)}")
    return verbs[verb]()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser("tarnflow", description=__doc__)
    settings = Settings()
    parser.add_argument("--root", default=settings.text("root", ".", "data.dir"), help="folder of schema folders")
    parser.add_argument("--limit", type=int, default=settings.number("limit", 100), help="rows to show")
    parser.add_argument("verb")
    parser.add_argument("words", nargs="*")
    found = parser.parse_args(arguments)
    spark = spark or build_session()
    with measured(found.verb):
        rows = run(spark, found.root, found.verb, found.words)
        text = rows._jdf.showString(found.limit, 0, False)
    print(text)
    return text
