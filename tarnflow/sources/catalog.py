"""A catalog over folders: root/schema/table/**.parquet, or root/schema/table.parquet.

Listing goes through Hadoop's file systems, so any store that Spark reads will do. One rule for LIKE
holds everywhere: the whole name, letters in either case, % and _ as in SQL, backslash escapes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CATALOG = "spark_catalog"
TABLE_TYPE = "TABLE"
_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")

# SQL type name, JDBC type code, precision, literal quote, creation parameters,
# case sensitivity, searchability (0: not at all, 3: in every predicate), largest scale, radix.
TYPES = [
    ("ARRAY", 2003, None, None, None, False, 0, 0, None),
    ("BIGINT", -5, 19, None, None, False, 3, 0, 10),
    ("BINARY", -2, 2147483647, None, "length", False, 3, 0, None),
    ("BOOLEAN", 16, 1, None, None, False, 3, 0, 2),
    ("DATE", 91, 10, "'", None, False, 3, 0, None),
    ("DECIMAL", 3, 38, None, "precision, scale", False, 3, 38, 10),
    ("DOUBLE", 8, 15, None, None, False, 3, 0, 10),
    ("INTEGER", 4, 10, None, None, False, 3, 0, 10),
    ("REAL", 7, 7, None, None, False, 3, 0, 10),
    ("SMALLINT", 5, 5, None, None, False, 3, 0, 10),
    ("STRUCT", 2002, None, None, None, False, 0, 0, None),
    ("TIME", 92, 15, "'", None, False, 3, 6, None),
    ("TIMESTAMP", 93, 26, "'", None, False, 3, 6, None),
    ("TINYINT", -6, 3, None, None, False, 3, 0, 10),
    ("VARCHAR", 12, 2147483647, "'", "length", True, 3, 0, None),
]
TYPE_COLUMNS = (
    "type_name string, data_type int, column_size int, literal_prefix string, literal_suffix string, create_params string, nullable int, case_sensitive boolean, searchable int, "
    "unsigned_attribute boolean, fixed_prec_scale boolean, auto_increment boolean, local_type_name string, minimum_scale int, maximum_scale int, sql_data_type int, datetime_subcode int, "
    "num_prec_radix int, interval_precision int"
)


def type_row(name: str, code: int, size: int | None, quote: str | None, params: str | None, case: bool, search: int, scale: int, radix: int | None) -> tuple:
    """All that clients ask of a type: values may be null (1), none is unsigned, fixed or counted up."""
    return (name, code, size, quote, quote, params, 1, case, search, False, False, False, name, 0, scale, None, None, radix, None)


# What the engine says about itself.
SQL_INFO = [
    ("server_name", "tarnflow"),
    ("server_version", "0.0.1"),
    ("arrow_version", "0.0.1"),
    ("read_only", "true"),
    ("sql", "true"),
    ("substrait", "false"),
    ("transactions", "none"),
    ("ddl_catalog", "false"),
    ("ddl_schema", "true"),
    ("ddl_table", "true"),
    ("identifier_case", "lowercase"),
    ("quoted_identifier_case", "unknown"),
    ("all_tables_selectable", "true"),
    ("null_ordering", "sorted at end"),
    ("max_columns_in_table", "1000"),
]


class NotFound(LookupError):
    """No such catalog, schema, table or type."""


def validate_name(name: str) -> str:
    """A schema or table name; anything that could lead out of the root is refused."""
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not a valid name: {name!r}")
    return name


def like(pattern: str | None):
    """A test for names by an SQL pattern; None matches all."""
    if pattern is None:
        return lambda name: True
    out, escaped = "", False
    for c in pattern:
        if escaped:
            out, escaped = out + re.escape(c), False
        elif c == "\\":
            escaped = True
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
    compiled = re.compile(out, re.IGNORECASE | re.DOTALL)
    return lambda name: compiled.fullmatch(name) is not None


@dataclass(frozen=True)
class Entry:
    schema: str
    table: str
    path: str


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str) -> Catalog:
        """The catalog of which ``folder`` is a schema, whatever its name."""
        out = cls(spark, folder.rstrip("/").rpartition("/")[0])
        out._only = (folder.rstrip("/").rpartition("/")[2], "main")
        return out

    _only: tuple[str, str] | None = None

    def _children(self, path: str) -> list[tuple[str, bool]]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(where))

    def schemas(self, pattern: str | None = None) -> list[str]:
        names = [self._only[1]] if self._only else [n for n, folder in self._children(self.root) if folder and _NAME.fullmatch(n)]
        return [n for n in names if like(pattern)(n)]

    def tables(self, schema_pattern: str | None = None, table_pattern: str | None = None, kinds: list[str] | None = None) -> list[Entry]:
        if kinds is not None and TABLE_TYPE not in kinds:
            raise NotFound(f"no tables of types {kinds}")
        out = []
        for schema in self.schemas(schema_pattern):
            folder = f"{self.root}/{self._only[0] if self._only else schema}"
            for name, _ in self._children(folder):
                table = re.sub(r"\.parquet$", "", name, flags=re.IGNORECASE)
                if _NAME.fullmatch(table) and like(table_pattern)(table):
                    out.append(Entry(schema, table, f"{folder}/{name}"))
        return out

    def find(self, schema: str, table: str) -> Entry:
        validate_name(schema)
        validate_name(table)
        found = [e for e in self.tables() if e.schema.lower() == schema.lower() and e.table.lower() == table.lower()]
        if not found:
            raise NotFound(f"no table {schema}.{table}")
        return found[0]

    def read(self, schema: str, table: str) -> DataFrame:
        """The rows of all Parquet files at or below the table's place."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(self.find(schema, table).path)

    def publish(self) -> None:
        """A temporary view for each table, by its bare name."""
        for e in self.tables():
            self.read(e.schema, e.table).createOrReplaceTempView(e.table)

    def persist(self, schema: str, table: str, name: str) -> DataFrame:
        """A table of the session catalog over the same files, so later sessions need only its name."""
        validate_name(name)
        entry = self.find(schema, table)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{entry.path}'")
        return self.spark.table(name)

    # ------------------------------------------------------------ metadata as rows

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def info_catalogs(self) -> DataFrame:
        return self._rows([(CATALOG,)], "catalog_name string")

    def info_schemas(self, pattern: str | None = None) -> DataFrame:
        return self._rows([(CATALOG, s) for s in self.schemas(pattern)], "catalog_name string, db_schema_name string")

    def info_table_types(self) -> DataFrame:
        return self._rows([(TABLE_TYPE,)], "table_type string")

    def info_tables(self, catalog: str | None = None, schema_pattern: str | None = None, table_pattern: str | None = None, kinds: list[str] | None = None, with_schema: bool = False) -> DataFrame:
        if catalog not in (None, "", CATALOG):
            raise NotFound(f"no catalog {catalog}")
        found = self.tables(schema_pattern, table_pattern, kinds)
        rows = [(CATALOG, e.schema, e.table, TABLE_TYPE) + ((self.read(e.schema, e.table).schema.json(),) if with_schema else ()) for e in found]
        return self._rows(rows, "catalog_name string, db_schema_name string, table_name string, table_type string" + ", table_schema string" * with_schema)

    def info_types(self, code: int | None = None) -> DataFrame:
        rows = [type_row(*t) for t in TYPES if code is None or t[1] == code]
        return self._rows(sorted(rows, key=lambda t: (t[1], t[0])), TYPE_COLUMNS)

    def info_sql(self) -> DataFrame:
        return self._rows(SQL_INFO, "info_name string, value string")

    def info_columns(self, schema: str, table: str) -> DataFrame:
        fields = self.read(schema, table).schema.fields
        return self._rows([(f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(fields)], "column_name string, data_type string, ordinal int")

    def info_ddl(self, schema: str, table: str) -> DataFrame:
        return self._rows([(table, ddl(schema, table, self.read(schema, table).schema))], "table_name string, ddl string")


def query_schema(df: DataFrame) -> DataFrame:
    """Names and types of a query's columns; the query isn't run."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i + 1) for i, f in enumerate(df.schema.fields)], "column_name string, data_type string, ordinal int")


def ddl(schema: str, table: str, fields: T.StructType) -> str:
    columns = ", ".join(f'"{f.name}" {sql_type(f.dataType)}' for f in fields.fields)
    return f"CREATE TABLE {validate_name(schema)}.{validate_name(table)}({columns})"


def sql_type(kind: T.DataType) -> str:
    """The name in TYPES of a Spark type, with precision where there is one."""
    names = {T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "REAL", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BINARY"}
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return "ARRAY"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "STRUCT"
    return names.get(type(kind), "VARCHAR")
