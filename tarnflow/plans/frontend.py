"""The SELECT front end: one statement in, a DataFrame out.

Besides one SELECT it takes CREATE VIEW, which makes a temporary view of one SELECT and has no rows, and
questions about the server (SHOW ALL, pg_stat tables), which have constant rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tarnflow.plans.dialect import SERVER_QUESTIONS, rewrite
from tarnflow.sources.schemas import read_parquet

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class NotASelect(ValueError):
    """The text isn't one SELECT statement."""


#: Literals and quoted names, which are kept as they are, or comments.
_OPAQUE = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|(--[^\n]*|/\*.*?\*/)", re.DOTALL)
_VIEW = re.compile(r"create\s+(or\s+replace\s+)?(temp(orary)?\s+)?view\s+(\w+)\s+as\b", re.IGNORECASE)


def _without_comments(sql: str) -> tuple[str, str]:
    """The statement without comments and a closing semicolon, and the same with all quoted parts empty."""
    text = _OPAQUE.sub(lambda m: " " if m[1] else m[0], sql).strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    return text, _OPAQUE.sub(lambda m: m[0][0] * 2, text)


def check_select(sql: str) -> str:
    """The statement without comments and a closing semicolon; anything but one SELECT is refused."""
    text, bare = _without_comments(sql)
    if ";" in bare:
        raise NotASelect("only one statement is allowed")
    if not re.match(r"(select|with|values|\(\s*select)\b", bare, re.IGNORECASE):
        raise NotASelect(f"not a SELECT statement: {text[:60]!r}")
    if re.match(r"with\b", bare, re.IGNORECASE) and re.search(r"\)\s*(insert|update|delete|merge)\b", bare, re.IGNORECASE):
        raise NotASelect("only SELECT may follow WITH")
    return text


def check_statement(sql: str) -> str:
    """The statement, if it is one that ``run_sql`` takes."""
    text, bare = _without_comments(sql)
    if SERVER_QUESTIONS.match(bare) and ";" not in bare:
        return text
    view = _VIEW.match(bare)
    if view:
        check_select(text[view.end() :])
        return text
    return check_select(sql)


def publish(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables of a folder."""
    for name in names or TABLES:
        read_parquet(spark, f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def mentioned(sql: str, names: list[str] = TABLES) -> list[str]:
    """Those of ``names`` that the text has as words."""
    words = set(re.findall(r"\w+", sql.lower()))
    return [n for n in names if n in words]


def run_sql(spark: SparkSession, sql: str, folder: str | None = None, args: dict | list | None = None) -> DataFrame:
    """The result of one statement; with ``folder``, its tables are the Parquet tables there.

    ``args`` are the values of its parameters: a list for ``?``, a dict for ``:name``. They are values
    only, so no text in them is read as SQL.
    """
    text = rewrite(check_statement(sql))
    if folder:
        publish(spark, folder, mentioned(text))
    return spark.sql(text, args=args) if args else spark.sql(text)
