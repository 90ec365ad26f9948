"""PostgreSQL-flavoured SQL to Spark SQL: the rewrites that benchmark texts need.

String literals are set aside first, so nothing inside them changes.
"""

from __future__ import annotations

import re

_TEXT = re.compile(r"'(?:[^']|'')*'")
_MARK = re.compile(r"\x00(\d+)\x00")
_OPERAND = r"(\x00\d+\x00|\?|[\w.\"`]+|\([^()]*\))"
_UNITS = "year|month|week|day|hour|minute|second"

#: Statements that only ask about the server, answered with constant rows.
SERVER_QUESTIONS = re.compile(r"^\s*(show\s+all|select\b.*\bfrom\s+pg_stat\w*)", re.IGNORECASE | re.DOTALL)


def rewrite(sql: str) -> str:
    """The same query for Spark. Precision and scale of decimal casts are kept."""
    if SERVER_QUESTIONS.match(sql):
        return "SELECT 'server' AS name, 'spark' AS setting"
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    def text_of(mark: str) -> str | None:
        m = _MARK.fullmatch(mark)
        return held[int(m[1])] if m else None

    def keep(value: str) -> str:
        held.append(value)
        return f"\x00{len(held) - 1}\x00"

    def dated(m: re.Match) -> str:
        value = text_of(m[1])
        return f"DATE {m[1]}" if value else f"CAST({m[1]} AS DATE)"

    def decimal(m: re.Match) -> str:
        value = text_of(m[1])
        number = value and value[1:-1].strip()
        if number and re.fullmatch(r"[+-]?\d+(\.\d*)?", number) and not m[2]:
            return number
        return f"CAST({m[1]} AS DECIMAL{m[2] or ''})"

    def interval(m: re.Match) -> str:
        value = text_of(m[1])
        found = value and re.fullmatch(rf"'\s*([+-]?\d+)\s+({_UNITS})s?\s*'", value, re.IGNORECASE)
        return f"INTERVAL {keep(repr(found[1]))} {found[2].upper()}" if found else m[0]

    def concatenated(m: re.Match) -> str:
        unit = re.fullmatch(rf"'\s*({_UNITS})s?\s*'", text_of(m[2]) or "", re.IGNORECASE)
        return f"INTERVAL {m[1]} {unit[1].upper()}" if unit else m[0]

    out = _TEXT.sub(hold, sql)
    out = re.sub(r"concat\s*\(\s*(\?|\d+)\s*,\s*(\x00\d+\x00)\s*\)\s*::\s*interval", concatenated, out, flags=re.IGNORECASE)
    out = re.sub(r"\(\s*(\?|\d+)\s*\|\|\s*(\x00\d+\x00)\s*\)\s*::\s*interval", concatenated, out, flags=re.IGNORECASE)
    out = re.sub(r"(\x00\d+\x00)\s*::\s*interval", interval, out, flags=re.IGNORECASE)
    out = re.sub(r"\binterval\s+(\x00\d+\x00)(?!\s*(?:%s)\b)" % _UNITS, interval, out, flags=re.IGNORECASE)
    out = re.sub(rf"\binterval\s+(\x00\d+\x00|\?|\d+)\s+({_UNITS})s\b", r"INTERVAL \1 \2", out, flags=re.IGNORECASE)
    out = re.sub(_OPERAND + r"\s*::\s*date\b", dated, out, flags=re.IGNORECASE)
    out = re.sub(_OPERAND + r"\s*::\s*(?:decimal|numeric)\b(\s*\([^()]*\))?", decimal, out, flags=re.IGNORECASE)
    for _ in range(3):  # casts of casts
        out = re.sub(_OPERAND + r"\s*::\s*(\w+(?:\s*\([^()]*\))?)", lambda m: f"CAST({m[1]} AS {_kind(m[2])})", out)
    out = re.sub(r"\bexists\s*\(\s*select\s+\*\s+from\b", "EXISTS (SELECT 1 FROM", out, flags=re.IGNORECASE)
    out = re.sub(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\b", "CREATE OR REPLACE TEMPORARY VIEW", out, flags=re.IGNORECASE)
    while _MARK.search(out):
        out = _MARK.sub(lambda m: held[int(m[1])], out)
    return out


def _kind(name: str) -> str:
    plain = {"text": "STRING", "varchar": "STRING", "int4": "INT", "int8": "BIGINT", "float8": "DOUBLE", "float4": "FLOAT", "bool": "BOOLEAN"}
    return plain.get(name.strip().lower(), name)


def average_as_decimal(sql: str, column: str, precision: int = 28, scale: int = 2) -> str:
    """AVG of a column at a fixed decimal scale, so the result doesn't hang on the column's own type."""
    return re.sub(rf"\bavg\s*\(\s*((?:\w+\.)?{column})\s*\)", rf"AVG(CAST(\1 AS DECIMAL({precision},{scale})))", sql, flags=re.IGNORECASE)
