"""Small SQL scripts: CREATE TABLE declarations checked against given tables, then a SELECT planned by Catalyst.

SQL semantics are ANSI: <= means <=, the first matching WHEN counts, min and max start from the values, outer joins are outer joins, and
a join keeps all of its conjuncts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, types as T

_CREATE = re.compile(r"create\s+table\s+(\w+)\s*\((.*)\)\s*$", re.I | re.S)
_TOP = re.compile(r"^\s*select\s+top\s+(\d+)\s+", re.I)
_KINDS = {
    "int": (T.IntegerType, T.LongType, T.ShortType, T.ByteType), "integer": (T.IntegerType, T.LongType), "bigint": (T.LongType, T.IntegerType),
    "double": (T.DoubleType, T.FloatType, T.DecimalType), "float": (T.DoubleType, T.FloatType), "real": (T.DoubleType, T.FloatType), "decimal": (T.DecimalType, T.DoubleType),
    "text": (T.StringType,), "varchar": (T.StringType,), "char": (T.StringType,), "string": (T.StringType,), "date": (T.DateType, T.TimestampNTZType, T.TimestampType), "boolean": (T.BooleanType,),
}


def statements(script: str) -> list[str]:
    """Statements between semicolons; those in quotes and comments separate nothing."""
    out, part, quote = [], [], ""
    for piece in re.split(r"(--[^\n]*|'|\"|;)", script):
        if quote:
            part.append(piece)
            quote = "" if piece == quote else quote
        elif piece in ("'", '"'):
            quote = piece
            part.append(piece)
        elif piece == ";":
            out.append("".join(part))
            part = []
        elif not piece.startswith("--"):
            part.append(piece)
    out.append("".join(part))
    return [s.strip() for s in out if s.strip()]


def declared_columns(body: str) -> list[tuple[str, str]]:
    columns = []
    for item in re.split(r",(?![^(]*\))", body):
        words = item.split()
        if words and words[0].lower() not in ("primary", "foreign", "unique", "constraint"):
            columns.append((words[0].lower(), re.sub(r"\(.*", "", words[1]).lower()))
    return columns


def check_table(name: str, df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The declared columns of `df`; an error names what is missing or of another type."""
    have = {f.name.lower(): f for f in df.schema}
    for c, kind in columns:
        if c not in have:
            raise ValueError(f"table {name} has no column {c}")
        if kind not in _KINDS:
            raise ValueError(f"unknown type {kind} of {name}.{c}")
        if not isinstance(have[c].dataType, _KINDS[kind]):
            raise ValueError(f"{name}.{c} is declared {kind} but is {have[c].dataType.simpleString()}")
    return df.select(*[c for c, _ in columns])


def run_script(spark: SparkSession, script: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of the last SELECT. Tables stand under their names, letter case aside; `select top n` is a limit."""
    given = {k.lower(): v for k, v in tables.items()}
    result = None
    for s in statements(script):
        if m := _CREATE.match(s):
            name = m[1].lower()
            if name not in given:
                raise ValueError(f"no data for table {name}")
            check_table(name, given[name], declared_columns(m[2])).createOrReplaceTempView(name)
        elif re.match(r"(select|with|\()", s, re.I):
            top = _TOP.match(s)
            text = "select " + s[top.end() :] + f" limit {top[1]}" if top else s
            result = spark.sql(text)
        else:
            raise ValueError(f"only CREATE TABLE and SELECT are known: {s[:40]}")
    if result is None:
        raise ValueError("the script has no SELECT")
    return result
