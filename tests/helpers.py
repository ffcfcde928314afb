"""Small tables for the tests."""

import datetime as dt
from decimal import Decimal

from netpen.schemas import TABLES


def at(text):
    return dt.datetime.fromisoformat(text)


def table(spark, name, *rows):
    """Rows given as dicts; missing columns are null, decimals and times may be text."""
    schema = TABLES[name]
    kinds = {f.name: f.dataType.typeName() for f in schema}

    def convert(column, value):
        if isinstance(value, str) and kinds[column] == "decimal":
            return Decimal(value)
        if isinstance(value, str) and kinds[column] == "timestamp_ntz":
            return at(value)
        if isinstance(value, str) and kinds[column] == "date":
            return dt.date.fromisoformat(value)
        return value

    data = [tuple(convert(c, row.get(c)) for c in schema.names) for row in rows]
    return spark.createDataFrame(data, schema)


def dicts(df, *order):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows
