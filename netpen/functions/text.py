"""Text columns: trimming, CSV fields, keys, numbers derived from keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
OBS_HEADER = [
    "voyage_no", "cage_no", "observed_at", "feed_amount_kg",
    "survival_rate", "sensor_value", "sensor_unit", "source_device",
]
KEY_PATTERN = r"^[A-Za-z0-9_-]{1,32}\z"
MIGRATION_NO_PATTERN = r"^[A-Za-z0-9_-]{1,40}\z"
OPERATOR_PATTERN = "^[一-龥A-Za-z0-9_.-]{1,64}\\z"

# One field of a line that was given a leading comma; a field may be quoted, with "" for a quote.
_FIELD = r',("(?:[^"]++|"")*+(?:"[^,]*|\z)|[^,]*)'
_QUOTED_BODY = r'^"((?:[^"]++|"")*+)'
_QUOTED_PART = r'^"(?:[^"]++|"")*+"?'
_BLANKS = "".join(map(chr, range(0x21)))


def jtrim(col: Column) -> Column:
    """Strip every character up to U+0020 from both ends (``trim`` strips spaces only)."""
    return F.btrim(col, F.lit(_BLANKS))


def trim_to_null(col: Column) -> Column:
    trimmed = jtrim(col)
    return F.when(F.length(trimmed) > 0, trimmed)


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.length(jtrim(col)) == 0)


def _unquote(field: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(field, _QUOTED_BODY, 1), '""', '"')
    rest = F.regexp_replace(field, _QUOTED_PART, "")
    return F.when(field.startswith('"'), F.concat(body, rest)).otherwise(field)


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, trimmed; lines without quotes take the plain split."""
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), _unquote)
    return F.transform(F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1)), jtrim)


def is_key(col: Column) -> Column:
    return col.rlike(KEY_PATTERN)


def clip(col: Column, size: int) -> Column:
    return F.substring(col, 1, size)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def business_key(voyage_no: Column, cage_no: Column, observed_at: Column) -> Column:
    return F.concat_ws("|", voyage_no, cage_no, iso_seconds(observed_at))


def best_effort_key(fields: Column) -> Column:
    """Key text of a row that failed validation; null when its first two fields are not there."""
    part = lambda i: F.get(fields, F.lit(i))
    usable = (F.size(fields) >= 3) & (F.length(part(0)) > 0) & (F.length(part(1)) > 0)
    return F.when(usable, clip(F.concat_ws("|", part(0), part(1), part(2)), 128))


def derived_no(prefix: str, key: Column) -> Column:
    """A 32-character number that depends on the business key only."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 29))


def transfer_type(col: Column) -> Column:
    """Upper-cased transfer type, TRANSFER where blank."""
    return F.coalesce(F.upper(trim_to_null(col)), F.lit("TRANSFER"))
