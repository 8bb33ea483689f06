"""Reading JSON text of any length: no limit on a string, strict about what counts as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark's reader stops at strings of 20 million characters unless told otherwise.
READ = {"maxStringLen": "2147483647", "allowSingleQuotes": "false"}
_BAD = "_unreadable"


def read_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, READ)


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object. The probe asks for no member that could have a wrong type,
    so only broken text counts as unreadable."""
    probe = F.from_json(text, f"`{_BAD}` STRING", {**READ, "columnNameOfCorruptRecord": _BAD})
    return F.coalesce(text.rlike(r"^\s*\{") & probe.isNotNull() & probe[_BAD].isNull(), F.lit(False))
