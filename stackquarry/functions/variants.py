"""Strict reading of VARIANT fields.

``variant_get(..., 'string')`` would turn the number 5 or an object into text.
Names and types only count when they are real JSON strings, so the type of the
field is tested before its value is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, VOID (JSON null), ARRAY<..>, OBJECT<..>; NULL when absent."""
    return F.schema_of_variant(value)


def decodes_as_object(value: Column) -> Column:
    """True for a JSON object or JSON null; False for other values and broken text."""
    return F.coalesce(F.startswith(kind(value), F.lit("OBJECT")) | (kind(value) == "VOID"), F.lit(False))


def text_or_null(value: Column, path: str) -> Column:
    """The field when it is a JSON string, else NULL."""
    return F.when(kind(field(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def absent(value: Column, path: str) -> Column:
    """True when the field is missing or JSON null."""
    return F.coalesce(kind(field(value, path)) == "VOID", F.lit(True))


def container_fits(value: Column, path: str, wanted: str) -> Column:
    """True when an OBJECT or ARRAY can be decoded there: one, JSON null or missing."""
    found = kind(field(value, path))
    return F.coalesce(F.startswith(found, F.lit(wanted)) | (found == "VOID"), F.lit(True))


def text_fits(value: Column, path: str) -> Column:
    """True when a text field can be decoded: a string, JSON null or missing."""
    return F.coalesce(kind(field(value, path)).isin("STRING", "VOID"), F.lit(True))
