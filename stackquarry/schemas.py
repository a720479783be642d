"""Schemas of the inputs that are read from files."""

from __future__ import annotations

MANIFEST = (
    "artifacts MAP<STRING, STRUCT<type: STRING, properties: STRUCT<templateFile: STRING>>>"
)
TEMPLATE = "Resources MAP<STRING, VARIANT>, Outputs MAP<STRING, VARIANT>"
METADATA = "Type STRING, FunctionName STRING, Arn STRING"
PAIR = "prompt STRING, completion STRING"
CHUNK = "req_id STRING, chunk_idx BIGINT, response STRING"
