"""The scalar functions for SQL, as temporary functions whose bodies Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalars import BANK3, BANK4, PROVINCES

_list = lambda xs: ", ".join(f"'{x}'" for x in xs)

FUNCTIONS = {
    "digits_only(v STRING) RETURNS STRING": "regexp_replace(v, '[^0-9]', '')",
    "luhn_valid(v STRING) RETURNS BOOLEAN": "length(digits_only(v)) BETWEEN 13 AND 19 AND luhn_check(digits_only(v))",
    "cccd_valid(v STRING) RETURNS BOOLEAN": f"length(digits_only(v)) = 12 AND substr(digits_only(v), 1, 3) IN ({_list(PROVINCES)})",
    "bank_valid(v STRING) RETURNS BOOLEAN": f"length(digits_only(v)) BETWEEN 9 AND 16 AND (substr(digits_only(v), 1, 4) IN ({_list(BANK4)}) OR substr(digits_only(v), 1, 3) IN ({_list(BANK3)}) OR startswith(digits_only(v), '1'))",
    "mask_preview(v STRING) RETURNS STRING": "CASE WHEN octet_length(v) <= 8 THEN '****' ELSE make_valid_utf8(concat(cast(substr(encode(v, 'UTF-8'), 1, 4) AS STRING), '****', cast(substr(encode(v, 'UTF-8'), -4, 4) AS STRING))) END",
    "level_label(c INT) RETURNS STRING": "CASE c WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'RESTRICTED' ELSE 'PUBLIC' END",
    "rule_prefix(v STRING) RETURNS STRING": "regexp_replace(v, '_[0-9]+$', '')",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
