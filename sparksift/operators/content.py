"""What raw file contents are: binary or not, their encoding, their text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import latin1

BINARY_EXTENSIONS = ("pdf", "zip", "doc", "docx", "xls", "xlsx")
MAGIC = ("25504446", "504B0304", "7F454C46", "4D5A", "89504E470D0A1A0A", "474946383761", "474946383961", "FFD8FF")
HEAD, PARITY = 4096, 512


def is_binary(ext: Column, content: Column) -> Column:
    """By extension, by magic bytes, or because more than a twentieth of the first 4096 bytes are NUL."""
    head = F.substring(content, 1, HEAD)
    start = F.hex(F.substring(content, 1, 8))
    magic = F.lit(False)
    for m in MAGIC:
        magic = magic | F.startswith(start, F.lit(m))
    v = latin1(head)
    nul = F.length(v) - F.length(F.replace(v, F.lit("\0"), F.lit("")))
    return F.lower(ext).isin(*BINARY_EXTENSIONS) | magic | ((F.length(v) > 0) & (nul > F.floor(F.length(v) / 20)))


def _zeros(content: Column, odd: bool) -> Column:
    v = latin1(F.substring(content, 1, PARITY))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda i: (i % 2 == (0 if odd else 1)) & (F.substr(v, i, F.lit(1)) == F.lit("\0"))))


def encoding(content: Column) -> Column:
    """utf8, utf16le, utf16be or windows1252."""
    start = F.hex(F.substring(content, 1, 3))
    even, odd = _zeros(content, False), _zeros(content, True)
    return (
        F.when(F.startswith(start, F.lit("EFBBBF")), "utf8").when(F.startswith(start, F.lit("FFFE")), "utf16le").when(F.startswith(start, F.lit("FEFF")), "utf16be")
        .when(F.is_valid_utf8(content.cast("string")), "utf8").when((odd > 8) & (odd > even * 2), "utf16le").when((even > 8) & (even > odd * 2), "utf16be").otherwise("windows1252")
    )


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series, enc: pd.Series) -> pd.Series:
    """Text in the given encoding, without a byte-order mark."""
    codecs = {"utf8": "utf-8", "utf16le": "utf-16-le", "utf16be": "utf-16-be", "windows1252": "cp1252"}
    return pd.Series([None if c is None else bytes(c).decode(codecs[e], "replace").removeprefix("﻿") for c, e in zip(content, enc)])
