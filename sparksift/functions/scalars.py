"""Scalar functions on Columns: checksums, prefixes, entropy, masks, byte views."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ABSENT = {3, 5, 7, 9, 13, 16, 18, 21, 23, 28, 29, 32, 39, 41, 43, 47, 50, 53, 55, 57, 59, 61, 63, 65, 69, 71, 73, 76, 78, 81, 85, 88, 90}
PROVINCES = tuple(f"{n:03d}" for n in range(1, 97) if n not in _ABSENT)
BANK4, BANK3 = ("1014", "1015", *(str(n) for n in range(9701, 9710))), ("122", "211", "340", "502")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    d = digits_only(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def vn_cccd_prefix(c: Column) -> Column:
    d = digits_only(c)
    return (F.length(d) == 12) & F.substring(d, 1, 3).isin(*PROVINCES)


def vn_bank_prefix(c: Column) -> Column:
    d = digits_only(c)
    return F.length(d).between(9, 16) & (F.substring(d, 1, 4).isin(*BANK4) | F.substring(d, 1, 3).isin(*BANK3) | F.startswith(d, F.lit("1")))


#: Validators by name. Names that aren't here are ignored.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"luhn": luhn, "vn_cccd_prefix": vn_cccd_prefix, "vn_bank_prefix": vn_bank_prefix}


def rule_prefix(rule_id: Column) -> Column:
    """The id without a trailing _NNN."""
    return F.regexp_replace(rule_id, r"_[0-9]+$", "")


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def latin1(binary: Column) -> Column:
    """One character per byte."""
    return F.decode(binary, "ISO-8859-1")


def byte_view(text: Column) -> Column:
    return latin1(F.encode(text, "UTF-8"))


def byte_slice(binary: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary, from 0."""
    return F.substring(binary, (start + 1).cast("int"), (end - start).cast("int"))


def mask(text: Column) -> Column:
    """First and last four bytes with **** between, or **** alone."""
    b = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    return F.when(n <= 8, "****").otherwise(F.make_valid_utf8(F.concat(F.substring(b, 1, 4).cast("string"), F.lit("****"), F.substring(b, -4, 4).cast("string"))))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column, and where each value starts; the last offset ends the last."""
    wide = np.int64 if "large" in str(column.type) else np.int32
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), o


@F.arrow_udf(T.DoubleType())
def entropy(binary: pa.Array) -> pa.Array:
    """Shannon entropy of the bytes, in bits; 0 for none, null for null."""
    data, o = arrow_bytes(binary)
    out = np.zeros(len(binary))
    for i in np.flatnonzero(np.diff(o)).tolist():
        counts = np.bincount(data[o[i] : o[i + 1]])
        p = counts[counts > 0] / (o[i + 1] - o[i])
        out[i] = -(p * np.log2(p)).sum()
    return pa.array(out, pa.float64(), mask=binary.is_null().to_numpy(zero_copy_only=False))


def parse_bytes(c: Column) -> Column:
    """Sizes such as 1.5MB, in binary units, or plain numbers; null if it is neither."""
    t = F.upper(F.trim(c))
    number, unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*(KB|MB|GB|B)?$", 1), F.regexp_extract(t, r"^[0-9.]+\s*(KB|MB|GB|B)?$", 1)
    scale = F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1)
    return F.when(number != "", (number.cast("double") * scale).cast("long"))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def normal_path(c: Column) -> Column:
    """Forward slashes, no leading ./, cut to the last folder `testdata`."""
    p = F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), r"^\./", "")
    return F.regexp_replace(p, r"^.*?(testdata/)", "$1")
