"""Casts of spelled values ('12', '/Name', '(text)', '<48>', '[1 2]', '3 0 R'), null where a value is of another kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def kind(v: Column) -> Column:
    """null, bool, int, real, ref, name, string, array, dict: what a spelled value is."""
    return (
        F.when(v == "null", "null")
        .when(v.isin("true", "false"), "bool")
        .when(v.rlike(r"^[+-]?\d+$"), F.when(F.try_to_number(v, F.lit("S9999999999999999999")).between(-(2**63), 2**63 - 1), "int").otherwise("real"))
        .when(v.rlike(NUMBER), "real")
        .when(v.rlike(r"^\d+ \d+ R$"), "ref")
        .when(v.startswith("/"), "name")
        .when(v.startswith("<<"), "dict")
        .when(v.startswith("(") | v.startswith("<"), "string")
        .when(v.startswith("["), "array")
    )


def to_bool(v: Column) -> Column:
    return F.when(v == "true", True).when(v == "false", False)


def to_int(v: Column) -> Column:
    """An integer, or a real without a fraction."""
    return F.when(kind(v) == "int", v.try_cast("long")).when((kind(v) == "real") & (v.try_cast("double") == F.floor(v.try_cast("double"))), v.try_cast("double").cast("long"))


def to_float(v: Column) -> Column:
    return F.when(kind(v).isin("int", "real"), v.try_cast("double"))


def to_name(v: Column) -> Column:
    return F.when(v.startswith("/"), F.substring(v, F.lit(2), F.length(v)))


def _unescaped(v: str | None) -> bytes | None:
    from quire.kernels.syntax import parse

    return None if v is None else parse(v.encode("latin-1"))[0]


def to_bytes(v: Column) -> Column:
    """A string's bytes. Hexadecimal ones and those without escapes are settled by Catalyst."""
    hexed, plain = v.rlike(r"^<[0-9A-Fa-f\s]*>$"), v.rlike(r"(?s)^\([^\\\r()]*\)$")
    digits = F.regexp_replace(v, r"[<>\s]", "")
    read = F.udf(_unescaped, "binary", useArrow=True)(F.when(v.startswith("(") & ~plain, v))
    whole = F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
    return F.when(hexed, whole).when(plain, F.encode(F.substring(v, F.lit(2), F.length(v) - 2), "ISO-8859-1")).otherwise(read)
