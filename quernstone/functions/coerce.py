"""Coercion of raw profile fields: malformed values become null, nothing raises under ANSI rules."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE = T.StructType([T.StructField("code", T.StringType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())])
ADDRESS = T.StructType([T.StructField(c, T.StringType()) for c in ("country_code", "region_name", "town")])


def as_double(c: Column) -> Column:
    """A finite number or null; JSON booleans count as 1 and 0."""
    text = F.lower(F.trim(c.cast("string")))
    value = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def as_long(c: Column) -> Column:
    """As as_double, cut towards zero."""
    return as_double(c).try_cast("bigint")


def as_boolean(c: Column) -> Column:
    """Only JSON booleans; c is a field that was read as a string."""
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))


def as_texts(c: Column) -> Column:
    """c is JSON text of a list, or one string: a list is trimmed and its blanks dropped, a string stays as it is."""
    items = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    cleaned = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    is_list = F.ltrim(c).startswith("[")
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<string>")).when(is_list, F.coalesce(cleaned, F.array().cast("array<string>"))).otherwise(F.array(c))


def literal_json(c: Column) -> Column:
    """JSON of a mapping or list that was printed as a Python literal; JSON itself passes, anything else gives null.

    Single quotes are read by from_json directly; only rows with bare None, True or False need this Arrow function.
    """

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or not v.strip():
                return None
            for parse in (ast.literal_eval, json.loads):
                try:
                    out = parse(v)
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                    continue
                if isinstance(out, (dict, list, tuple)):
                    return json.dumps(out)
            return None

        return values.map(one)

    return convert(c)


LITERAL = r"\b(None|True|False)\b"


def json_like(c: Column) -> Column:
    return F.when(c.rlike(LITERAL), literal_json(c)).otherwise(c)


def as_address(c: Column) -> Column:
    return F.from_json(c, ADDRESS, {"allowSingleQuotes": "true"})


def as_code(s: Column) -> Column:
    """A struct of code, label, share; without a code it is null."""
    code = F.trim(s["code"])
    return F.when(code != "", F.struct(code.alias("code"), F.coalesce(F.trim(s["label"]), F.lit("")).alias("label"), s["share"].alias("share")))


def as_codes(c: Column) -> Column:
    """One object or a list of them; those without a code are dropped."""
    options = {"allowSingleQuotes": "true"}
    one, many = F.array(F.from_json(c, CODE, options)), F.from_json(c, T.ArrayType(CODE), options)
    items = F.when(F.ltrim(c).startswith("{"), one).otherwise(many)
    return F.coalesce(F.filter(F.transform(items, as_code), lambda x: x.isNotNull()), F.array().cast(T.ArrayType(CODE)))


def completeness() -> Column:
    """Share of nine fields that are present in a row of the companies schema; 0 and false count as present."""
    there = [F.col(c).isNotNull() for c in ("year_founded", "country_code", "employee_count", "revenue", "primary_code", "is_public")]
    there += [F.coalesce(F.col("description") != "", F.lit(False)), F.coalesce(F.size("business_model") > 0, F.lit(False)), F.coalesce(F.size("core_offerings") > 0, F.lit(False))]
    return sum((t.cast("int") for t in there), F.lit(0)) / F.lit(9.0)
