"""Loose-number rules applied to model answers held as VARIANT values.

A missing field and an explicit null behave differently (missing is not a
number, null counts as 0), which is why answers stay VARIANT until here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import let, trim_ws


def parse_answer(text: Column) -> Column:
    """JSON text -> VARIANT; NULL when it does not parse."""
    return F.try_parse_json(text)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind_of(v: Column) -> Column:
    """Type word of a VARIANT: STRING, BIGINT, OBJECT, ARRAY, VOID, ... NULL if missing."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_items(v: Column) -> Column:
    """Elements when the value is an array, else an empty array."""
    return let(
        v,
        lambda x: F.coalesce(
            F.when(kind_of(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")),
            F.array().cast("array<variant>"),
        ),
    )


def is_truthy(v: Column) -> Column:
    def judge(x: Column) -> Column:
        return let(kind_of(x), lambda kind: let(as_text(x), lambda text: of_text(kind, text)))

    def of_text(kind: Column, text: Column) -> Column:
        return F.coalesce(
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "STRING", text != "")
            .when(kind == "BOOLEAN", text == "true")
            .when(kind.isin("OBJECT", "ARRAY"), F.lit(True))
            .otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)) != 0.0),
            F.lit(False),
        )

    return let(v, judge)


def _number_of_text(text: Column) -> Column:
    based = lambda letter, digits, base: F.when(
        text.rlike(f"^0[{letter}{letter.upper()}][{digits}]+$"), F.conv(F.substring(text, 3, 1000), base, 10).try_cast("double")
    )
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.coalesce(
        F.when(text == "", F.lit(0.0)), plain, based("x", "0-9a-fA-F", 16), based("o", "0-7", 8), based("b", "01", 2)
    )


def to_number(v: Column) -> Column:
    """Finite double, or NULL for anything that is not a finite number.

    Hexadecimal, octal and binary texts count; an array is the number of its text: 0 when empty,
    its element's when it has one string, number or NULL, else none.
    """

    def of_array(items: Column) -> Column:
        inner = kind_of(F.get(items, F.lit(0)))
        text = trim_ws(as_text(F.get(items, F.lit(0))))
        one = F.when(inner == "VOID", F.lit(0.0)).when(
            ~inner.isin("OBJECT", "ARRAY", "BOOLEAN"), let(text, _number_of_text)
        )
        return F.when(F.size(items) == 0, F.lit(0.0)).when(F.size(items) == 1, one)

    def of_kind(x: Column, kind: Column, text: Column) -> Column:
        finite = let(_number_of_text(text), lambda n: F.when(F.abs(n) < F.lit(float("inf")), n))
        return (
            F.when(kind == "VOID", F.lit(0.0))
            .when(kind == "BOOLEAN", (text == "true").cast("double"))
            .when(kind == "ARRAY", let(as_items(x), of_array))
            .when(kind == "OBJECT", F.lit(None).cast("double"))
            .when((kind == "STRING") & (text == ""), F.lit(0.0))
            .otherwise(finite)
        )

    # bound once each: Catalyst copies an expression to every place that refers to it
    return let(v, lambda x: let(kind_of(x), lambda kind: let(trim_ws(as_text(x)), lambda text: of_kind(x, kind, text))))
