"""Typed access to the fields of one export record held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklore.functions.timestamps import WHITESPACE

# JSON texts that count as "no value" although they are not null.
_EMPTY_JSON = r"^(false|-?0(\.0+)?([eE][+-]?\d+)?|\[\]|\{\})$"
_INTEGER_TEXT = r"^[+-]?\d+(_\d+)*$"
_INT_MAX = 2147483647
_FAR_BELOW = -(10**15)


def is_object(record: Column) -> Column:
    return F.schema_of_variant(record).startswith("OBJECT")


def text_value(value: Column, kind: Column) -> Column:
    """A field when it is a JSON string, else NULL. ``kind`` is its variant type."""
    return F.when(kind == "STRING", value.cast("string"))


def scalar_text(value: Column, kind: Column) -> Column:
    """A field as text when it is a JSON string, number or boolean, else NULL."""
    other = F.when(~kind.rlike("^(VOID|OBJECT|ARRAY)"), F.to_json(value))
    return F.when(kind == "STRING", value.cast("string")).otherwise(other)


def is_wrong_type(value: Column, kind: Column) -> Column:
    """True when a text field holds a non-empty value of another JSON type."""
    return F.when(kind.isin("STRING", "VOID") | kind.isNull(), False).otherwise(
        ~F.to_json(value).rlike(_EMPTY_JSON)
    )


def duration_ms(value: Column, kind: Column) -> Column:
    """Whole milliseconds, truncated toward zero; NULL when not a number.

    Values too negative for a bigint become one large negative value; they count as no
    playback like every negative one.
    """

    def from_text(text: Column) -> Column:
        return F.when(
            text.rlike(_INTEGER_TEXT),
            F.coalesce(
                F.regexp_replace(text, "_", "").try_cast("bigint"),
                F.when(text.startswith("-"), F.lit(_FAR_BELOW)),
            ),
        )

    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        .when(kind == "STRING", from_text(F.btrim(value.cast("string"), F.lit(WHITESPACE))))
        .when(
            kind.rlike("^(DECIMAL|DOUBLE|BOOLEAN)"),
            F.when(number <= F.lit(float(_FAR_BELOW)), F.lit(_FAR_BELOW)).when(
                number < F.lit(1e15), F.try_variant_get(value, "$", "bigint")
            ),
        )
    )


def clamp_duration(ms: Column) -> Column:
    """Negative playback counts as none; NULL when the value exceeds an INT."""
    return F.when(ms <= _INT_MAX, F.greatest(ms, F.lit(0)).cast("int"))
