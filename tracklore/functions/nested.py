"""Removal of keys at any depth of nested columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _holds(kind: T.DataType, keys: set[str]) -> bool:
    """Whether any of ``keys`` can occur inside a value of this type."""
    if isinstance(kind, T.StructType):
        return any(f.name in keys or _holds(f.dataType, keys) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, keys)
    return isinstance(kind, (T.MapType, T.VariantType))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


_ROUNDS = "spark.sql.analyzer.maxIterations"
_ROUNDS_PER_LEVEL = 16
# What a JSON text holds beside its brackets; a string may hold brackets too.
_NO_BRACKETS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\[\]{}]++'


def _depth(value: Column) -> Column:
    """How deep objects and arrays lie in each other in a VARIANT value."""
    brackets = F.split(F.regexp_replace(F.to_json(value), _NO_BRACKETS, ""), "")

    def step(state: Column, bracket: Column) -> Column:
        change = F.when(bracket.isin("{", "["), 1).when(bracket.isin("}", "]"), -1).otherwise(0)
        now = state["now"] + change
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(brackets, start, step)["most"]


def _variants(value: Column, kind: T.DataType) -> list[Column]:
    """The depth at each place of a value that holds VARIANT values."""
    if isinstance(kind, T.VariantType):
        return [_depth(value)]
    if isinstance(kind, T.StructType):
        return [d for f in kind.fields for d in _variants(value[f.name], f.dataType)]
    if isinstance(kind, T.MapType):
        return _variants_of_items(F.map_values(value), kind.valueType)
    if isinstance(kind, T.ArrayType):
        return _variants_of_items(value, kind.elementType)
    return []


def _variants_of_items(items: Column, kind: T.DataType) -> list[Column]:
    if not _has_variant(kind):
        return []
    return [F.array_max(F.transform(items, lambda item: F.greatest(F.lit(0), *_variants(item, kind))))]


def _has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_variant(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_variant(kind.valueType)
    return isinstance(kind, T.VariantType)


def _variant_without(value: Column, keys: set[str], depth: int) -> Column:
    """A VARIANT value without ``keys`` in the objects of its first ``depth`` levels; scalars
    keep their types."""
    if not depth:
        return value
    parts = F.struct(
        F.try_variant_get(value, "$", "map<string, variant>").alias("object"),
        F.try_variant_get(value, "$", "array<variant>").alias("list"),
    )

    def rebuilt(part: Column) -> Column:
        fields = F.map_entries(F.map_filter(part["object"], lambda k, v: ~k.isin(*keys)))
        items = F.transform(part["list"], lambda v: F.struct(F.lit("").alias("key"), v.alias("value")))
        clean = F.transform(
            F.coalesce(fields, items),
            lambda e: F.struct(e["key"].alias("key"), _variant_without(e["value"], keys, depth - 1).alias("value")),
        )
        return _let(
            clean,
            lambda c: F.when(part["object"].isNotNull(), F.to_variant_object(F.map_from_entries(c)))
            .when(part["list"].isNotNull(), F.to_variant_object(F.transform(c, lambda e: e["value"])))
            .otherwise(value),
        )

    return _let(parts, rebuilt)


def _without(value: Column, kind: T.DataType, keys: set[str], depth: int) -> Column:
    if not keys or not _holds(kind, keys):
        return value
    if isinstance(kind, T.VariantType):
        return _variant_without(value, keys, depth)
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in keys]
        rebuilt = F.struct(*[_without(value[f.name], f.dataType, keys, depth).alias(f.name) for f in kept])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _without(item, kind.elementType, keys, depth))
    named = F.map_filter(value, lambda k, v: ~k.cast("string").isin(*keys))
    return F.transform_values(named, lambda k, v: _without(v, kind.valueType, keys, depth))


def drop_nested_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df`` without columns, struct fields, map entries and fields of VARIANT objects named
    in ``keys``, at any depth.

    The schema is walked once on the driver; rows are rebuilt by native expressions. VARIANT
    columns have no schema: one pass finds out how deep their values go, and the expression
    is made for that many levels.
    """
    unwanted = set(keys)
    kept = [f for f in df.schema.fields if f.name not in unwanted]
    depths = [d for f in kept for d in _variants(F.col(f"`{f.name}`"), f.dataType)] if unwanted else []
    deepest = (df.agg(F.max(F.greatest(F.lit(0), *depths))).first()[0] or 0) if depths else 0
    columns = [_without(F.col(f"`{f.name}`"), f.dataType, unwanted, deepest).alias(f.name) for f in kept]
    # Spark resolves expressions in each other from outside in, some per round; select does so.
    conf = df.sparkSession.conf
    rounds = conf.get(_ROUNDS)
    try:
        conf.set(_ROUNDS, str(max(int(rounds), _ROUNDS_PER_LEVEL * (deepest + 2))))
        return df.select(*columns)
    finally:
        conf.set(_ROUNDS, rounds)
