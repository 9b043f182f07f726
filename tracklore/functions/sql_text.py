"""Clean-up and audit of SQL statements held in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklore import fixed_values as fx

# The shapes a statement is checked for, in the order of use.
_FENCE_OPEN = r"(?i)^\s*```(?:sql)?\s*"
_FENCE_CLOSE = r"\s*```\s*$"
_COMMENT = r"(?s)/\*.*?\*/|--[^\n]*"
_QUOTED = r"'(?:''|[^'])*'"
_STARTS_AS_QUERY = r"^(select|with)\b"
_WRITES = r"\b(" + "|".join(fx.WRITE_KEYWORDS) + r")\b"
_VIEW = rf"\b{fx.HISTORY_VIEW}\b"
_RELATION = r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def clean_sql(raw: Column) -> Column:
    """Without Markdown fences, outer white space and one trailing semicolon."""
    body = F.regexp_replace(F.regexp_replace(raw, _FENCE_OPEN, ""), _FENCE_CLOSE, "")
    return _strip(F.regexp_replace(_strip(body), r";\z", ""))


def forbidden_relations(normalized: Column) -> Column:
    """Sorted raw tables named after FROM or JOIN."""
    named = F.regexp_extract_all(normalized, F.lit(_RELATION), F.lit(1))
    raw = F.array(*[F.lit(name) for name in fx.RAW_RELATIONS])
    return F.array_sort(F.array_intersect(named, raw))


def audit_sql(sql: Column) -> Column:
    """Why a cleaned statement is refused, or NULL when it may run.

    Comments are dropped and quoted text masked first, so that words and semicolons
    inside a title are not taken for SQL.
    """
    masked = F.regexp_replace(F.regexp_replace(sql, _COMMENT, " "), _QUOTED, "''")
    before, after = fx.REASON_RAW_TABLES.split("{}")

    def reason(masked: Column, normalized: Column, forbidden: Column) -> Column:
        raw_tables = F.concat(F.lit(before), F.array_join(forbidden, fx.LIST_SEPARATOR), F.lit(after))
        return (
            F.when(masked.contains(";"), fx.REASON_SEVERAL)
            .when(~normalized.rlike(_STARTS_AS_QUERY), fx.REASON_NOT_SELECT)
            .when(normalized.rlike(_WRITES), fx.REASON_WRITES)
            .when(~normalized.rlike(_VIEW), fx.REASON_NO_VIEW)
            .when(F.size(forbidden) > 0, raw_tables)
        )

    # Each lambda names a value used several times, so that it is computed once.
    checked = _let(
        masked,
        lambda m: _let(
            F.lower(_strip(m)), lambda n: _let(forbidden_relations(n), lambda f: reason(m, n, f))
        ),
    )
    return F.when(F.coalesce(sql, F.lit("")) == "", fx.REASON_EMPTY).otherwise(checked)
