"""Key, column and reference checks, and cascading deletes (Q1-Q4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.fixed_values import CONTEXT_TYPE_LENGTH, TEXT_LENGTH, VECTOR_WIDTH
from tracklore.schema import FOREIGN_KEYS, UNIQUE_KEYS, Star

# (column, rule, bound) per table.
COLUMN_RULES = {
    "tracks": [
        ("title", "not_null", None),
        ("uri", "max_length", TEXT_LENGTH),
        ("title", "max_length", TEXT_LENGTH),
        ("album_name", "max_length", TEXT_LENGTH),
        ("album_uri", "max_length", TEXT_LENGTH),
    ],
    "artists": [
        ("name", "not_null", None),
        ("uri", "max_length", TEXT_LENGTH),
        ("name", "max_length", TEXT_LENGTH),
        ("genres", "max_item_length", TEXT_LENGTH),
    ],
    "track_artists": [
        ("track_uri", "not_null", None),
        ("artist_uri", "not_null", None),
    ],
    "played_history": [
        ("played_at", "not_null", None),
        ("played_time", "not_null", None),
        ("track_uri", "max_length", TEXT_LENGTH),
        ("context_type", "max_length", CONTEXT_TYPE_LENGTH),
        ("context_uri", "max_length", TEXT_LENGTH),
    ],
    "audio_features": [("track_uri", "not_null", None)],
    "embeddings": [("track_uri", "not_null", None), ("embedding", "width", VECTOR_WIDTH)],
}


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys stored more than once, with their count. A NULL in a key never conflicts."""
    whole = table
    for key in keys:
        whole = whole.filter(F.col(key).isNotNull())
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def key_counts(star: Star) -> DataFrame:
    """(table_name, n_keys, n_rows, n_repeated) of every table's unique key; rows with a NULL
    in their key count in none."""
    out = None
    for name, keys in UNIQUE_KEYS.items():
        whole = star[name].dropna(subset=keys)
        # One row per key leaves the first aggregate, so a hot key is summed map-side.
        part = whole.groupBy(*keys).agg(F.count("*").alias("n")).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("n_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count_if(F.col("n") > 1).alias("n_repeated"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def column_violations(table: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """(column_name, rule, violations) for each rule, from one pass over the table."""

    def broken(column: str, rule: str, bound):
        c = F.col(column)
        if rule == "not_null":
            return c.isNull()
        if rule == "max_length":
            return F.length(c) > bound
        if rule == "max_item_length":
            return F.exists(c, lambda item: F.length(item) > bound)
        if rule == "width":
            return c.isNotNull() & (F.size(c) != bound)
        raise ValueError(f"unknown rule {rule}")

    counts = table.agg(
        *[F.count_if(broken(*rule)).alias(f"n{i}") for i, rule in enumerate(rules)]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(rule).alias("rule"),
                F.col(f"n{i}").alias("violations"),
            )
            for i, (column, rule, _) in enumerate(rules)
        ]
    )
    return counts.select(F.inline(entries))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "uri") -> DataFrame:
    """Child rows whose reference has no parent row; a NULL reference is allowed."""
    known = parent.select(F.col(parent_key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def all_orphans(star: Star) -> DataFrame:
    """(table_name, column_name, orphan_key, n) over every foreign key."""
    parts = []
    for child, column, parent in FOREIGN_KEYS:
        # Counting per key first leaves one row per key for the anti join.
        keys = star[child].groupBy(column).agg(F.count("*").alias("n"))
        lost = orphans(keys, column, star[parent])
        parts.append(
            lost.select(
                F.lit(child).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.col(column).alias("orphan_key"),
                "n",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cascade_delete(star: Star, table: str, deleted: DataFrame) -> Star:
    """The star without ``deleted`` (a ``uri`` column) and every row that refers to it."""
    gone = deleted.select("uri").distinct()
    left = {name: df for name, df in star.items()}
    left[table] = star[table].join(gone, "uri", "left_anti")
    for child, column, parent in FOREIGN_KEYS:
        if parent == table:
            left[child] = left[child].join(
                gone.withColumnRenamed("uri", column), column, "left_anti"
            ).select(*star[child].columns)
    return Star(**left)
