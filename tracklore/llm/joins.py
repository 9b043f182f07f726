"""Joins of rows to their groups where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A group with more than one row in this many is hot; so there are fewer hot groups.
HOT_PARTS = 1000


def is_hot(size: str, total: int) -> F.Column:
    """Whether a group holds so many of ``total`` rows that its rows should not move."""
    return F.col(size) * HOT_PARTS > total


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``groups`` (unique on ``key``, with their number of rows).

    Groups of more than total / HOT_PARTS rows, of which there are fewer than HOT_PARTS
    however large the input, are broadcast, so their rows never move; all others meet in a
    shuffle in which no key is large. Rows without a key keep nulls and don't move either.
    """
    large = is_hot(size, total)
    hot = F.broadcast(groups.filter(large))
    near = rows.join(hot, key)
    rest = rows.filter(F.col(key).isNotNull()).join(F.broadcast(groups.filter(large).select(key)), key, "left_anti")
    far = rest.join(groups.filter(~large), key, "left")
    added = [c for c in groups.columns if c != key]
    none = rows.filter(F.col(key).isNull()).select(
        "*", *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in added]
    )
    return near.unionByName(far).unionByName(none)


def join_marked(rows: DataFrame, groups: DataFrame, key: str, hot: str) -> DataFrame:
    """``rows`` inner-joined to ``groups`` (unique on ``key``), where both say in ``hot``
    whether the group was hot (is_hot) when that was found out, so no join has to."""
    near = rows.filter(hot).join(F.broadcast(groups.filter(hot)), [key, hot])
    return near.unionByName(rows.filter(~F.col(hot)).join(groups.filter(~F.col(hot)), [key, hot]))


def free_name(df: DataFrame, start: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while start.lower() in taken:
        start += "_"
    return start
