"""Joins of a large fact table whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is hot, so there are at most
# 1 / HOT_SHARE hot keys: that bounds what is broadcast below. Keys under it that still
# fill a partition are split at run time by adaptive execution.
HOT_SHARE = 0.002
# A hot key is spread over as many salts as it holds multiples of this many rows.
ROWS_PER_SALT = 1_000_000
# Entries per frequency sketch; the error of a share is below half of HOT_SHARE.
_TRACKED = 4096
_SKETCH_GROUPS = 512
_NULL_SALTS = 65536

MAX_BROADCAST_ROWS = 100_000


def broadcast_rows(df: DataFrame, rows: int) -> DataFrame:
    """Mark a frame of at most ``rows`` rows for broadcast if that is few; otherwise
    leave the choice to Spark."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def hot_keys(
    facts: DataFrame, key: str, share: float = HOT_SHARE, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """(key, salts) of keys with more than about ``share`` of the rows and rows for more
    than one salt; at most 1/share rows.

    Every task sums its rows up in one small sketch and sketches are merged in two
    steps, so next to nothing is shuffled. Counts are estimates; a key wrongly called
    hot, or missed, changes how rows are spread but never the result.
    """
    task = F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS))
    sketches = (
        facts.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), task.alias("task"))
        .groupBy("task")
        .agg(
            F.expr(f"approx_top_k_accumulate(k, {_TRACKED})").alias("sketch"),
            F.count("*").alias("n"),
        )
    )
    # Grouped, so that no rows give no sketch instead of an empty one to combine.
    merged = sketches.groupBy(F.lit(0).alias("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {_TRACKED})").alias("sketch"),
        F.sum("n").alias("total"),
    )
    top = F.expr(f"approx_top_k_estimate(sketch, {int(1 / share)})")
    count = F.col("top.count")
    return (
        merged.select("total", F.explode(top).alias("top"))
        .filter((count > F.col("total") * share) & (count > rows_per_salt))
        .select(F.col("top.item").alias(key), F.ceil(count / rows_per_salt).alias("_salts"))
    )


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    key: str,
    salt_by: Sequence[str],
    how: str = "inner",
    share: float = HOT_SHARE,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``facts`` joined (inner or left) to ``dims`` (unique on ``key``) with hot keys
    spread out.

    Rows of a hot key go to different partitions by a hash of ``salt_by``, a function of
    the row so that a re-run task sends it to the same place; the one dimension row of
    that key is repeated once per salt. Rows without a key, which match nothing, are
    spread too. All other rows join as usual.
    """
    hot = F.broadcast(hot_keys(facts, key, share, rows_per_salt))
    spread = F.xxhash64(*salt_by)
    salt = (
        F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
        .when(F.col(key).isNull(), F.pmod(spread, F.lit(_NULL_SALTS)))
        .otherwise(0)
    )
    left = facts.join(hot, key, "left").withColumn("_salt", salt.cast("bigint"))
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    right = dims.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    )
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")
