"""Mixing sources to target weights by hash thresholds.

Every source has a weight; targets share all words in proportion to the weights, but stop
at ``max_epochs`` times what their source holds, and what is over goes to the others by
weight until none is above. A source whose target is e times its words gives every
document floor(e) times, and once more those documents whose hash lies below a threshold:
the thresholds of one, two, three passes are nested, so a larger target keeps what a
smaller one took.

Method: hash-threshold histograms, with DataFrame functions only. Words are summed by
source and leading bits of the documents' hashes, which gives 4,096 sums a source however
many documents it has; the running sum shows the bucket where the budget ends. Only the
documents of that bucket are summed again by the next twelve bits, until a single hash is
left. No row is sorted. The document that holds it gives as many words as are left, so
that a source's words come to its target, rounded down.

Scale. Texts are read once, and a narrow table (id, source, words, hash) is staged.
Histograms are combined in the map tasks. Refining joins on source and bucket, thus a
source with a third of all rows is spread over its buckets; each step reads one row in
4,096 of the source. Thresholds meet the rows by broadcast for the few largest sources
and by a shuffle for the others (joins.join_groups). Sources are numbered by a distributed
sort (ranking.ranked) and only sums reach the driver.

Defined cases: a null or blank text has no words, takes none and moves nothing; a null
source is a source, the last in order; a null id is hashed by its text; rows that share a
hash (repeated rows, repeated ids) share what is left in proportion to their words,
rounded down; a table without words has targets of 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracklore.llm.joins import join_groups
from tracklore.llm.ranking import ranked
from tracklore.session import configure, stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
_HASH_BITS = 60
_STEP_BITS = 12
_WIDE = "decimal(38,0)"


def hash_of(id_col: str, text_col: str) -> Column:
    """60 bits of a document's SHA-256, equal in every run and engine."""
    name = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, _HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, key, size, h): the narrow table that all else works on.

    ``key`` is the source as a string that is never null; no source's key equals another's.
    """
    source = F.col(source_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash_of(id_col, text_col).alias("h"),
    )


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    The level of words per weight rises as sources reach their limit: every round sums the
    sources still below theirs, and ends when no further one reaches it.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    order = [F.col("source").isNull(), F.col("source")]
    place = ((F.col("_rank") - 1) % len(weights)).cast("int")
    table = stage(
        ranked(sources, order, "_rank")
        .withColumn("weight", F.get(cycle, place).cast(_WIDE))
        .withColumn("limit", F.col("source_size").cast(_WIDE) * max_epochs)
        .drop("_rank"),
        "sources",
    )
    sums = table.agg(F.sum(F.col("source_size").cast(_WIDE)).alias("words"), F.sum("weight").alias("weight")).first()
    words, level, share = sums.words or Decimal(0), sums.words or Decimal(0), sums.weight or Decimal(1)
    above, reached = F.lit(False), 0
    while True:
        # limit < level / share * weight, in whole numbers
        now = F.col("limit") * F.lit(share).cast(_WIDE) < F.lit(level).cast(_WIDE) * F.col("weight")
        over = table.filter(now).agg(F.count("*").alias("n"), F.sum("limit").alias("limit"), F.sum("weight").alias("weight")).first()
        if over.n == reached:
            break
        above, reached = now, over.n
        level, share = words - over.limit, sums.weight - over.weight
    free = (F.lit(level).cast(_WIDE) * F.col("weight")).cast("double") / F.lit(float(share))
    return table.withColumn("target", F.when(above, F.col("limit").cast("double")).otherwise(free)).drop("weight", "limit")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, threshold, left, at): documents of ``key`` with a hash below ``threshold``
    hold all words of the budget but ``left``, and those with that hash hold ``at``.

    ``rows`` has key, size and h; ``budgets`` has key and budget, which is below the words
    of the key. Every round looks twelve bits deeper, into one bucket a source.
    """
    inside = rows.filter("size > 0").select("key", "size", "h")
    shift, found = _HASH_BITS, []
    while True:
        shift -= _STEP_BITS
        bucket = F.shiftright("h", shift)
        histogram = inside.groupBy("key", bucket.alias("bucket")).agg(
            F.sum("size").alias("at"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        up_to = F.sum("at").over(Window.partitionBy("key").orderBy("bucket"))  # 4,096 rows a key
        edge = (
            histogram.withColumn("up_to", up_to)
            .join(budgets, "key")
            .filter((F.col("up_to") > F.col("budget")) & (F.col("up_to") - F.col("at") <= F.col("budget")))
            .withColumn("left", F.col("budget") - F.col("up_to") + F.col("at"))
            .select("key", "bucket", "left", "at", "low", "high")
        )
        edge = stage(edge, "edge")
        found.append(edge.filter("low = high").select("key", F.col("low").alias("threshold"), "left", "at"))
        more = edge.filter("low < high")
        if shift <= 0 or more.isEmpty():
            break
        inside = stage(inside.withColumn("bucket", bucket).join(more.select("key", "bucket"), ["key", "bucket"]).drop("bucket"), "inside")
        budgets = more.select("key", F.col("left").alias("budget"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each of ``docs``.

    ``copies`` whole passes over the document are taken, and taken - copies * size words
    more of the one document a source's budget ends in.
    """
    configure(docs.sparkSession)
    rows = stage(sized(docs, id_col, text_col, source_col), "sized")
    sums = stage(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    goals = stage(
        targets(sums, weights, max_epochs)
        .withColumn("budget", budget)
        .withColumn("passes", passes.cast("long"))
        .withColumn("budget", F.col("budget") - F.col("passes") * F.col("source_size")),
        "goals",
    )
    edges = thresholds(rows, goals.select("key", "budget"))
    plan = goals.join(edges, "key", "left").select(
        "key", "source_size", "target", "passes", "threshold", "left", "at", "n"
    )
    plan = stage(plan, "plan")
    total = plan.agg(F.sum("n")).first()[0] or 0
    below = (F.col("h") < F.col("threshold")).cast("long")
    rest = F.expr("cast(cast(left as decimal(20,0)) * size div at as long)")
    copies = F.col("passes") + F.coalesce(below, F.lit(0).cast("long"))
    return (
        join_groups(rows, plan, "key", "n", total)
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size") + F.when((F.col("h") == F.col("threshold")) & (F.col("size") > 0), rest).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )
