"""Licence scans by sentence rules.

Method: sentence-rule recognition. Every known licence sentence is normalised to its
lower-cased words and has an identifier. Texts are cut into words the same way, so comment
signs, line breaks, quotes and spacing do not matter; a sentence may begin and end where a
line, a sentence or a mark-up tag does. At each beginning whose first two words open a known
sentence the longest known sentence is looked up by its words (exactly, no hashes decide)
and mapped to its identifier. Identifiers found in a document, in order, are matched with
the rules: a licence is found where the sentences of its rule follow each other in their
order, each at most ``max_gap`` words after the one before. A sentence may be repeated, and
others may stand between. Of two matches one inside the other only the outer one counts,
thus three BSD clauses are not two.

Scale. Recognition is one pass over whole texts without a shuffle. Only recognised
sentences leave it; they meet the rules by broadcast (a fixed table), are shuffled by
document and rule, and matches by document. The sentence and rule tables are parameters
and are of fixed size. Documents without any known sentence do not move.

Defined cases: a null, empty or blank text holds no licence; a sentence that is cut off or
reworded is unknown; every row is judged by itself, equal rows get equal results; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracklore.llm.license_table import LICENCES, rule_table, sentence_table
from tracklore.llm.text_arrays import LOWER, batches, flat, hasher, non_alphanumeric, prepare, words
from tracklore.session import stage

MAX_GAP = 60
_BATCH_BYTES = 4 << 20
_SEED = 50
# What lies between two words: a line or tag ends the sentence, so does a stop with a space.
_EDGE, _STOP, _SPACE = 1, 2, 4


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for signs, kind in ((b"\n\r\x0b\x0c<>|", _EDGE), (b".;:!?", _STOP), (b" \t\n\r\x0b\x0c", _SPACE)):
        table[list(signs)] |= kind
    return table


def edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether a sentence may begin at each word; one more entry for the end of all texts."""
    n = len(starts)
    out = np.ones(n + 1, bool)
    if n > 1:
        kinds = np.r_[_classes()[data], np.uint8(0)]
        between = np.bitwise_or.reduceat(kinds, np.stack([ends[:-1], starts[1:]], 1).ravel())[::2]
        # reduceat gives the one value at its start where nothing lies between
        between = np.where(ends[:-1] < starts[1:], between, 0)
        both = _STOP | _SPACE
        out[1:n] = (between & _EDGE > 0) | (between & both == both)
    out[cuts] = True
    return out


def normalised(text: str) -> list[bytes]:
    data, offsets = flat(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = words(data, offsets, non_alphanumeric())
    return [data[a:b].tobytes() for a, b in zip(starts, ends)]


class Sentences:
    """The known sentences as an exact table of word sequences."""

    def __init__(self, table: list[tuple[str, str]]):
        self.known, lengths = {}, {}
        for name, text in table:
            split = normalised(text)
            if len(split) < 2:
                raise ValueError(f"a known sentence has two words at least: {text!r}")
            if self.known.setdefault(tuple(split), name) != name:
                raise ValueError(f"two identifiers for {text!r}")
            lengths.setdefault(tuple(split[:2]), set()).add(len(split))
        self.lengths = {pair: sorted(sizes, reverse=True) for pair, sizes in lengths.items()}
        raw = b" ".join(w for pair in self.lengths for w in pair) + b" "
        data, offsets = flat(pa.array([raw]))
        starts, ends, _ = words(data, offsets, non_alphanumeric())
        self.openings = hasher(_SEED).words(data, starts, ends).reshape(-1, 2)

    def find(self, texts: pa.Array) -> tuple[list[list[tuple[str, int, int]]], np.ndarray]:
        """(identifier, first word, word after the last) of the sentences of each text, in
        order and apart, and the words of each text."""
        data, offsets = flat(texts)
        data = LOWER[data]
        starts, ends, cuts = words(data, offsets, non_alphanumeric())
        edge = edges(data, starts, ends, cuts)
        found = [[] for _ in range(len(texts))]
        if len(starts) < 2:
            return found, np.diff(cuts)
        hashes = hasher(_SEED).words(data, starts, ends)
        opening = np.zeros(len(starts), bool)
        # First words alone leave little to look at; the pair is then compared as words.
        opening[:-1] = edge[:-2] & np.isin(hashes[:-1], self.openings[:, 0]) & np.isin(hashes[1:], self.openings[:, 1])
        at = np.flatnonzero(opening)
        owner = np.searchsorted(cuts, at, "right") - 1
        free = 0
        for i, text in zip(at.tolist(), owner.tolist()):
            if i < free:
                continue
            last = int(cuts[text + 1])
            word = lambda j: data[starts[j] : ends[j]].tobytes()
            for size in self.lengths.get((word(i), word(i + 1)), ()):
                if i + size <= last and edge[i + size]:
                    name = self.known.get(tuple(word(j) for j in range(i, i + size)))
                    if name:
                        found[text].append((name, i - int(cuts[text]), i + size - int(cuts[text])))
                        free = i + size
                        break
        return found, np.diff(cuts)


def recognise(table: list[tuple[str, str]]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sentences(table)
        for batch in batches(source):
            found, n_words = known.find(batch.column("text"))
            lists = pa.array(
                [[{"sentence": s, "start": a, "stop": b} for s, a, b in one] for one in found],
                pa.list_(pa.struct([("sentence", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), lists],
                ["row", "doc_id", "n_words", "sentences"],
            )

    return run


def matched(sentences: DataFrame, rules: list[tuple[str, list[str]]], max_gap: int = MAX_GAP) -> DataFrame:
    """(row, licence, start, stop) of the rules that hold in sentences (row, sentence,
    start, stop), without matches that lie inside another one."""
    spark = sentences.sparkSession
    steps = [(k, licence, s, i, len(r)) for k, (licence, r) in enumerate(rules) for i, s in enumerate(r)]
    steps = spark.createDataFrame(steps, "rule int, licence string, sentence string, step int, steps int")
    chain = Window.partitionBy("row", "rule").orderBy("start")
    before = F.lag("step").over(chain)
    near = F.col("start") - F.lag("stop").over(chain) <= max_gap
    goes_on = near & (before.isNotNull()) & ((F.col("step") == before + 1) | ((F.col("step") == before) & (F.col("step") > 0)))
    own = (
        sentences.join(F.broadcast(steps), "sentence")  # a fixed table
        .withColumn("new", F.when(goes_on, 0).otherwise(1))
        .withColumn("chain", F.sum("new").over(chain))
        .groupBy("row", "rule", "licence", "steps", "chain")
        .agg(F.min("step").alias("low"), F.max("step").alias("high"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        .filter("low = 0 AND high = steps - 1")
        .groupBy("row", "licence", "start", "stop")
        .agg(F.max("steps").alias("steps"))
    )
    # Sorted by start, the longer first: a match lies inside an earlier one if that reaches as far.
    earlier = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("steps"), "licence")
    reach = F.max("stop").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    return (
        own.withColumn("reach", reach)
        .filter(F.col("reach").isNull() | (F.col("stop") > F.col("reach")))
        .select("row", "licence", "start", "stop")
    )


def scan(
    docs: DataFrame,
    table: list[tuple[str, str]] | None = None,
    rules: list[tuple[str, list[str]]] | None = None,
    max_gap: int = MAX_GAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, sentences, matches), a row for each of ``docs``.

    ``sentences`` (sentence, start, stop) and ``matches`` (licence, start, stop) come in
    order; places are numbers of words.
    """
    prepare(docs.sparkSession, _BATCH_BYTES)
    table = sentence_table() if table is None else table
    rules = rule_table() if rules is None else rules
    kind = docs.schema[id_col].dataType.simpleString()
    item = "array<struct<{}:string,start:long,stop:long>>".format
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    schema = f"row long, doc_id {kind}, n_words long, sentences {item('sentence')}"
    found = stage(numbered.mapInArrow(recognise(table), schema), "sentences")
    some = F.size("sentences") > 0
    matches = (
        matched(found.filter(some).select("row", F.inline("sentences")), rules, max_gap)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "stop", "licence"))).alias("m"))
        .select("row", F.transform("m", lambda m: F.struct(m["licence"], m["start"], m["stop"])).alias("matches"))
    )
    none = F.array().cast(item("licence"))
    with_some = found.filter(some).join(matches, "row", "left").withColumn("matches", F.coalesce("matches", none))
    columns = ["doc_id", "n_words", "sentences", "matches"]
    return found.filter(~some).withColumn("matches", none).select(columns).unionByName(with_some.select(columns))


def families(licences) -> object:
    """The families of a column of licence names, distinct and sorted."""
    table = F.create_map(*[F.lit(x) for name, (family, _) in LICENCES.items() for x in (name, family)])
    return F.array_sort(F.array_distinct(F.transform(licences, lambda x: F.coalesce(F.element_at(table, x), F.lit("unknown")))))
