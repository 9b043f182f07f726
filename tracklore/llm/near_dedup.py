"""Near duplicates by bottom-k sketches of one hash function.

A text's set holds its distinct shingles of five words (lower-cased A-Z); texts are linked
at a Jaccard similarity of 0.75 or more and grouped into connected components.

1. Every shingle is hashed once; the ``k`` smallest hashes of a set are its sketch. Texts
   with equal sets form a class and are handled once.
2. Inverted lists of retained values. Two linked sets share a known number of retained
   values (certainly for sets of up to 0.75 k shingles; a larger pair at 0.75 exactly
   fails with a chance of 3e-8, one at 0.8 with 4e-11), so each class is listed only under
   its rarest values, few enough that linked classes still meet. Rarity comes from a
   count-min sketch of all retained values: those held by one class only make no list, the
   very common come last.
3. The full sets of listed classes are stored once, each from one text of its class; the
   other texts are not hashed again.
4. In each list all classes are first compared with its first member. Pairs go whose union
   sketch holds fewer shared values than linked sets have (the same event as in 2, so it
   adds no chance); the others are compared exactly on their full sets. Lists whose members
   are then in different components get another leader, drawn by a hash, as long as that
   links enough; then they are compared pair by pair, across components only, so that no
   further link is lost and large groups of alike texts never make all their pairs.
5. Components by star contraction; each class takes its component to all its texts.

Defined cases: a text of fewer than five words has one shingle of all its words; one
without words, or null, has an empty set, is linked with nothing and is its own
component; null ids are larger than all others; equal rows share a component; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import count_min
from tracklore.llm.components import components
from tracklore.llm.joins import free_name, is_hot, join_groups, join_marked
from tracklore.llm.scratch import dispose
from tracklore.llm.text_arrays import LOWER, U64, batches, binaries, flat, hasher, prepare, ragged, spaces, words
from tracklore.session import stage

SHINGLE = 5
K = 64
# Linked sets share this many of the K values of their union's sketch, but for a chance
# below 1e-7; so their sketches share them, and their estimate is no lower.
_SHARED = 28
_ESTIMATE = _SHARED / K
_COMMON = 32
# Rounds of comparing open lists with a leader, and one in how many pairs must be linked
# for another round to be worth its while; what is left is compared pair by pair.
_ROUNDS = 3
_WORTHWHILE = 100
_BLOCK = 8192
_TILE = 1024
_COLUMNS = 4096
_MAX_CELLS = 1 << 26


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    starts, ends, cuts = words(data, offsets, spaces())
    hashes = hasher(30).words(data, starts, ends)
    shingles = hasher(30).windows(hashes, SHINGLE)
    short = [hasher(30).windows(hashes, w) for w in range(1, SHINGLE)]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(shingles[a : b - SHINGLE + 1]))
        else:
            out.append(short[b - a - 1][a : a + 1] if b > a else np.zeros(0, U64))
    return np.diff(cuts), out


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketch_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        _, found = sets(*flat(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("_t"),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([_digest(s) if len(s) else None for s in found], pa.binary()),
                pa.array([s[:K].tobytes() for s in found], pa.binary()),
            ],
            ["id", "_t", "n", "digest", "sketch"],
        )


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, cuts = flat(batch.column("sketch"))
    return np.frombuffer(raw.tobytes(), U64), cuts // 8


def value_counts(cells: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            yield count_min.partial(_values(batch)[0], cells)

    return run


def listed(n: np.ndarray) -> np.ndarray:
    """Under how many of its rarest retained values a set of n shingles is listed."""
    held = np.minimum(n, K)
    shared = np.where(n <= K * 3 // 4, -(-3 * n // 4), _SHARED)
    return held - shared + 1


def list_entries(cells: int, rare):
    """(value, class, n) for the inverted lists."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, common = rare.value
        for batch in batches(source):
            values, cuts = _values(batch)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            rank = count_min.reached(repeated, values, cells).astype(np.int8)
            rank += count_min.reached(common, values, cells)
            order = np.lexsort((values, rank, owner))
            n = batch.column("n").to_numpy()
            place = np.arange(len(values)) - cuts[:-1][owner]
            chosen = order[(place < listed(n)[owner]) & (rank[order] > 0)]
            ids = batch.column("class").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values[chosen].view(np.int64)),
                    pa.array(ids[owner[chosen]]),
                    pa.array(n[owner[chosen]]),
                ],
                ["value", "class", "n"],
            )

    return run


def estimate_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch lets them be similar."""
    for batch in batches(source):
        left, right = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            twin = both[1:] == both[:-1]
            size = min(K, len(both) - int(twin.sum()))
            last = np.flatnonzero(np.cumsum(np.r_[True, ~twin]) == size)[0]
            keep[i] = twin[: last + 1].sum() >= _ESTIMATE * size
        picked = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(pa.array(picked)), batch.column("b").take(pa.array(picked))], ["a", "b"]
        )


def set_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, set) of each text that has words, equal sets once a batch."""
    for batch in batches(source):
        _, found = sets(*flat(batch.column("text")))
        by_digest = {_digest(s): s.tobytes() for s in found if len(s)}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(by_digest), pa.binary()), pa.array(list(by_digest.values()), pa.binary())],
            ["digest", "members"],
        )


def exact_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with 100 * intersection >= 75 * union."""
    for batch in batches(source):
        left, right = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
        keep = []
        for i, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= 75 * (len(both) - shared):
                keep.append(i)
        picked = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(picked), batch.column("b").take(picked)], ["a", "b"])


def _members(texts: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(class, members): the full sets of ``nodes`` (class), in one pass over the texts.

    Only texts under the least id of a wanted class are hashed; texts under one id that
    differ are told apart by the digest of their sets.
    """
    wanted = stage(nodes.join(classes.select("class", "digest", "least"), "class"), "wanted_sets")
    chosen = wanted.select("least").distinct()
    full = texts.join(chosen, F.col("id").eqNullSafe(F.col("least")), "left_semi").select("text")
    once = full.mapInArrow(set_batches, "digest binary, members binary").groupBy("digest").agg(
        F.first("members").alias("members")
    )
    members = stage(once.join(wanted, "digest").select("class", "members"), "members")
    dispose(wanted)
    return members


def _links(classes: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) that are linked, judged on full sets."""
    sketches = classes.select("class", "sketch")
    likely = stage(
        pairs.join(sketches.toDF("b", "sketch_b"), "b")
        .join(sketches.toDF("a", "sketch_a"), "a")
        .select("a", "b", "sketch_a", "sketch_b")
        .mapInArrow(estimate_batches, "a long, b long"),
        "likely_pairs",
    )
    links = stage(
        likely.join(members.toDF("b", "set_b"), "b")
        .join(members.toDF("a", "set_a"), "a")
        .select("a", "b", "set_a", "set_b")
        .mapInArrow(exact_batches, "a long, b long"),
        "links",
    )
    dispose(likely)
    return links


def _similar_sizes(x: str, y: str) -> F.Column:
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def _join_components(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links, which go with the components so far."""
    edges = links.toDF("u", "v")
    joined = stage(components(edges if found is None else edges.union(found.toDF("u", "v"))), "components")
    dispose(links, *([] if found is None else [found]))
    return joined


def _open_lists(entries: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """Entries, with components, their list's length (``held``) and its leader of this
    round (``first``), of lists whose members are not all in one component.

    Closed lists never open again, so later rounds start from what this one returns.
    """
    placed = entries.join(found.withColumnRenamed("node", "class"), "class", "left")
    placed = stage(placed.withColumn("component", F.coalesce("component", "class")), "placed_entries")
    lists = placed.groupBy("value", "hot").agg(
        F.count("*").alias("held"),
        F.min(F.struct(F.xxhash64("value", "class", F.lit(number)), "class", "n", "component")).alias("first"),
        (F.min("component") < F.max("component")).alias("open"),
    )
    lists = stage(lists.filter("open").drop("open"), "lists")
    opened = stage(join_marked(placed, lists, "value", "hot"), "open_entries")
    dispose(placed, lists)
    return opened


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``."""
    counts = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets_ in (left, right):
        owner = np.repeat(np.arange(len(sets_)), [len(s) for s in sets_])
        sides.append((owner, np.concatenate(sets_) if sets_ else np.zeros(0, np.uint32)))
    common = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(common), _COLUMNS):
        columns = common[at : at + _COLUMNS]
        matrices = []
        for (owner, values), n in zip(sides, (len(left), len(right))):
            place = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
            there = columns[place] == values
            matrix = np.zeros((n, len(columns)), np.float32)
            matrix[owner[there], place[there]] = 1
            matrices.append(matrix)
        counts += matrices[0] @ matrices[1].T
    return counts


def compare_list(table: pa.Table) -> pa.Table:
    """Likely links (a, b) across the components of one list (or of two blocks of it).

    All pairs are judged at once by products of indicator matrices, in tiles, and only
    likely links leave the task. A pair that shares several lists is judged in that of its
    least shared value alone.
    """
    column = lambda name: table.column(name).to_numpy()
    value = table.column("value")[0].as_py()
    classes, n, component, block = column("class"), column("n"), column("component"), column("block")
    members = [np.frombuffer(x, np.uint32) for x in table.column("members").to_pylist()]
    listed = [np.array(x, np.int64) for x in table.column("listed").to_pylist()]
    earlier = [x[x < value] for x in listed]
    met = n - np.array([len(x) for x in members])
    rows, cols = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    found_a, found_b = [], []
    for i in range(0, len(rows), _TILE):
        for j in range(0, len(cols), _TILE):
            x, y = rows[i : i + _TILE], cols[j : j + _TILE]
            small, large = np.minimum.outer(n[x], n[y]), np.maximum.outer(n[x], n[y])
            mask = (component[x][:, None] != component[y]) & (classes[x][:, None] < classes[y]) & (4 * small >= 3 * large)
            if block.min() != block.max():
                mask = (component[x][:, None] != component[y]) & (4 * small >= 3 * large)
            if mask.any():
                mask &= _shared_counts([earlier[k] for k in x], [earlier[k] for k in y]) == 0
            if not mask.any():
                continue
            if mask.sum() * 50 < mask.size:
                p, q = np.nonzero(mask)
                shared = [len(np.intersect1d(members[x[k]], members[y[l]], True)) for k, l in zip(p, q)]
                shared = np.array(shared)
            else:
                counts = _shared_counts([members[k] for k in x], [members[k] for k in y])
                p, q = np.nonzero(mask)
                shared = counts[p, q]
            # At most so many more, as values of a set may have met when they were shortened.
            shared = shared + np.minimum(met[x[p]], met[y[q]])
            good = 100 * shared >= 75 * (n[x[p]] + n[y[q]] - shared)
            found_a.append(classes[x[p[good]]])
            found_b.append(classes[y[q[good]]])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    a, b = join(found_a), join(found_b)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def shorten(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with each hash cut to 32 bits; values that meet are kept once."""
    for batch in batches(source):
        raw, cuts = flat(batch.column("members"))
        values = (np.frombuffer(raw.tobytes(), U64) >> U64(32)).astype(np.uint32)
        cuts = cuts // 8
        new = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
        new[cuts[:-1][np.diff(cuts) > 0]] = True
        kept = np.r_[0, np.cumsum(new)][cuts]
        yield pa.RecordBatch.from_arrays([batch.column("class"), binaries(values[new], kept)], ["class", "members"])


def _across(whole: DataFrame, opened: DataFrame) -> DataFrame:
    """Likely links (a, b) between members of one list in different components.

    Lists longer than ``_BLOCK`` are cut into blocks, a task for every two of them.
    """
    members = whole.mapInArrow(shorten, "class long, members binary")
    own = opened.groupBy("class").agg(F.collect_list("value").alias("listed"))
    full = opened.join(own, "class").join(members, "class")
    blocks = F.ceil(F.col("held") / _BLOCK).cast("int")
    full = full.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("class"), "blocks")).drop("held")
    one = full.filter("blocks = 1").withColumn("other", F.lit(0))
    many = full.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = (
        one.unionByName(many)
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .groupBy("value", "low", "high")
        .applyInArrow(compare_list, "a long, b long")
        .distinct()
    )
    return stage(found, "cross_links")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key), one row per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    rows = stage(
        texts.mapInArrow(sketch_batches, f"id {id_type}, _t long, n long, digest binary, sketch binary").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "set_sketches",
    )
    classes = stage(
        rows.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("row").alias("class"),
            F.min("id").alias("least"),
            F.count("*").alias("size"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    cells = count_min.cells_for(classes.count() * K, 0.5, _MAX_CELLS)
    rare = count_min.merged(
        classes.select("sketch").mapInArrow(value_counts(cells), count_min.PARTIAL), cells, thresholds=(2, _COMMON)
    )
    entries = stage(
        classes.select("class", "n", "sketch").mapInArrow(
            list_entries(cells, spark.sparkContext.broadcast(rare)), "value long, class long, n long"
        ),
        "list_entries",
    )
    firsts = entries.groupBy("value").agg(
        F.min(F.struct("class", "n")).alias("first"), F.count("*").alias("members")
    )
    firsts = stage(firsts.filter("members > 1"), "list_firsts")
    total = entries.count()
    joined = join_groups(entries, firsts, "value", "members", total).filter("members > 1")
    shared = stage(joined.withColumn("hot", is_hot("members", total)), "shared_entries")
    dispose(entries, firsts)
    entries = shared.select("value", "class", "n", "hot")
    members = _members(texts, classes, entries.select("class").distinct())
    stars = stage(
        shared.filter(F.col("class") > F.col("first.class"))
        .filter(_similar_sizes("n", "first.n"))
        .select(F.col("first.class").alias("a"), F.col("class").alias("b"))
        .distinct(),
        "star_pairs",
    )
    links = _links(classes, members, stars)
    found = _join_components(None, links)
    tested = stars
    opened = _open_lists(entries, found, 0)
    dispose(entries)
    for number in range(_ROUNDS):
        pairs = (
            opened.filter(F.col("component") != F.col("first.component"))
            .filter(_similar_sizes("n", "first.n"))
            .select(F.least("class", "first.class").alias("a"), F.greatest("class", "first.class").alias("b"))
            .distinct()
        )
        pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "leader_pairs")
        links = _links(classes, members, pairs)
        tested = tested.union(pairs)
        tried, linked = pairs.count(), links.count()
        if not linked:
            break
        found = _join_components(found, links)
        rest = _open_lists(opened.select("value", "class", "n", "hot"), found, number + 1)
        dispose(opened)
        opened = rest
        if linked * _WORTHWHILE < tried:
            break
    opened = opened.drop("first", "hot")
    more = _across(members, opened)
    dispose(opened)
    if not more.isEmpty():
        found = _join_components(found, _links(classes, members, more))
    dispose(members)

    named = classes.select("class", "digest", "least", "size").join(
        found.withColumnRenamed("node", "class"), "class", "left"
    )
    named = stage(named.withColumn("component", F.coalesce("component", "class")), "named_classes")
    dispose(classes, found)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_groups(named, stage(least, "component_ids"), "component", "members", named.count())
    named = stage(named.select("digest", "component_id", "size"), "class_components")
    joined = join_groups(rows.drop("sketch"), named, "digest", "size", rows.count())
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.col("_t").alias("text_key"),
    )


def keep_representatives(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with the first document of each group of near duplicates; all columns."""
    key = free_name(docs, "_k")
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(
        F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("t")).alias(key)
    )
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t")))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
