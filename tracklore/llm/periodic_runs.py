"""Periodic runs of words: stretches that repeat the same q words over and over.

A run is a stretch of consecutive words with smallest period q, at least ``exponent``
times q and ``least`` words long, that no neighbouring word extends. Collapsing keeps the
first q words of every run.

Method: scale-tiled distribution. Periods are taken by octave, P <= q < 2P. Long documents
are exploded into overlapping tiles for each octave (those of small periods share one
tiling), shorter ones are a single tile. A tile is solved by itself: its boundaries lie P
words apart, and for every boundary c and every q of the octave the Z-values, how far the
words from c on equal those from c + q on, and how far those before c equal those before
c + q, tell a stretch of period q around c. Z-values are found for all boundaries and
periods at once: equal blocks of P words have equal names (each name is that of a pair of
half blocks, so equality is exact, without hashes), boundaries whose blocks match are
chained, and the ends of a chain are found by halving steps. Fragments of tiles are
shuffled by document and period and stitched where they meet.

Nothing is lost between tiles: a run's stretch of equal words is at least 3P long, tiles
overlap by 4P, so wherever a tile cuts a piece of less than 2P off, its neighbour holds that
piece with more of the run; shorter pieces at cuts are left out.

Scale. Work is words times octaves. Texts are read once; those without fragments end
there, only the others are staged and move once, to meet their runs. A document of more
than ``1.5 * tile`` words is solved by as many tasks as it has tiles, so memory is bounded
by the tile, 12P words for the octaves with large P, never more than the text itself.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed
text; repeated rows and ids are rows of their own; of runs that overlap, each is reported;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracklore.llm.text_arrays import batches, binaries, flat, prepare, ragged, spaces, words
from tracklore.session import stage

EXPONENT = 4
LEAST = 6
TILE = 1 << 13
_BATCH_BYTES = 4 << 20
_ALL = 63


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for equal words, another for others."""
    sizes = ends - starts
    return binaries(data[ragged(starts, sizes)], np.r_[0, np.cumsum(sizes)]).dictionary_encode().indices.to_numpy()


def smallest_factors(below: int) -> np.ndarray:
    """The smallest prime factor of each number."""
    factor = np.arange(below)
    for i in range(2, int(below**0.5) + 1):
        if factor[i] == i:
            multiples = factor[i * i :: i]
            multiples[multiples == np.arange(i * i, below, i)] = i
    return factor


class Tiles:
    """Consecutive words of documents, solved together: ``names`` of words, tile after tile.

    ``low`` and ``high`` bound a tile's octaves; ``cut_left`` and ``cut_right`` say that its
    document goes on there.
    """

    def __init__(self, names, lengths, low=None, high=None, cut_left=None, cut_right=None):
        n = len(lengths)
        given = [low, high, cut_left, cut_right]
        rest = [np.zeros(n, int), np.full(n, _ALL), np.zeros(n, bool), np.zeros(n, bool)]
        order = np.argsort(-lengths, kind="stable")  # tiles too short for an octave lie at the end
        at = np.cumsum(lengths) - lengths
        self.order = order
        self.lengths = lengths[order]
        self.names = names[ragged(at[order], self.lengths)].astype(np.int32)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.low, self.high, self.cut_left, self.cut_right = (
            (r if g is None else np.asarray(g))[order] for g, r in zip(given, rest)
        )

    def fragments(self, exponent: int = EXPONENT, least: int = LEAST):
        """(tile, period, start, stop): word i equals word i + period for start <= i < stop."""
        found, levels, octave = [], [], 0
        longest = int(self.lengths[0]) if len(self.lengths) else 0
        factor = smallest_factors(longest // 2 + 2)
        while longest >= 4 << octave:  # a last tile may be as short, whatever the exponent
            tiles = int(np.searchsorted(-self.lengths, -(4 << octave), "right"))
            total = int(self.starts[tiles])
            tile = np.repeat(np.arange(tiles, dtype=np.int32), self.lengths[:tiles])
            inner = np.arange(total) - self.starts[tile]
            levels = [names[:total] for names in levels]
            levels.append(self._block_names(levels, octave, tile, inner))
            part = self._octave(levels, octave, tile, inner, exponent, least, factor)
            if part is not None:
                found.append(part)
            octave += 1
        if not found:
            return (np.zeros(0, np.int64),) * 4
        tile, period, start, stop = (np.concatenate(x) for x in zip(*found))
        return self.order[tile], period, start - self.starts[tile], stop - self.starts[tile]

    def _block_names(self, levels, octave, tile, inner):
        """Exact names of the blocks of 2 ** octave words from each word on, -1 past the end."""
        if not octave:
            return self.names[: len(inner)]
        half = 1 << (octave - 1)
        fits = np.flatnonzero(inner + 2 * half <= self.lengths[tile])
        last = levels[-1].astype(np.int64)
        named = np.full(len(inner), -1, np.int32)
        named[fits] = pd.factorize(last[fits] * (int(last.max(initial=0)) + 1) + last[fits + half])[0]
        return named

    def _octave(self, levels, octave, tile, inner, exponent, least, factor):
        width, named = 1 << octave, levels[-1]
        used = (self.low <= octave) & (self.high >= octave)
        here = np.arange(width, len(inner))
        # The boundary before last, so that its distance is a period of the octave.
        anchor = here - inner[width:] % width - width
        same = (named[width:] == named[anchor]) & (named[width:] >= 0) & (inner[width:] >= width) & used[tile[width:]]
        here, anchor = here[same], anchor[same]
        if not len(here):
            return None
        period, own = here - anchor, tile[here]
        order = np.lexsort((anchor, period, own))
        period, own, anchor = period[order], own[order], anchor[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (period[1:] != period[:-1]) | (anchor[1:] != anchor[:-1] + width)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(own)] - 1
        start, stop, period, own = anchor[first], anchor[last] + width, period[first], own[first]
        floor, ceiling = self.starts[own], self.starts[own + 1]
        for level in range(octave - 1, -1, -1):
            step, blocks = 1 << level, levels[level]
            left = start - step
            fits = left >= floor
            left = np.where(fits, left, start)
            start = np.where(fits & (blocks[left] == blocks[left + period]), left, start)
            fits = stop + period + step <= ceiling
            right = np.where(fits, stop, start)
            stop = np.where(fits & (blocks[right] == blocks[right + period]), stop + step, stop)
        cut = (self.cut_left[own] & (start == floor)) | (self.cut_right[own] & (stop + period == ceiling))
        enough = np.maximum(least - period, (exponent - 1) * period)
        keep = stop - start >= np.where(cut, np.minimum(2 * width, enough), enough)
        start, stop, period, own = start[keep], stop[keep], period[keep], own[keep]
        keep = self._primitive(levels, start, period, factor)
        return own[keep], period[keep], start[keep], stop[keep]

    def _primitive(self, levels, start, period, factor):
        """Whether no smaller period divides ``period`` within its first words."""
        whole = np.ones(len(period), bool)
        rest = period.copy()
        while True:
            todo = np.flatnonzero(whole & (rest > 1))
            if not len(todo):
                return whole
            prime = factor[rest[todo]]
            p, s = period[todo] // prime, start[todo]
            size = period[todo] - p
            level = np.frexp(size)[1] - 1
            equal = np.zeros(len(todo), bool)
            for k in np.unique(level):
                i = level == k
                blocks, end = levels[k], s[i] + size[i] - (1 << k)
                equal[i] = (blocks[s[i]] == blocks[s[i] + p[i]]) & (blocks[end] == blocks[end + p[i]])
            whole[todo[equal]] = False
            rest[todo] //= prime


def tiling(n: int, tile: int, exponent: int = EXPONENT) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, lowest octave, highest octave) of the tiles of ``n`` words."""
    low, high = 0, (tile // 8).bit_length() - 1
    while n >= exponent << low:
        step = 8 << high
        for at in range(0, n, step):
            stop = min(n, at + step + (4 << high))
            yield at, stop, low, high
            if stop == n:
                break
        low = high = high + 1


_FRAGMENT = "struct<period:long,start:long,stop:long>"
_TILE = "octave_low int, octave_high int, at long, cut_right boolean, names binary"


def _fragment_lists(owner, period, start, stop, n):
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(n + 1))
    items = pa.StructArray.from_arrays(
        [pa.array(x[order].astype(np.int64)) for x in (period, start, stop)], ["period", "start", "stop"]
    )
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), items)


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def scan(exponent: int, least: int, tile: int):
    """Rows of documents (octave_low is null) and of the tiles of long ones."""
    longest = tile + tile // 2

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            n = batch.num_rows
            data, offsets = flat(batch.column("text"))
            starts, ends, cuts = words(data, offsets, spaces())
            names, lengths = word_names(data, starts, ends), np.diff(cuts)
            near = np.flatnonzero((lengths >= least) & (lengths <= longest))
            solved = Tiles(names[ragged(cuts[near], lengths[near])], lengths[near])
            owner, period, start, stop = solved.fragments(exponent, least)
            lists = _fragment_lists(near[owner] if len(owner) else owner, period, start, stop, n)
            far = lengths > longest
            open_ = far | (np.diff(lists.offsets.to_numpy()) > 0)
            sums, texts = [], []
            for i in range(n):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                sums.append(None if open_[i] else digest(b" ".join(raw.split())))
                texts.append(raw if open_[i] else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(sums, pa.string()),
                    lists,
                    *[pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())],
                ],
                _NAMES,
            )
            for i in np.flatnonzero(far):
                for at, stop, low, high in tiling(int(lengths[i]), tile, exponent):
                    piece = names[cuts[i] + at : cuts[i] + stop].astype(np.int32).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").slice(i, 1),
                            batch.column("doc_id").slice(i, 1),
                            *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), lists.type)],
                            pa.array([low], pa.int32()),
                            pa.array([high], pa.int32()),
                            pa.array([at], pa.int64()),
                            pa.array([bool(stop < lengths[i])]),
                            pa.array([piece], pa.binary()),
                        ],
                        _NAMES,
                    )

    return run


_NAMES = "row doc_id n_words text collapsed_sha256 fragments octave_low octave_high at cut_right names".split()


def solve(exponent: int, least: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            names, offsets = flat(batch.column("names"))
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            at = column("at")
            tiles = Tiles(
                np.frombuffer(names.tobytes(), np.int32), np.diff(offsets) // 4,
                column("octave_low"), column("octave_high"), at > 0, column("cut_right"),
            )
            owner, period, start, stop = tiles.fragments(exponent, least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(owner)), *(pa.array(x) for x in (period, start + at[owner], stop + at[owner]))],
                ["row", "period", "start", "stop"],
            )

    return run


def stitched(fragments: DataFrame, exponent: int, least: int) -> DataFrame:
    """(row, start, length, period): fragments (row, period, start, stop) that meet joined."""
    ordered = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > before, F.lit(True)).cast("int")
    length = F.col("stop") - F.col("start") + F.col("period")
    return (
        fragments.withColumn("apart", apart)
        .withColumn("piece", F.sum("apart").over(ordered))
        .groupBy("row", "period", "piece")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select("row", "start", length.alias("length"), "period")
        .filter((F.col("length") >= least) & (F.col("length") >= F.col("period") * exponent))
    )


def collapse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        texts, sums = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            split = text.encode().split()
            gone = np.zeros(len(split) + 1, np.int64)
            for r in runs or ():
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            texts.append(b" ".join([split[i] for i in np.flatnonzero(keep)]))
            sums.append(digest(texts[-1]))
        kept = [batch.column(c) for c in ("doc_id", "n_words", "runs")]
        made = [pa.array(sums, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*kept, *made], ["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"])


_RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(
    docs: DataFrame,
    exponent: int = EXPONENT,
    least: int = LEAST,
    tile: int = TILE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_sha256, collapsed), a row for each of ``docs``.

    ``runs`` (start, length, period) come by start, then period. ``collapsed`` is null
    where nothing is left out. ``exponent`` is at least 4, which the tiles' overlap needs.
    """
    if exponent < EXPONENT or tile < 8:
        raise ValueError("exponent must be 4 or more and tile 8 or more")
    prepare(docs.sparkSession, _BATCH_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    )
    schema = f"row long, doc_id {kind}, n_words long, text string, collapsed_sha256 string, fragments array<{_FRAGMENT}>, {_TILE}"
    scanned = stage(numbered.mapInArrow(scan(exponent, least, tile), schema), "scanned")
    own = scanned.filter("octave_low IS NULL")
    tiles = scanned.filter("octave_low IS NOT NULL").select("row", "octave_low", "octave_high", "at", "cut_right", "names")
    spread = tiles.repartition("row", "octave_low", "at").mapInArrow(
        solve(exponent, least), "row long, period long, start long, stop long"
    )
    near = own.select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    runs = (
        stitched(near.unionByName(spread), exponent, least)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
        .select("row", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    )
    done = own.filter("text IS NULL").select(
        "doc_id", "n_words", F.array().cast(_RUNS).alias("runs"), "collapsed_sha256", F.lit(None).cast("string").alias("collapsed")
    )
    found = own.filter("text IS NOT NULL").select("row", "doc_id", "n_words", "text").join(runs, "row", "left")
    found = found.select("doc_id", "n_words", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    cut = found.mapInArrow(collapse, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed_sha256 string, collapsed string")
    return done.unionByName(cut)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): one document in ten made periodic from some word on, by its id alone.

    With h the CRC-32 of the id as text and g = h // 10, documents with h % 10 = 0 and n > 0
    words repeat p = 1 + (n - a) // (3 + g % 8) words from word a = g % n on. Other texts,
    and those with a null id, stay as they are.
    """
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            texts = []
            for g, text in zip(batch.column("g").to_pylist(), batch.column("text").to_pylist()):
                split = (text or "").encode().split()
                n = len(split)
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join([*split[:a], *(split[a + (i - a) % p] for i in range(a, n))]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), chosen.alias("h"))
    changed = rows.filter("h % 10 = 0").selectExpr("doc_id", "text", "h div 10 AS g")
    return rows.filter("h IS NULL OR h % 10 <> 0").select("doc_id", "text").unionByName(
        changed.mapInArrow(run, f"doc_id {kind}, text string")
    )
