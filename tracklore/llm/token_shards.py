"""Token ids of a corpus in compressed shard files with access, counting and lookup.

Documents are sorted by id (a range shuffle of their texts, the only large one), encoded
with the tokenizers library and written in that order. A shard is the ids of one Arrow
batch of documents, each followed by the end id, as one wavelet matrix file; files are the
binary values of a Parquet table, so any store that Spark writes to can hold them.

The library encodes each distinct run of text between white space once per worker and
cache filling, and a batch looks each of its distinct runs up once; the pre-tokeniser drops
white space and never joins across it, so the ids of a text are those of its runs. The
tokenizer file's path is a parameter; its text is broadcast (the size of a vocabulary).

Where a document starts in the whole corpus comes from sums over shards, then over
partitions, then over groups of partitions, so no task sees more than a part of them.

Defined cases: null counts as empty and has the end id only; null ids come last; equal
ids are ordered by a hash of their texts; an empty table makes no shards and gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklore.llm.text_arrays import LOWER, batches, binaries, flat, prepare, ragged, spaces, words
from tracklore.llm.wavelet import WaveletMatrix

END_ID = 2
PARTITION_BYTES = 16 << 20
_CACHED_RUNS = 900_000
# A run that is one id by itself; runs without it can't have that id.
_SEPARATOR = b"0"
_TOGETHER = 200
_PARTITIONS_TOGETHER = 1024
# Between a letter and such a sign there is always a boundary, as at white space. Letters
# here: a-z, and the two-byte ones of Western European languages (0xC3 and one of _SECOND).
_SIGN = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.isin(np.arange(256), list(range(0x61, 0x7B)))
_SECOND = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct runs, the number of each run among them, offsets by text)."""
    lower = LOWER[data]
    marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    text = np.searchsorted(offsets, marks, "right") - 1
    marked = np.unique(text[marks + 1 < offsets[text + 1]])
    for i in marked.tolist():  # a special token may be in it, which has a case
        lower[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
    sign = np.flatnonzero(_SIGN[lower])
    text = np.searchsorted(offsets, sign, "right") - 1
    letter = _LETTER[lower[sign - 1]]
    letter |= (sign - 2 >= offsets[text]) & (lower[np.maximum(sign, 2) - 2] == 0xC3) & _SECOND[lower[sign - 1]]
    sign = sign[letter & ~np.isin(text, marked)]
    # At a text's first byte there is an edge anyway, whatever stands before it.
    starts, ends, cuts = words(lower, np.r_[offsets, sign], spaces())
    coded = binaries(lower[~spaces()[lower]], np.r_[0, np.cumsum(ends - starts)]).dictionary_encode()
    return coded.dictionary.to_numpy(False).tolist(), coded.indices.to_numpy(), cuts[: len(offsets)]


class RunEncoder:
    """Ids of texts from the ids of their runs."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = max(1, (max(self.tokenizer.get_vocab(True).values())).bit_length())
        sign = self._ids([_SEPARATOR.decode()])[0]
        self.separator = int(sign[0]) if len(sign) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.cuts = np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[bytes]) -> None:
        """Most runs are encoded many at a time, a sign between them that none of them holds."""
        alone = [r for r in runs if _SEPARATOR in r or b"<|" in r]
        together = [r for r in runs if _SEPARATOR not in r and b"<|" not in r] if self.separator is not None else []
        alone = alone if self.separator is not None else runs
        between = b" " + _SEPARATOR + b" "
        joined = [
            between.join(together[i : i + _TOGETHER]).decode("utf-8", "replace")
            for i in range(0, len(together), _TOGETHER)
        ]
        found, lengths = [], []
        for ids in self._ids(joined):
            at = np.flatnonzero(ids == self.separator)
            lengths.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
            found.append(ids[ids != self.separator])
        for ids in self._ids([r.decode("utf-8", "replace") for r in alone]):
            lengths.append(np.array([len(ids)]))
            found.append(ids)
        runs = together + alone
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(np.concatenate(lengths))])
        self.ids = np.concatenate([self.ids, *found])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of texts in one array; each distinct run is looked up once."""
        runs, run, cuts = _runs(data, offsets)
        if len(self.known) > _CACHED_RUNS:
            self._forget()
        new = [r for r in runs if r not in self.known]
        if new:
            self._learn(new)
        run = np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))[run]
        size = np.diff(self.cuts)[run]
        ids = self.ids[ragged(self.cuts[run], size)]
        return ids, np.r_[0, np.cumsum(size)][cuts]


_SHARD = "part int, seq int, n_docs long, n_tokens long, file binary"


_ENCODER: list = []


def _encoder(spec: str) -> RunEncoder:
    """The worker's encoder: later partitions find the runs that earlier ones met."""
    if not _ENCODER or _ENCODER[0] != spec:
        _ENCODER[:] = [spec, RunEncoder(spec)]
    return _ENCODER[1]


def shard_batches(shared, end_id: int | None):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for seq, batch in enumerate(batches(source)):
            ids, cuts = encoder.encode(*flat(batch.column("text")))
            lengths = np.diff(cuts)
            if end_id is not None:
                ids = np.insert(ids, cuts[1:], end_id)
                lengths = lengths + 1
            names = batch.column("id")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", names.type), ("n", pa.int64())])) as writer:
                writer.write(pa.record_batch([names, pa.array(lengths)], ["id", "n"]))
            file = WaveletMatrix.build(ids, encoder.bits).to_bytes(documents=sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part").slice(0, 1),
                    "seq": pa.array([seq], pa.int32()),
                    "n_docs": pa.array([batch.num_rows], pa.int64()),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "file": pa.array([file], pa.binary()),
                }
            )

    return run


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = END_ID,
    partition_bytes: int = PARTITION_BYTES,
) -> None:
    """Write the shard table of ``docs`` to ``path``, in ascending order of ids."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    (
        rows.repartitionByRange(max(1, -(-size // partition_bytes)), *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(shard_batches(shared, end_id), _SHARD)
        .write.parquet(path)
    )


def _documents(parts: dict[str, bytes]) -> pa.Table:
    return pa.ipc.open_stream(parts["documents"]).read_all()


def read_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, seq, doc_id, at, n_tokens, ids_crc32) from shard files."""
    for batch in batches(source):
        for part, seq, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
            matrix, parts = WaveletMatrix.from_bytes(file)
            ids = matrix.all().astype("<u4")
            own = _documents(parts)
            lengths = own.column("n").to_numpy()
            cuts = np.r_[0, np.cumsum(lengths)]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(crc), pa.int32()),
                    pa.array([seq] * len(crc), pa.int32()),
                    own.column("id").combine_chunks(),
                    pa.array(cuts[:-1], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids in all shards before each."""

    def before(within: list[str], by: str):
        rows = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(rows), F.lit(0))

    sizes = shards.select(
        "part", "seq", F.col("n_tokens").alias("n"), F.expr(f"part div {_PARTITIONS_TOGETHER}").alias("group")
    )
    parts = sizes.groupBy("group", "part").agg(F.sum("n").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", before([], "group").alias("a"))
    parts = parts.select("group", "part", before(["group"], "part").alias("b")).join(groups, "group")
    shards = sizes.select("part", "seq", before(["part"], "seq").alias("c")).join(parts, "part")
    return shards.select("part", "seq", (F.col("a") + F.col("b") + F.col("c")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    shards = prepare(spark).read.parquet(path)
    found = shards.select("part", "seq", "file").mapInArrow(
        read_batches, f"part int, seq int, doc_id {id_type}, at long, n_tokens long, ids_crc32 long"
    )
    return found.join(shard_starts(shards), ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def find_batches(id_: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            for file in batch.column(0).to_pylist():
                matrix, parts = WaveletMatrix.from_bytes(file)
                at = matrix.places(id_)
                own = _documents(parts)
                ends = np.cumsum(own.column("n").to_numpy())
                doc = np.searchsorted(ends, at, "right")
                starts = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [own.column("id").combine_chunks().take(pa.array(doc)), pa.array(at - starts[doc], pa.int64())],
                    ["doc_id", "place"],
                )

    return run


def find_token(spark: SparkSession, path: str, id_: int, id_type: str = "bigint") -> DataFrame:
    """(doc_id, place) of every occurrence of an id, without unpacking the shards."""
    files = prepare(spark).read.parquet(path).select("file")
    return files.mapInArrow(find_batches(id_), f"doc_id {id_type}, place long")


def count_batches(id_: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            total = sum(WaveletMatrix.from_bytes(f)[0].count(id_) for f in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    return run


def count_token(spark: SparkSession, path: str, id_: int) -> int:
    """Occurrences of an id in all shards."""
    files = prepare(spark).read.parquet(path).select("file")
    return files.mapInArrow(count_batches(id_), "n long").agg(F.sum("n")).first()[0] or 0
