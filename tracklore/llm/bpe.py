"""Byte-level BPE by a pair occurrence index.

A partition's distinct pieces lie end to end in one array of symbols. An index maps each
mergeable pair, by its rank, to all its positions. Active ranks are applied in ascending
order: all positions of a pair are merged at once, and the pairs that arise at the merged
places join the lists of their own ranks. As a merge can only give rise to pairs of later
ranks (checked when the vocabulary is loaded), each piece sees its merges in the order in
which a piece-by-piece encoder applies them.

Texts become pieces by the vocabulary's usual pattern, applied once to each distinct run
of text between spaces; ids are then assembled for whole texts by array gathering. The
vocabulary file's path is a parameter; the driver reads it and broadcasts it (its size is
that of the vocabulary). There is no shuffle.

Defined cases: null counts as empty; an empty text has no ids; the text of a special token
is that token; bytes that aren't UTF-8 count as replacement characters; ids outside the
vocabulary can't be decoded and raise; equal rows give equal results; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.llm.text_arrays import batches, prepare, ragged, release

# Fixed value: the pattern by which this kind of vocabulary splits texts into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_CACHED_PIECES = 400_000
# A text of n bytes takes many times as much while it is cut and joined, so batches are small.
BATCH_BYTES = 3 << 20
_BITS = 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Merges as arrays, and the bytes of each id."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids = model["vocab"]
        characters = byte_characters()
        back = {c: b for b, c in enumerate(characters)}
        self.base = np.array([ids[c] for c in characters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        born = {}
        for rank, made in enumerate(self.made.tolist()):
            born.setdefault(made, rank)
        for rank, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            if max(born.get(a, -1), born.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that a later merge makes")
        keys = self.left << _BITS | self.right
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of_key]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        spelled = {i: bytes(back[c] for c in text) for text, i in ids.items() if text not in self.special}
        spelled |= {i: text.encode() for text, i in self.special.items()}
        lengths = np.zeros(max(spelled) + 1, np.int64)
        for i, raw in spelled.items():
            lengths[i] = len(raw)
        self.byte_starts = np.cumsum(lengths) - lengths
        self.byte_lengths = lengths
        self.bytes = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)
        self.known = np.isin(np.arange(len(lengths)), list(spelled))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        keys = left.astype(np.int64) << _BITS | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of_key[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by piece) of many pieces at once."""
        symbol = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        lengths = np.array([len(p) for p in pieces], np.int64)
        cuts = np.r_[0, np.cumsum(lengths)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        some = lengths > 0
        after[cuts[1:][some] - 1] = -1
        before[cuts[:-1][some]] = -1

        waiting: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            """List the pairs that begin at ``places`` under their ranks."""
            rank = self.ranks(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True])
            for r, a, b in zip(rank[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                if r in waiting:
                    waiting[r].append(places[a:b])
                else:
                    waiting[r] = [places[a:b]]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = waiting.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.unique(lists[0])
            a, b = self.left[rank], self.right[rank]
            follow = after[at]
            good = (symbol[at] == a) & (follow >= 0) & (symbol[follow] == b)
            at, follow = at[good], follow[good]
            if a == b and len(at) > 1:
                # In a run of one symbol every other pair merges, from its beginning.
                begins = np.r_[True, follow[:-1] != at[1:]]
                run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                odd = (np.arange(len(at)) - run) % 2 == 0
                at, follow = at[odd], follow[odd]
            if not len(at):
                continue
            beyond = after[follow]
            symbol[at], symbol[follow] = self.made[rank], -1
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            ahead = before[at]
            note(np.concatenate([ahead[ahead >= 0], at[inner]]))
        alive = symbol >= 0
        total = np.r_[0, np.cumsum(alive)]
        return symbol[alive], total[cuts]


class _Numbers(dict):
    """Numbers its keys in the order in which they first appear."""

    def __init__(self, keys: list, make=None):
        self.keys_seen, self.make = keys, make

    def __missing__(self, key):
        if self.make:
            number = self[key] = self.make(key)
            return number
        number = self[key] = len(self.keys_seen)
        self.keys_seen.append(key)
        return number


class Encoder:
    """Encodes batches of texts; keeps the ids of pieces it has met, to a bounded number."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(PIECES)
        self.runs = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
        self.odd_space = regex.compile(r"\p{White_Space} ")
        special = "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.cuts = np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        ids, cuts = self.vocabulary.merge([p.encode() for p in pieces])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.cuts = np.concatenate([self.cuts, cuts[1:] + self.cuts[-1]])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text)."""
        runs: list[str] = []
        plain = _Numbers(runs)
        spaced = _Numbers([], lambda word: plain[" " + word])
        special: dict[int, int] = {}
        numbers, counts = [], []

        def cut(text: str) -> None:
            if self.odd_space.search(text):
                # A space after other white space need not begin a piece.
                found = [plain[r] for r in self.runs.findall(text)]
            else:
                words = text.split(" ")
                found = [plain[words[0]]] if words[0] else []
                found += map(spaced.__getitem__, words[1:])
            numbers.append(np.array(found, np.int64))
            counts[-1] += len(found)

        for text in texts:
            counts.append(0)
            if self.special and self.special.search(text):
                for part in self.special.split(text):
                    if part in self.vocabulary.special:
                        number = plain["\0special " + part]
                        special[number] = self.vocabulary.special[part]
                        numbers.append(np.array([number], np.int64))
                        counts[-1] += 1
                    elif part:
                        cut(part)
            elif text:
                cut(text)
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        by_run = [[] if i in special else self.pieces.findall(run) for i, run in enumerate(runs)]
        if len(self.known) > _CACHED_PIECES:
            self._forget()
        new = list(dict.fromkeys(p for run in by_run for p in run if p not in self.known))
        if new:
            self._learn(new)
        # Runs as pieces, pieces as ids, texts as runs.
        piece = np.fromiter((self.known[p] for run in by_run for p in run), np.int64)
        per_run = np.array([len(run) for run in by_run], np.int64)
        size = np.diff(self.cuts)[piece]
        run_ids = self.ids[ragged(self.cuts[piece], size)]
        run_cuts = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(per_run)]]
        lengths = np.diff(run_cuts)
        if special:
            place = np.array(sorted(special))
            run_ids = np.insert(run_ids, run_cuts[place], [special[i] for i in place.tolist()])
            lengths[place] = 1
            run_cuts = np.r_[0, np.cumsum(lengths)]
        ids = run_ids[ragged(run_cuts[numbers], lengths[numbers])]
        ends = np.r_[0, np.cumsum(lengths[numbers])]
        return ids, ends[np.r_[0, np.cumsum(np.array(counts, np.int64))]]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The text of each stretch of ids."""
        v = self.vocabulary
        if len(ids) and (ids.min() < 0 or ids.max() >= len(v.known) or not v.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = v.byte_lengths[ids]
        raw = v.bytes[ragged(v.byte_starts[ids], size)].tobytes()
        at = np.r_[0, np.cumsum(size)][cuts].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def texts_of(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def encode_batches(shared, with_ids: bool, with_decoded: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = Encoder(shared.value)
        for batch in batches(source):
            ids, cuts = encoder.encode(texts_of(batch.column("text")))
            decoded = encoder.decode(ids, cuts)
            raw = ids.astype("<u4")
            stretches = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            columns["n_tokens"] = pa.array(np.diff(cuts), pa.int64())
            columns["ids_sha256"] = pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in stretches])
            columns["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            if with_decoded:
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def encode(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    carry: list[str] | None = None,
    with_ids: bool = True,
    with_decoded: bool | None = None,
) -> DataFrame:
    """``docs`` (as struct ``doc``, or of it the columns in ``carry``) with n_tokens, digests
    of the ids and of the text decoded from them, and with ``with_ids`` the ids themselves;
    ``with_decoded`` adds the decoded text, by default as ``with_ids`` says."""
    with_decoded = with_ids if with_decoded is None else with_decoded
    spark = prepare(docs.sparkSession, BATCH_BYTES)
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_col).alias("text"))
    schema = rows.select(
        "doc", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")
    ).schema
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    if with_decoded:
        schema = schema.add("decoded", "string")
    return rows.mapInArrow(encode_batches(shared, with_ids, with_decoded), schema)
