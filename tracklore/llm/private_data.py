"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in their
plain forms. The random field adds spans of the same kinds in other forms (at and dot
written out, numbers without a plus, other separators). Its features are the shapes of a
word and of its neighbours, fine and coarse; it is trained by stochastic gradients of the
likelihood on a small labelled table (``private_table``, or the caller's own) and decoded
by Viterbi over all stretches of a batch at once. Stretches are the surroundings of words
with a digit, an at sign or a bracketed word; elsewhere the label is always "none".

Offsets are in code points, ends exclusive. One pass, no shuffle; the model is a few
kilobytes. Defined cases: null counts as empty; an empty text has no spans; an added span
that overlaps a pattern's span is left out; equal rows get equal spans; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.private_table import LINES
from tracklore.llm.text_arrays import U64, batches, flat, hasher, prepare, ragged, spaces, words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{edge}-{kind}" for kind in KINDS for edge in "BI"))
_CONTEXT = 3

# The patterns as the contract words them; digits are always taken in whole runs, which
# changes no match and keeps the search linear.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: bytes) -> bool:
    values = [d - 48 for d in digits[::-1]]
    doubled = [2 * v - 9 * (v > 4) for v in values[1::2]]
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def _digits(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def emails(raw: bytes) -> list[tuple[int, int]]:
    """Each at sign is tried once, with all of the local part before it."""
    out, free, sign = [], 0, raw.find(b"@")
    while sign >= 0:
        start = sign
        while start > free and raw[start - 1] in _LOCAL_BYTES:
            start -= 1
        domain = _DOMAIN.match(raw, sign + 1) if start < sign else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        sign = raw.find(b"@", domain.end() if domain else sign + 1)
    return out


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, sorted."""
    out = []
    if b"@" in raw:
        out += [(a, 0, b) for a, b in emails(raw)]
    for m in _IP.finditer(raw):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(raw):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if b"+" in raw:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(raw) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- word shapes --------------------------------------------------------------


def _classes() -> np.ndarray:
    """Bytes to shape signs: letters, digits, and some signs as themselves."""
    table = np.full(256, ord("#"), np.uint8)
    table[65:91] = table[97:123] = table[128:] = ord("a")
    table[48:58] = ord("9")
    for sign in b"@.-+()[]_:/,":
        table[sign] = sign
    return table


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fine, coarse) shape hashes: fine keeps the lengths of digit runs, coarse doesn't."""
    signs = _classes()[data]
    again = np.zeros(len(data), bool)
    again[1:] = signs[1:] == signs[:-1]
    again[starts] = False
    out = []
    for drop in (again & (signs != ord("9")), again):
        total = np.r_[0, np.cumsum(~drop)]
        kept = signs[~drop]
        out.append(hasher(50).words(kept, total[starts], total[ends]))
    return out[0], out[1]


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray):
    """(word numbers, offsets by stretch) near words with a digit, an at sign or brackets."""
    odd = np.zeros(256, bool)
    odd[48:58] = odd[[ord(c) for c in "@()[]"]] = True
    total = np.r_[0, np.cumsum(odd[data])]
    seeds = np.flatnonzero(total[ends] > total[starts])
    text = np.searchsorted(cuts, seeds, "right") - 1
    low, high = np.maximum(seeds - _CONTEXT, cuts[text]), np.minimum(seeds + _CONTEXT + 1, cuts[text + 1])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, high, -1)
    chosen = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
    of = np.searchsorted(cuts, chosen, "right") - 1
    new = np.r_[True, (np.diff(chosen) > 1) | (np.diff(of) > 0)] if len(chosen) else np.zeros(0, bool)
    return chosen, np.r_[np.flatnonzero(new), len(chosen)]


def observed(fine: np.ndarray, coarse: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Seven feature keys for each word of each stretch."""
    n = len(fine)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    some = cuts[:-1][np.diff(cuts) > 0]
    first[some] = True
    last[cuts[1:][np.diff(cuts) > 0] - 1] = True
    columns = []
    for salt, values in ((1, fine), (4, coarse)):
        before, after = np.zeros(n, U64), np.zeros(n, U64)
        before[1:], after[:-1] = values[:-1], values[1:]
        before[first] = after[last] = U64(0)
        columns += [values ^ U64(salt), before ^ U64((salt + 1) << 32), after ^ U64((salt + 2) << 32)]
    columns.append(np.full(n, 7, U64))
    return np.stack(columns, axis=1)


# --- the random field ---------------------------------------------------------


class Field:
    """Weights by feature key and label, and transitions."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, steps: np.ndarray):
        self.keys, self.weights, self.steps = keys, weights, steps

    def scores(self, features: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        known = self.keys[at] == features
        return np.where(known[..., None], self.weights[at], 0).sum(axis=1)

    def decode(self, features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Viterbi over all stretches at once, step by step, the longest first."""
        score = self.scores(features)
        length = np.diff(cuts)
        order = np.argsort(-length, kind="stable")
        length, begin = length[order], cuts[:-1][order]
        back = np.zeros(score.shape, np.int8)
        best = score[begin].copy() if len(begin) else score[:0]
        for step in range(1, int(length.max(initial=0))):
            alive = int(np.searchsorted(-length, -step, "left"))
            ways = best[:alive, :, None] + self.steps
            at = begin[:alive] + step
            back[at] = ways.argmax(axis=1)
            best[:alive] = ways.max(axis=1) + score[at]
        labels = np.zeros(len(score), np.int8)
        state = best.argmax(axis=1) if len(begin) else np.zeros(0, np.int64)
        for step in range(int(length.max(initial=0)) - 1, -1, -1):
            alive = int(np.searchsorted(-length, -step, "left"))
            at = begin[:alive] + step
            labels[at] = state[:alive]
            state[:alive] = back[at, state[:alive]]
        return labels


def _forbidden() -> np.ndarray:
    """An inner label follows only its own kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b.startswith("I-") and a[2:] != b[2:]:
                out[i, j] = -30.0
    return out


def _prepare(raw: bytes):
    data = np.frombuffer(raw, np.uint8)
    starts, ends, cuts = words(data, np.array([0, len(data)]), spaces())
    fine, coarse = shapes(data, starts, ends)
    return data, starts, ends, cuts, fine, coarse


def parse_line(line: str) -> tuple[bytes, list[tuple[int, int, str]]]:
    """Text and (start, end, kind) in bytes of a marked line."""
    text, spans, at = b"", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[[^\[\]]*\])*)\]", line):
        text += line[at : m.start()].encode()
        spans.append((len(text), len(text) + len(m[2].encode()), m[1]))
        text += m[2].encode()
        at = m.end()
    return text + line[at:].encode(), spans


def train(lines: list[str], epochs: int = 40, rate: float = 0.5, decay: float = 1e-3, seed: int = 5) -> Field:
    """Stochastic gradient ascent on the likelihood of a small labelled table."""
    examples = []
    for line in lines:
        raw, spans = parse_line(line)
        _, starts, ends, _, fine, coarse = _prepare(raw)
        labels = np.zeros(len(starts), np.int64)
        for low, high, kind in spans:
            inside = np.flatnonzero((ends > low) & (starts < high))
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[:1]] = LABELS.index(f"B-{kind}")
        if len(starts):
            examples.append((observed(fine, coarse, np.array([0, len(starts)])), labels))
    if not examples:
        return Field(np.zeros(1, U64), np.zeros((1, len(LABELS))), _forbidden())
    keys = np.unique(np.concatenate([f.ravel() for f, _ in examples]))
    field = Field(keys, np.zeros((len(keys), len(LABELS))), _forbidden())
    steps = np.zeros_like(field.steps)
    power_w, power_s = np.full_like(field.weights, 1e-6), np.full_like(steps, 1e-6)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(examples)):
            features, labels = examples[i]
            at = np.searchsorted(keys, features)
            node, edge = _expected(field.scores(features), field.steps)
            node = -node
            node[np.arange(len(labels)), labels] += 1
            edge = -edge
            np.add.at(edge, (labels[:-1], labels[1:]), 1)
            gradient = np.zeros_like(field.weights)
            for column in at.T:
                np.add.at(gradient, column, node)
            touched = np.unique(at)
            gradient[touched] -= decay * field.weights[touched]
            power_w[touched] += gradient[touched] ** 2
            field.weights[touched] += rate * gradient[touched] / np.sqrt(power_w[touched])
            power_s += edge**2
            steps += rate * (edge - decay * steps) / np.sqrt(power_s)
            field.steps = steps + _forbidden()
    return field


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expected(score: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of each word, and expected transitions, by forward and backward sums."""
    n, k = score.shape
    ahead, behind = np.zeros((n, k)), np.zeros((n, k))
    ahead[0] = score[0]
    for i in range(1, n):
        ahead[i] = _log_sum(ahead[i - 1][:, None] + steps, 0) + score[i]
    for i in range(n - 2, -1, -1):
        behind[i] = _log_sum(steps + score[i + 1] + behind[i + 1], 1)
    total = _log_sum(ahead[-1], 0)
    edges = np.zeros((k, k))
    for i in range(1, n):
        edges += np.exp(ahead[i - 1][:, None] + steps + score[i] + behind[i] - total)
    return np.exp(ahead + behind - total), edges


# --- spans of a batch ---------------------------------------------------------


def _plausible(kind: str, raw: bytes) -> bool:
    digits = _digits(raw)
    if kind == "email":
        return any(65 <= c <= 90 or 97 <= c <= 122 for c in raw) and len(raw) >= 6
    if kind == "ip":
        parts = re.findall(rb"[0-9]+", raw)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def added_spans(field: Field, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, kind number, end) in bytes, from the random field."""
    data, offsets = flat(column)
    starts, ends, cuts = words(data, offsets, spaces())
    chosen, parts = stretches(data, starts, ends, cuts)
    if not len(chosen):
        return {}
    # Only the chosen words' bytes get shapes.
    fine, coarse = _chosen_shapes(data, starts[chosen], ends[chosen])
    labels = field.decode(observed(fine, coarse, parts), parts)
    stretch = np.repeat(np.arange(len(parts) - 1), np.diff(parts))
    kind = (labels + 1) // 2  # 0 for none
    begins = (labels > 0) & (np.r_[True, (kind[1:] != kind[:-1]) | (stretch[1:] != stretch[:-1])] | (labels % 2 == 1))
    heads = np.flatnonzero(begins)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i in heads.tolist():
        j = i + 1
        while j < len(labels) and labels[j] > 0 and not begins[j] and stretch[j] == stretch[i]:
            j += 1
        low, high = int(starts[chosen[i]]), int(ends[chosen[j - 1]])
        raw = data[low:high].tobytes()
        head = re.search(rb"[A-Za-z0-9+(\x80-\xff]", raw)
        tail = re.search(rb"[A-Za-z0-9)\x80-\xff][^A-Za-z0-9)\x80-\xff]*\Z", raw)
        if not head or not tail or not _plausible(KINDS[kind[i] - 1], raw):
            continue
        text = int(np.searchsorted(cuts, chosen[i], "right") - 1)
        base = int(offsets[text])
        found.setdefault(text, []).append((low + head.start() - base, int(kind[i]) - 1, low + tail.start() + 1 - base))
    return found


def _chosen_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    lengths = ends - starts
    packed = data[ragged(starts, lengths)]
    upto = np.r_[0, np.cumsum(lengths)]
    return shapes(packed, upto[:-1], upto[1:])


def _listed(spans: list[tuple[int, int, int]], raw: bytes) -> str:
    """kind:start:end in code points."""
    if not spans:
        return ""
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    return ",".join(f"{KINDS[k]}:{points[a]}:{points[b]}" for a, k, b in sorted(spans))


def span_batches(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        for batch in batches(source):
            column = batch.column("text")
            more = added_spans(field, column)
            counts, digests, listed = [], [], []
            for i, raw in enumerate(column.cast(pa.binary()).to_pylist()):
                raw = raw or b""
                base = base_spans(raw)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                text = _listed(base, raw)
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                extra = [s for s in more.get(i, ()) if all(s[2] <= a or s[0] >= b for a, _, b in base)]
                listed.append(_listed(base + extra, raw) if extra else text)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            for kind, name in enumerate(KINDS):
                columns[f"n_{name}"] = pa.array([c[kind] for c in counts], pa.int64())
            columns["base_sha256"] = pa.array(digests, pa.string())
            columns["spans"] = pa.array(listed, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def labelled_table(spark) -> DataFrame:
    """The small labelled table as rows (line)."""
    return spark.createDataFrame([(line,) for line in LINES], "line string")


def find_private(
    docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, carry: list[str] | None = None
) -> DataFrame:
    """``docs`` (as struct ``doc``, or of it the columns in ``carry``) with counts of the
    patterns' spans by kind, base_sha256 and all spans."""
    spark = prepare(docs.sparkSession)
    lines = LINES if labelled is None else [r[0] for r in labelled.select("line").collect()]
    shared = spark.sparkContext.broadcast(train(lines))
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.col(text_col).alias("text"))
    schema = rows.select("doc").schema
    for name in KINDS:
        schema = schema.add(f"n_{name}", "long")
    return rows.mapInArrow(span_batches(shared), schema.add("base_sha256", "string").add("spans", "string"))
