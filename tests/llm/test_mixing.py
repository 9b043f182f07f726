"""Source mixing against a plain version, on hard small tables."""

import hashlib
import random
import re
from fractions import Fraction

import pytest

from tracklore.llm import mixing, ranking


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = sum(weight[s] for s in free)
        level = Fraction(total - sum(fixed.values()), share) if share else 0
        over = [s for s in free if most * sizes[s] < level * weight[s]]
        if not over:
            return {s: fixed.get(s, level * weight[s]) for s in order}
        fixed |= {s: most * sizes[s] for s in over}


def plain_mix(rows, weights=(5, 2, 1), most=3):
    docs = []
    for i, text, source in rows:
        name = str(i) if i is not None else text or ""
        h = int(hashlib.sha256(name.encode()).hexdigest()[:15], 16)
        docs.append((i, source, len(re.findall("[^\x20\x09-\x0d]+", text or "")), h))
    sizes = {}
    for _, source, size, _ in docs:
        sizes[source] = sizes.get(source, 0) + size
    goals, out = plain_targets(sizes, weights, most), []
    for source, goal in goals.items():
        own = sorted((d for d in docs if d[1] == source), key=lambda d: d[3])
        passes, left = divmod(int(goal), sizes[source]) if sizes[source] else (0, 0)
        for h in sorted({d[3] for d in own}):
            same = [d for d in own if d[3] == h]
            held = sum(d[2] for d in same)
            part = min(left, held)
            left -= part
            for i, _, size, _ in same:
                out.append((i, size, sizes[source], float(goal), size * passes + (part * size // held if held else 0)))
    return out


SCHEMA = "doc_id long, text string, source string, size int, h string, key double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 0.5) for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)


def hard_rows():
    draw = random.Random(11)
    rows = [(i, " ".join("w" * draw.randrange(1, 60)), draw.choice(["a", "b", "b", "b", "ü", None])) for i in range(200)]
    rows += [(900, None, "a"), (901, "", "b"), (902, " \n\t ", None), (903, "x " * 20_000, "long"), (904, "", "empty"), (905, "one", "")]
    rows += [(7, "same id again", "b"), (7, "same id again", "b"), (None, "no id", "a"), (None, "no id", "a"), (None, None, "a")]
    return rows


def test_mix(spark):
    rows = hard_rows()
    df = frame(spark, rows)
    result = mixing.mix(df)
    assert got(result) == sorted(plain_mix(rows), key=repr)
    assert got(mixing.mix(df.repartition(7))) == got(result)
    assert got(mixing.mix(df, weights=(1, 9), max_epochs=2)) == sorted(plain_mix(rows, (1, 9), 2), key=repr)
    assert got(mixing.mix(df.withColumn("text", df.text.substr(1, 0)))) == sorted(
        plain_mix([(i, "" if t else t, s) for i, t, s in rows]), key=repr
    )
    assert mixing.mix(df.filter("doc_id < 0")).count() == 0


def test_one_source_reaches_its_target(spark):
    rows = [(i, "w " * (i % 9 + 1), "only") for i in range(50)]
    assert got(mixing.mix(frame(spark, rows))) == sorted(plain_mix(rows), key=repr)


def test_refining_goes_on_while_hashes_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_STEP_BITS", 1)
    rows = [(i, "w " * (i % 5 + 1), "s" + str(i % 3)) for i in range(60)]
    assert got(mixing.mix(frame(spark, rows))) == sorted(plain_mix(rows), key=repr)


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_ranked(spark, rows):
    df = spark.range(rows).selectExpr("id * 37 % 101 AS a", "id AS b").repartition(5)
    found = sorted(tuple(r) for r in ranking.ranked(df, [df.a.desc(), df.b], "place").select("place", "a", "b").collect())
    want = sorted(((i * 37 % 101, i) for i in range(rows)), key=lambda x: (-x[0], x[1]))
    assert found == [(k + 1, *x) for k, x in enumerate(want)]
