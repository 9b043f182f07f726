"""Slugs, derived URIs, external ids and embedding text."""

import hashlib
import math
import random
import re
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracklore import fixed_values as fx
from tracklore.functions import text as tx


def apply(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.out for r in frame.select("i", column.alias("out")).orderBy("i").collect()]


def uris(spark, kind, pairs):
    schema = ", ".join(f"c{i} string" for i in range(len(pairs[0])))
    parts = [F.col(f"c{i}") for i in range(len(pairs[0]))]
    return apply(spark, pairs, schema, tx.local_uri(kind, *parts))


def test_uris_of_pairs(spark):
    slugs = {
        ("Tomas Vell", "Ferry Slip"): "tomas-vell-ferry-slip",
        ("  tomas VELL ", "FERRY slip\t"): "tomas-vell-ferry-slip",
        ("Νίκη", "Δρόμος"): "νίκη-δρόμος".casefold(),
        ("Łucja", "Róża"): "łucja-róża",
        ("★", "☂☂"): "track",
        ("No. 9", "Part/2"): "no-9-part-2",
        ("No 9", "Part 2"): "no-9-part-2",
    }
    for (names, slug), uri in zip(slugs.items(), uris(spark, "track", list(slugs))):
        folded = [unicodedata.normalize("NFKC", n).strip().casefold() for n in names]
        digest = hashlib.sha256(fx.IDENTITY_SEPARATOR.join(folded).encode()).hexdigest()[:12]
        assert uri == f"spotify:track:local:v1:{slug}:{digest}"


def test_uri_rule_on_awkward_text(spark):
    names = ["Straße", "ﬁne ①", "İx", "ｆｕｌｌ", "áb", "__x__", "\x1cq\x1f", "  z  ", "ǅ", "٣ four", "½", "A\tB\nC", "·"]
    got = uris(spark, "artist", [(n,) for n in names])
    for name, uri in zip(names, got):
        identity = unicodedata.normalize("NFKC", name).strip().casefold()
        word = lambda c: c == "_" or c.isalnum()
        slug = re.sub("-+", "-", "".join(c if word(c) else "-" for c in identity)).strip("-")
        digest = hashlib.sha256(identity.encode()).hexdigest()[:12]
        assert uri == f"spotify:artist:local:v1:{slug or 'artist'}:{digest}"


def test_derived_uri_only_where_needed(spark):
    got = apply(
        spark, [("A", True), ("é", False)], "n string, need boolean",
        tx.local_uri("artist", F.col("n"), when=F.col("need")),
    )
    assert got[0] and got[1] is None


def test_slug(spark):
    got = apply(spark, [("René",), ("星空",), ("The Band!",), ("__a__b__",)], "v string", tx.clean_slug(F.col("v")))
    assert got == ["ren", "", "the_band", "a__b"]


def test_artist_uri_modes(spark):
    rows = [("星空",), ("夜空",)]
    shared = apply(spark, rows, "v string", tx.artist_uri(F.col("v")))
    safe = apply(spark, rows, "v string", tx.artist_uri(F.col("v"), collision_safe=True))
    assert shared[0] == shared[1] and safe[0] != safe[1]


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("spotify:track:4iV5", "4iV5"),
        ("spotify:track:", None),
        ("spotify:track:local:v1:x:1", None),
        ("spotify:artist:4iV5", None),
        ("", None),
    ],
)
def test_track_id(spark, uri, want):
    assert apply(spark, [(uri,)], "v string", tx.track_id(F.col("v"))) == [want]


def test_long_track_id_is_whole(spark):
    long = "x" * 300_000
    assert apply(spark, [("spotify:track:" + long,)], "v string", tx.track_id(F.col("v"))) == [long]


@pytest.mark.parametrize("digits", [1, 3])
def test_rounded_text_is_exact(spark, digits):
    rng = random.Random(digits)
    values = [0.0, -0.0, 0.0625, 2.675, 0.05, 0.25, 0.35, 1.0005, 120.0, 119.95, -0.0004, -1.5, 0.9995, 99999.9995]
    values += [rng.random() for _ in range(2000)]
    values += [rng.uniform(0, 250) for _ in range(2000)]
    values += [round(rng.uniform(0, 250), digits + 1) for _ in range(2000)]
    values += [rng.randint(0, 10**6) + (2 * rng.randint(0, 10**3) + 1) / 16 for _ in range(2000)]
    # Single-precision features widened to double.
    values += [struct.unpack("f", struct.pack("f", rng.random()))[0] for _ in range(1000)]
    values += [rng.uniform(-1e11, 1e11) for _ in range(1000)]
    # Where doubles lie as far apart as the last decimal, and further.
    values += [math.ldexp(rng.uniform(-1, 1), rng.randint(38, 56)) for _ in range(4000)]
    values += [math.ldexp(rng.random(), rng.randint(53, 1024)) for _ in range(2000)]
    values += [10.0**k for k in range(12, 309)] + [2.0**k for k in range(38, 1024)]
    values += [1e12, 2e23, 8.41e21, 9007199254740993.0, -1e16, math.inf, -math.inf, math.nan, None]
    got = apply(spark, [(v,) for v in values], "v double", tx.rounded_text(F.col("v"), digits))
    want = [None if v is None else str(round(v, digits)) for v in values]
    same = lambda g, w: g == w or ("e+" in w and len(w.split("e")[0]) > 17 and len(g) == len(w) and float(g) == float(w))
    wrong = [(v, g, w) for v, g, w in zip(values, got, want) if not same(g, w)]
    assert not wrong[:5]


def test_embedding_text(spark):
    rows = [
        ("Glass", "A, B", "Moons", 120.04, 0.5, 0.0625, None),
        ("", None, "", None, None, None, 0.1),
    ]
    columns = [F.col(c) for c in "t a l tempo e d v".split()]
    got = apply(
        spark, rows, "t string, a string, l string, tempo double, e double, d double, v double",
        tx.embedding_text(*columns),
    )
    assert got == [
        "track Glass. by A, B. album Moons. tempo 120.0 bpm. energy 0.5. danceability 0.062",
        "track unknown title. by unknown artist. valence 0.1",
    ]
