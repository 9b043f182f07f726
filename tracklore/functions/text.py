"""Text functions: slugs, derived URIs, external ids, embedding text."""

from __future__ import annotations

import math
import unicodedata
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracklore import fixed_values as fx
from tracklore.functions.timestamps import WHITESPACE

_ASCII_ONLY = r"^[\x00-\x7F]*$"


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def clean_slug(value: Column) -> Column:
    """ASCII slug: lower case, other characters to ``_``, no ``_`` at the ends."""
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]", "_"), F.lit("_"))


@F.arrow_udf(StringType())
def _unicode_identity(*components: pa.Array) -> pa.Array:
    if any(part.null_count == len(part) for part in components):
        # The usual batch: every row was done in generated code.
        return pa.nulls(len(components[0]), pa.string())
    rows = zip(*(part.to_pylist() for part in components))
    return pa.array(
        [
            None if None in row else fx.IDENTITY_SEPARATOR.join(
                unicodedata.normalize("NFKC", s).strip().casefold() for s in row
            )
            for row in rows
        ],
        pa.string(),
    )


def identity(*components: Column, when: Column | None = None) -> Column:
    """Compatibility-normalised, trimmed, case-folded names, joined.

    Spark has no NFKC or case folding. For ASCII text both reduce to ``lower``,
    which stays in generated code; only other text is handed to Python, in Arrow
    batches that carry NULL for every row already done or not asked for.
    """
    ascii_only = F.concat(*components).rlike(_ASCII_ONLY)
    native = F.concat_ws(
        fx.IDENTITY_SEPARATOR, *[F.lower(F.btrim(c, F.lit(WHITESPACE))) for c in components]
    )
    needed = ~ascii_only if when is None else when & ~ascii_only
    return F.when(ascii_only, native).otherwise(
        _unicode_identity(*[F.when(needed, c) for c in components])
    )


def uri_of_identity(entity_type: str, name: Column) -> Column:
    """URI of an identity: readable slug plus a hash prefix of the exact identity, so
    that names sharing a slug stay apart."""
    slug = F.btrim(F.regexp_replace(name, r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))
    return F.concat_ws(
        ":",
        F.lit(fx.URI_SCHEME),
        F.lit(entity_type),
        F.lit(fx.LOCAL_URI_VERSION),
        F.regexp_replace(slug, "^$", entity_type),
        F.substring(F.sha2(name, 256), 1, fx.IDENTITY_HASH_LENGTH),
    )


def local_uri(entity_type: str, *components: Column, when: Column | None = None) -> Column:
    """Stable URI derived from an entity's names.

    ``when`` limits the work to rows that need a derived URI; others get NULL.
    """
    wanted = F.concat(*components).isNotNull()
    if when is not None:
        wanted = when & wanted
    return F.when(wanted, uri_of_identity(entity_type, identity(*components, when=when)))


def artist_uri(name: Column, collision_safe: bool = False) -> Column:
    """URI of an artist known only by name.

    The default slug is ASCII only: all names without a Latin letter or digit share
    one URI. ``collision_safe`` gives each name its own.
    """
    if collision_safe:
        return local_uri("artist", name)
    return F.concat(F.lit(fx.LOCAL_ARTIST_PREFIX), clean_slug(name))


def track_id(uri: Column) -> Column:
    """External id inside a track URI; NULL for local or foreign URIs."""
    rest = F.substr(uri, F.lit(len(fx.TRACK_URI_PREFIX) + 1))
    usable = uri.startswith(fx.TRACK_URI_PREFIX) & (rest != "") & ~rest.startswith(fx.LOCAL_ID_PREFIX)
    return F.when(usable, rest)


def _exact_units(x: Column, digits: int) -> Column:
    """x * 10**digits to the nearest whole number, ties to even, for 0 <= x < 2**53.

    Multiplying is made exact by splitting the double into two short halves (Veltkamp's
    split), so the half-way test sees no rounding error.
    """
    scale = 10**digits
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    a = high * F.lit(float(scale))
    b = (x - high) * F.lit(float(scale))
    # x * scale == floor(a) + rint(b) + fa + fb, every term exact.
    fa = a - F.floor(a)
    fb = b - F.rint(b)
    whole = F.floor(a) + F.rint(b).cast("bigint")
    half = (fa - F.lit(0.5)) + fb
    odd = whole % 2 == 1
    return whole + (
        F.when((half > 0) | ((half == 0) & odd), 1)
        .when((fa == 0) & (fb == -0.5) & odd, -1)
        .otherwise(0)
    )


def _rounded_exactly(value: Column, digits: int) -> Column:
    """``rounded_text`` for any value, deciding on the exact binary value.

    Once doubles lie further apart than the last decimal, rounding changes none of them.
    """
    x = F.abs(value)
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    coarse = 2.0 ** (53 - math.ceil(math.log2(10**digits)))
    rounded = _scaled_text(_exact_units(x, digits), digits)
    return F.concat(sign, F.when(x < F.lit(coarse), rounded).otherwise(_coarse_text(x, digits)))


def _coarse_text(x: Column, digits: int) -> Column:
    """The shortest decimal that reads as ``x``, whose neighbours differ by 10**-digits or
    more; from 1e16 with an exponent, then ``inf`` and ``nan``.

    From 1e16, where two of 17 digits read as ``x``, it may be the one further off.
    """
    plain = F.when(x == F.rint(x), F.concat(x.cast("bigint").cast("string"), F.lit(".0")))
    for places in range(1, digits + 1):
        text = _scaled_text(_exact_units(x, places), places)
        plain = plain.when(text.cast("double") == x, text) if places < digits else plain.otherwise(text)
    # The JVM may print digits more than needed, so fewer are tried first.
    printed = x.cast("string")
    mantissa = F.substring_index(printed, "E", 1)
    power = F.substring_index(printed, "E", -1)
    fewer = [
        F.concat(cut(mantissa.cast("decimal(20,18)"), places).cast("string"), F.lit("E"), power)
        for places in (14, 15, 16)
        for cut in (F.round, F.ceil)
    ]
    shortest = F.coalesce(*[F.when(t.cast("double") == x, t) for t in fewer], printed)
    large = F.regexp_replace(shortest, r"\.?0*E", "e+")
    return (
        F.when(F.isnan(x), "nan")
        .when(x == F.lit(float("inf")), "inf")
        .when(x < F.lit(1e16), plain)
        .otherwise(large)
    )


def _scaled_text(units: Column, digits: int) -> Column:
    """units / 10**digits in its shortest decimal form, with at least one decimal."""
    exact = units.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-digits))
    return F.regexp_replace(exact.cast("string"), r"(\.\d+?)0+$", "$1")


def rounded_text(value: Column, digits: int) -> Column:
    """A double rounded to ``digits`` places, ties to even, in its shortest form.

    Away from the half-way points plain arithmetic is safe; only values close to one,
    and those without a positive sign, take the exact but longer route. It is kept in a
    lambda so that the generated code of the usual route stays short.
    """
    scaled = value * F.lit(float(10**digits))
    clear = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > F.lit(0.001)
    return F.when(
        (value > 0) & (value < F.lit(1e9)) & clear, _scaled_text(F.rint(scaled), digits)
    ).otherwise(F.transform(F.array(value), lambda v: _rounded_exactly(v, digits))[0])


def embedding_text(
    title: Column,
    artist_names: Column,
    album_name: Column,
    tempo: Column,
    energy: Column,
    danceability: Column,
    valence: Column,
) -> Column:
    """One sentence-like text per track; parts without a value are left out."""

    def part(label: str, text: Column, tail: str = "") -> Column:
        return F.concat(F.lit(label + " "), text, F.lit(tail))

    return F.concat_ws(
        fx.TEXT_PART_SEPARATOR,
        part("track", F.coalesce(blank_to_null(title), F.lit(fx.TEXT_DEFAULT_TITLE))),
        part("by", F.coalesce(blank_to_null(artist_names), F.lit(fx.TEXT_DEFAULT_ARTIST))),
        part("album", blank_to_null(album_name)),
        part("tempo", rounded_text(tempo, 1), " bpm"),
        part("energy", rounded_text(energy, 3)),
        part("danceability", rounded_text(danceability, 3)),
        part("valence", rounded_text(valence, 3)),
    )
