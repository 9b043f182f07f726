"""Timestamps against the standard library's ISO parser."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracklore.functions.timestamps import parse_timestamp


def parsed(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    micros = F.unix_micros(parse_timestamp(F.col("v")))
    return {values[r.i]: r.m for r in rows.select("i", micros.alias("m")).collect()}


def expected(value):
    try:
        at = datetime.fromisoformat(value.strip())
        at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None
    since = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86400 + since.seconds) * 10**6 + since.microseconds


@pytest.mark.parametrize(
    "raw",
    ["20311108T224500Z", "2031-11-09T04:15+05:30", "2031-11-08 22:45:00.000000", "2031-W45-6T19:15:00-03:30"],
)
def test_spellings_of_one_instant(spark, raw):
    assert parsed(spark, [raw])[raw] == expected("2031-11-08T22:45:00Z")


def test_values_without_an_instant(spark):
    bad = [" ", "soon", "1999-11-31T08:00", "08:15:00", "31.12.1999", "{}", "1999", "1999-9-9"]
    got = parsed(spark, bad)
    assert all(got[v] is None for v in bad)
    nulls = spark.sql("SELECT CAST(NULL AS STRING) AS v").select(parse_timestamp(F.col("v")))
    assert nulls.first()[0] is None


def test_other_iso_forms(spark):
    values = [
        "20250102T103000", "20250102T1030", "20250102 10", "2025-W01-4", "2025W014T10:30",
        "2025-W01", "2025-W53-1", "2020-W53-7", "2025-W00-1", "2025-W01-8", "2025-W01-0",
        "2025-01-02x10:30", "2025-01-02T10", "2025-01-02T10:30:15,123456789",
        "2025-01-02T10:30:15.1", "2025-01-02T10:30+05:30", "2025-01-02T10:30+23:59",
        "2025-01-02T10:30+24:00", "2025-01-02T10:30-19:00:30", "2025-01-02T10:30:60",
        "2025-01-02T23:60", "0000-01-01", "0001-01-01T00:00+05:00", "9999-12-31T23:00-05:00",
        "  2025-01-02  ", "2025-01-02T10:30z", "2025-01-02 10:30 Europe/Paris", "2024-02-29",
        "2023-02-29", "2025-01-02T", "2025-01-02T10:3", "2025-13-01", " 2025-01-02　",
        "20250102", "2025-001", "2025-01-02T1030+0530", "2025-01-02T10:30:00 +01:00",
    ]
    got = parsed(spark, values)
    assert {v: got[v] for v in values} == {v: expected(v) for v in values}


def test_random_forms(spark):
    rng = random.Random(7)
    values = set()
    for _ in range(3000):
        y, m, d = rng.randint(1, 9999), rng.randint(0, 13), rng.randint(0, 32)
        date = rng.choice([f"{y:04}-{m:02}-{d:02}", f"{y:04}{m:02}{d:02}", f"{y:04}-W{rng.randint(0, 54):02}-{rng.randint(0, 8)}"])
        h, mi, s = rng.randint(0, 23), rng.randint(0, 61), rng.randint(0, 61)
        frac = str(rng.randint(0, 10**9))
        clock = rng.choice(["", f"T{h:02}", f" {h:02}:{mi:02}", f"T{h:02}:{mi:02}:{s:02}", f"T{h:02}:{mi:02}:{s:02}.{frac}", f"T{h:02}{mi:02}{s:02}"])
        zone = rng.choice(["", "Z", f"+{rng.randint(0, 25):02}:{rng.randint(0, 59):02}", f"-{rng.randint(0, 25):02}{rng.randint(0, 59):02}"]) if clock else ""
        values.add(date + clock + zone)
    values = sorted(values)
    got = parsed(spark, values)
    wrong = {v: (got[v], expected(v)) for v in values if got[v] != expected(v)}
    assert not wrong
