"""ISO-8601 text to UTC timestamps."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a text value.
WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# The shapes nearly every export uses; Spark's own cast reads them directly. Years at
# either end of the calendar, where an offset may lead outside it, are left out.
_USUAL = (
    r"^(?!0000|0001|9999)\d{4}-\d{2}-\d{2}"
    r"(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?)?)?$"
)

# The rest of ISO 8601: basic and week dates, hour-only times, any separator,
# comma fractions, second-level offsets.
_DATE = (
    r"(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})"
    r"|(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?)"
)
_TIME = (
    r"(?:(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
    r"|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)"
)
_OFFSET = r"(?: ?Z| ?([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?)?"
_GENERAL = rf"^{_DATE}(?:(?s:.){_TIME}{_OFFSET})?$"
# One replacement yields all pieces, so the pattern runs once per row.
_PIECES = "$1$4|$2$5|$3$6|$7$10|$8$11|$9$12|$13$17|$14$18|$15$19|$16$20|$21|$22|$23|$24"


def _or_default(piece: Column, default: str) -> Column:
    return F.when(piece == "", F.lit(default)).otherwise(piece)


def _from_pieces(p: Column) -> Column:
    year, month, day, wyear, week, wday = (p[i] for i in range(6))
    hour, minute, second, fraction = (p[i] for i in range(6, 10))
    sign, off_h, off_m, off_s = (p[i] for i in range(10, 14))

    plain_date = F.concat_ws("-", year, month, day).try_cast("date")
    # ISO week 1 is the week that holds 4 January; weeks start on Monday.
    week_no = week.cast("int")
    week_day = _or_default(wday, "1").cast("int")
    first_monday = F.trunc(F.concat(wyear, F.lit("-01-04")).try_cast("date"), "week")
    monday = F.date_add(first_monday, (week_no - 1) * 7)
    week_ok = (week_no >= 1) & week_day.between(1, 7) & (F.weekofyear(monday) == week_no)
    week_date = F.when(week_ok, F.date_add(monday, week_day - 1))
    date = F.when(week == "", F.when(year != "0000", plain_date)).otherwise(
        F.when(wyear != "0000", week_date)
    )

    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0")
    clock = F.concat(
        _or_default(hour, "00"), F.lit(":"), _or_default(minute, "00"), F.lit(":"),
        _or_default(second, "00"), F.lit("."), micros,
    )
    local = F.concat_ws(" ", date.cast("string"), clock).try_cast("timestamp_ntz")
    offset = (
        _or_default(off_h, "0").cast("int") * 3600
        + _or_default(off_m, "0").cast("int") * 60
        + _or_default(off_s, "0").cast("int")
    )
    shift = F.when(sign == "-", offset).otherwise(-offset)
    shifted = local + F.make_dt_interval(secs=shift.cast("decimal(18,6)"))
    usable = date.isNotNull() & (offset < 86400) & F.year(shifted).between(1, 9999)
    return F.when(usable, shifted.cast("timestamp"))


def _parse_general(text: Column) -> Column:
    # The lambda names the pieces once. Without it every use would repeat the pattern
    # in the generated code, which the usual rows would have to carry along.
    pieces = F.split(F.regexp_replace(text, _GENERAL, _PIECES), r"\|")
    return F.transform(F.array(pieces), _from_pieces)[0]


def parse_timestamp(value: Column) -> Column:
    """ISO text to a UTC timestamp; anything else, or an impossible date, is NULL.

    A value without an offset is read as UTC. Needs the session zone to be UTC.
    """
    text = F.btrim(value, F.lit(WHITESPACE))
    return F.when(text.rlike(_USUAL), text.try_cast("timestamp")).when(
        text.rlike(_GENERAL), _parse_general(text)
    )
