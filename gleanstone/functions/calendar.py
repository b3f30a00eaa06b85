"""Calendar arithmetic as Column expressions, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last second that a four-digit year can hold.
LAST_SECOND = 253_402_300_799


def valid_date(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(1, 9999) & m.between(1, 12) & d.between(1, last)


def local_seconds(y: Column, m: Column, d: Column, hh: Column, mm: Column, ss: Column) -> Column:
    """Seconds since 1970-01-01 of a wall-clock reading; null for impossible ones."""
    ok = valid_date(y, m, d) & hh.between(0, 23) & mm.between(0, 59) & ss.between(0, 59)
    # Shifted months make February the last one, so its length needs no case.
    yy, mp = y - F.when(m <= 2, 1).otherwise(0), (m + 9) % 12
    days = 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + F.floor((153 * mp + 2) / 5) + d - 719_469
    return F.when(ok, days.cast("bigint") * 86_400 + hh * 3_600 + mm * 60 + ss)


def iso_utc(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of epoch seconds; null outside years 1 to 9999."""
    day = F.floor(seconds / 86_400)
    rest = (seconds - day * 86_400).cast("int")
    two = lambda x: F.lpad(F.floor(x).cast("int").cast("string"), 2, "0")
    text = F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(rest / 3_600), F.lit(":"),
        two(rest % 3_600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"),
    )
    return F.when(seconds.between(-62_135_596_800, LAST_SECOND), text)


CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def real_canonical(text: Column) -> Column:
    """True where ``text`` is an existing instant in exactly the canonical form; null counts as false."""
    piece = lambda a, n: F.substring(text, a, n).try_cast("int")
    seconds = local_seconds(piece(1, 4), piece(6, 2), piece(9, 2), piece(12, 2), piece(15, 2), piece(18, 2))
    return F.coalesce(text.rlike(CANONICAL) & seconds.isNotNull(), F.lit(False))
