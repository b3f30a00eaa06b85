"""Mixed timestamp formats and time zones: every value to one UTC form, or unresolvable.

Values are split into wall-clock fields and a zone part by regular expressions.
A value with an offset, ``Z`` or a settled abbreviation is an instant at once.
The rest are wall-clock readings of a named zone: they meet, in an as-of join,
the zone's offset intervals exploded by year. One matching interval gives the
offset, two mean that the zone has this reading twice, none that it never has.

Only the (zone, year) pairs that occur get intervals, so the joined side is
bounded by zones x years, not by rows; its size is counted before a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.functions.calendar import CANONICAL, LAST_SECOND, iso_utc, local_seconds
from gleanstone.functions.text import first_of
from gleanstone.session import broadcast_within, materialize, where_computed

# Abbreviations that stand for one offset everywhere, in seconds east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 3600, "CET": 3600, "CEST": 7200, "MEZ": 3600, "MESZ": 7200,
    "EET": 7200, "EEST": 10800, "MSK": 10800, "EST": -18000, "EDT": -14400, "CDT": -18000, "MDT": -21600, "MST": -25200,
    "PST": -28800, "PDT": -25200, "AKST": -32400, "AKDT": -28800, "HST": -36000, "JST": 32400, "KST": 32400,
    "AEST": 36000, "AEDT": 39600, "ACST": 34200, "ACDT": 37800, "AWST": 28800, "NZST": 43200, "NZDT": 46800, "SGT": 28800,
}
# Abbreviations that several zones share; the source's own zone must settle them.
SHARED = {"IST": {"asia/kolkata": 19800, "asia/calcutta": 19800, "asia/jerusalem": 7200, "europe/dublin": 3600}, "BST": {"europe/london": 3600}, "CST": {"america/chicago": -21600, "asia/shanghai": 28800}}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d*)?)?"
_DAYNAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_AMPM = r"\s*(?:([ap])\.?m\b\.?)?"
_REST = r"\s*(.*)$"
#: Each form rewrites to year|month|day|hour|minute|second|a or p|zone part|order of the date.
FORMS = {
    rf"(?i)^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:t|,?\s+){_TIME}{_AMPM}{_REST}": r"$1|$3|$4|$5|$6|$7|$8|$9|",
    rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,]\d*)?)?{_REST}": r"$1|$2|$3|$4|$5|$6||$7|",
    rf"(?i)^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:t|,?\s+){_TIME}{_AMPM}{_REST}": r"$4|$3|$1|$5|$6|$7|$8|$9|?",
    rf"(?i)^{_DAYNAME}(\d{{1,2}})[ -]([a-z]{{3,9}})\.?,?[ -](\d{{4}}),?\s+{_TIME}{_AMPM}{_REST}": r"$3|$2|$1|$4|$5|$6|$7|$8|",
    rf"(?i)^{_DAYNAME}([a-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+{_TIME}{_AMPM}{_REST}": r"$3|$1|$2|$4|$5|$6|$7|$8|",
}
NUMBER = r"^\d+(?:\.\d*)?$"


def _fields(value: Column) -> Column:
    out = None
    for pattern, target in FORMS.items():
        parts = F.split(F.regexp_replace(value, pattern, target), r"\|")
        out = F.when(value.rlike(pattern), parts) if out is None else out.when(value.rlike(pattern), parts)
    return out


def _epoch(value: Column) -> Column:
    """Whole seconds of a non-negative number whose size tells its unit; what is finer than a second is cut, digit by digit."""
    digits = F.regexp_extract(value, r"^0*(\d*)", 1)
    size = F.length(digits)
    finer = F.when(size <= 11, 0).when(size <= 14, 3).when(size <= 17, 6).otherwise(9)
    return F.when(digits == "", F.lit(0)).otherwise(F.substr(digits, F.lit(1), size - finer).try_cast("bigint"))


def parse_wall_clock(df: DataFrame, value: str, date_order: str, naive_is_utc: str, naive_zone: str) -> DataFrame:
    """Adds ``_local`` (wall-clock seconds), ``_offset`` (seconds, where settled), ``_zone`` (lower case, where a zone must settle it)."""
    v = F.regexp_replace(F.col(value), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    at = lambda i: F.get("_p", F.lit(i))
    col = F.col
    # Each step is a projection of its own, so that no expression is computed twice.
    df = df.withColumn("_v", v).withColumn("_p", _fields(col("_v"))).withColumns(
        {"_y": at(0).try_cast("int"), "_w": at(1), "_d": at(2).try_cast("int"), "_h": at(3).try_cast("int"), "_n": at(4).try_cast("int"), "_s": F.when(at(5) == "", 0).otherwise(at(5).try_cast("int")), "_half": F.lower(at(6)), "_tz": F.regexp_replace(at(7), r"\s*\(\w+\)$", ""), "_kind": at(8)}
    )
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring("_w", 1, 3))).cast("int")
    df = df.withColumn("_m", F.coalesce(col("_w").try_cast("int"), F.when(named > 0, named)))
    # A numeric date without a stated order still has one reading if only one is a date.
    second, third, loose = col("_m"), col("_d"), col("_kind") == "?"
    dmy, mdy = (second <= 12) & (third <= 31), (third <= 12) & (second <= 31)
    stated_order = F.coalesce(col(date_order).isin("dmy", "mdy"), F.lit(False))
    swap = first_of((~loose, False), (stated_order, col(date_order) == "mdy"), (dmy & mdy & (second != third), None), otherwise=mdy & ~dmy)
    h, half = col("_h"), col("_half")
    df = df.withColumns({"_swap": swap, "_h": F.when(half == "", h).when(~h.between(1, 12), None).when(half == "a", h % 12).otherwise(h % 12 + 12)})
    df = df.withColumns({"_m": F.when(col("_swap"), col("_d")).when(~col("_swap"), col("_m")), "_d": F.when(col("_swap"), col("_m")).otherwise(col("_d"))})
    local = local_seconds(col("_y"), col("_m"), col("_d"), col("_h"), col("_n"), col("_s"))

    tz = col("_tz")
    stated = r"^([+\x{2212}-])(\d{2}):?(\d{2})(?::?(\d{2}))?(?:\s*\[[\w/+-]+\])?$"
    pieces = F.split(F.regexp_replace(tz, stated, "$1|$2|$3|$4"), r"\|")
    df = df.withColumns({"_z": F.when(tz.rlike(stated), pieces), "_number": col("_v").rlike(NUMBER), "_short": F.upper(tz)})
    piece = lambda k: F.coalesce(F.get("_z", F.lit(k)).try_cast("int"), F.lit(0))
    df = df.withColumn("_size", F.when((piece(2) < 60) & (piece(3) < 60), piece(1) * 3600 + piece(2) * 60 + piece(3)))
    numeric = F.when(col("_size") <= 18 * 3600, F.when(F.get("_z", F.lit(0)) == "+", col("_size")).otherwise(-col("_size")))
    short = col("_short")
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    home = F.lower(col(naive_zone))
    shared = first_of(*[((short == a) & (home == z), o) for a, zones in SHARED.items() for z, o in zones.items()], otherwise=F.lit(None).cast("int"))
    bracket = F.regexp_extract(tz, r"^\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?$", 1)
    naive, as_utc = tz == "", F.coalesce(col(naive_is_utc), F.lit(False))
    offset = first_of((col("_number"), 0), (naive & as_utc, 0), (col("_z").isNotNull(), numeric), (short.isin(*ABBREVIATIONS), F.element_at(known, short)), otherwise=shared)
    zone = first_of((col("_number"), None), (naive & ~as_utc, home), (bracket != "", F.lower(bracket)), otherwise=F.lit(None).cast("string"))
    out = df.withColumns({"_local": F.when(col("_number"), _epoch(col("_v"))).otherwise(local), "_offset": offset, "_zone": zone})
    return out.drop("_v", "_p", "_y", "_w", "_d", "_h", "_n", "_s", "_half", "_tz", "_kind", "_m", "_swap", "_z", "_number", "_short", "_size")


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from datetime import UTC, datetime, timedelta
    from zoneinfo import ZoneInfo, available_timezones

    names = {z.lower(): z for z in available_timezones()}
    for batch in batches:
        rows = []
        for zone, year in zip(batch["zone"], batch["year"]):
            if zone not in names or pd.isna(year) or not 2 <= (year := int(year)) <= 9998:
                continue
            z = ZoneInfo(names[zone])
            at = lambda u, z=z: int((datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=u)).astimezone(z).utcoffset().total_seconds())
            begin = int((datetime(year, 1, 1) - datetime(1970, 1, 1)).total_seconds()) - 172_800
            end = int((datetime(year + 1, 1, 1) - datetime(1970, 1, 1)).total_seconds()) + 172_800
            u, offset = begin, at(begin)
            start = begin
            while u < end:
                v = min(u + 21_600, end)
                if (new := at(v)) != offset:
                    low, high = u, v
                    while high - low > 1:
                        mid = (low + high) // 2
                        low, high = (mid, high) if at(mid) == offset else (low, mid)
                    rows.append((zone, year, start + offset, high + offset, offset))
                    start, offset, u = high, at(high), high
                else:
                    u = v
            rows.append((zone, year, start + offset, end + offset, offset))
        yield pd.DataFrame(rows, columns=["zone", "year", "begins", "ends", "offset"])


def zone_intervals(pairs: DataFrame) -> DataFrame:
    """Offset intervals in local seconds ``[begins, ends)`` of each (zone, year); unknown zones get none."""
    return pairs.mapInPandas(_offsets, "zone string, year int, begins bigint, ends bigint, offset int")


def resolve_instants(df: DataFrame, value: str, date_order: str = "date_order", naive_is_utc: str = "naive_is_utc", naive_zone: str = "naive_zone", output: str = "instant_utc") -> DataFrame:
    """``df`` with ``output``: the value's one instant as ``YYYY-MM-DDTHH:MM:SSZ``, or null if it has none or several.

    Nulls, blanks, impossible dates, negative numbers, unknown zones and readings that their
    zone has twice or never give null. Rows are neither dropped nor added, repeated ones included;
    names beginning with an underscore are reserved for the operator.
    """
    df = parse_wall_clock(df, value, date_order, naive_is_utc, naive_zone)
    day = F.floor(F.col("_local") / 86_400).cast("int")
    df = df.withColumn("_year", F.when(F.col("_zone").isNotNull(), F.year(F.date_from_unix_date(day))))
    # No filter here: pushed below the parse, it would repeat the whole parse. Null pairs are skipped later.
    pairs = df.select(F.col("_zone").alias("zone"), F.col("_year").alias("year")).distinct()
    intervals = materialize(zone_intervals(pairs))
    spans = intervals.groupBy(F.col("zone").alias("_zone"), F.col("year").alias("_year")).agg(F.collect_list(F.struct("begins", "ends", "offset")).alias("_spans"))
    df = df.join(broadcast_within(spans), ["_zone", "_year"], "left")
    hits = F.filter("_spans", lambda s: (s["begins"] <= F.col("_local")) & (F.col("_local") < s["ends"]))
    df = df.withColumn("_hits", hits)
    offset = F.when(F.col("_zone").isNull(), F.col("_offset")).when(F.size("_hits") == 1, F.get("_hits", F.lit(0))["offset"])
    seconds = F.col("_local") - offset
    fine = seconds <= LAST_SECOND
    return df.withColumn(output, F.when(fine, iso_utc(seconds))).drop("_local", "_offset", "_zone", "_year", "_spans", "_hits")


def untidy_instants(sources: list[tuple[str, DataFrame, str, str]], mappings: DataFrame) -> DataFrame:
    """Rows (table_name, row_key, instant_utc) of values that are not canonical yet and stand for one instant.

    ``sources``: (table name, table, key column, value column); each table has ``mapping_name``.
    A row delivered twice is one; a mapping that ``mappings`` lacks settles nothing. Empty tables give no rows.
    """
    rows = None
    for name, df, key, value in sources:
        part = df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), F.col(value).alias("value"), "mapping_name").where(F.col(value).isNotNull() & ~F.col(value).rlike(CANONICAL))
        rows = part if rows is None else rows.unionByName(part)
    mappings = mappings.select("mapping_name", "date_order", "naive_is_utc", "naive_zone").dropDuplicates(["mapping_name"])
    rows = rows.join(broadcast_within(mappings), "mapping_name", "left")
    out = resolve_instants(rows, "value")
    return where_computed(out, F.col("instant_utc").isNotNull()).select("table_name", "row_key", "instant_utc").distinct()
