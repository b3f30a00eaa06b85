"""Typed values of variant columns. Each function gives (value, ok); an absent value is null and ok."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanstone.functions.calendar import iso_utc, local_seconds
from gleanstone.functions.extract import _items, kind_of, text_of
from gleanstone.functions.text import is_blank

# Words that stand for truth values, the mark of a cut text, and where epochs turn to milliseconds.
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")
TRUNCATION_MARK = " …[TRUNCATED]"
MILLIS_FROM = 100_000_000_000

Coerced = tuple[Column, Column]


def absent(value: Column) -> Column:
    """Missing, JSON null or a blank string."""
    return value.isNull() | F.coalesce(kind_of(value) == "VOID", F.lit(False)) | F.coalesce((kind_of(value) == "STRING") & is_blank(text_of(value)), F.lit(False))


def _number(value: Column) -> Column:
    return F.coalesce(kind_of(value).rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def text(value: Column, numbers: bool = False) -> Coerced:
    """A string; whole numbers too where ``numbers`` allows them (identifiers)."""
    whole = F.coalesce(kind_of(value).rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))"), F.lit(False))
    result = F.coalesce(text_of(value), F.when(whole, F.try_variant_get(value, "$", "string"))) if numbers else text_of(value)
    return result, absent(value) | result.isNotNull()


def integer(value: Column) -> Coerced:
    """A whole number, a float or numeric string without fraction; truth values and infinities are refused."""
    raw = F.when(_number(value), F.try_variant_get(value, "$", "string")).when(kind_of(value) == "STRING", F.trim(text_of(value)))
    number = raw.try_cast("double")
    exact = F.when(raw.rlike(r"^[+-]?\d{1,18}$"), raw.try_cast("bigint")).when((number == F.floor(number)) & (F.abs(number) < 9e18), number.cast("bigint"))
    return exact, absent(value) | exact.isNotNull()


def boolean(value: Column) -> Coerced:
    word = F.lower(F.trim(F.try_variant_get(value, "$", "string")))
    result = F.when(kind_of(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return result, absent(value) | result.isNotNull()


def timestamp(value: Column, naive_is_utc: bool = False) -> Coerced:
    """Canonical UTC text of ISO 8601 or an epoch in seconds or milliseconds; without zone only where ``naive_is_utc``."""
    raw = F.trim(F.coalesce(text_of(value), F.when(_number(value), F.try_variant_get(value, "$", "string"))))
    epoch = raw.try_cast("double")
    seconds = F.when(epoch >= MILLIS_FROM, F.floor(epoch / 1000)).otherwise(F.floor(epoch))
    form = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$"

    def instant(parts: Column) -> Column:
        number = lambda k: F.when(parts[k] == "", F.lit(0)).otherwise(parts[k].try_cast("int"))
        zone = F.replace(parts[6], F.lit(":"), F.lit(""))
        size = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
        offset = F.when(zone.isin("Z", "z"), 0).when(zone == "", F.lit(0) if naive_is_utc else F.lit(None).cast("int")).when(zone.startswith("-"), -size).otherwise(size)
        return local_seconds(*[number(k) for k in range(6)]) - offset

    # A lambda binds its argument once, where a plain expression would be copied to each use.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    parts = F.split(F.regexp_replace(raw, form, "$1|$2|$3|$4|$5|$6|$7"), r"\|")
    result = bound(F.when(raw.rlike(r"^\d+(?:\.\d+)?$"), seconds.cast("bigint")).when(raw.rlike(form), bound(parts, instant)), iso_utc)
    return result, absent(value) | result.isNotNull()


def verdicts(value: Column, criterion: str = "criterion", passed: str = "passed") -> Coerced:
    """A list of objects with these keys, or an object of truth values by criterion."""
    of = lambda x, key: F.try_variant_get(x, f"$['{key}']", "variant")
    listed = F.transform(_items(value), lambda x: F.struct(text_of(of(x, criterion)).alias("criterion"), boolean(of(x, passed))[0].alias("passed")))
    keyed = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("criterion"), boolean(e["value"])[0].alias("passed")))
    result = F.coalesce(listed, keyed)
    whole = F.forall(result, lambda v: v["criterion"].isNotNull() & v["passed"].isNotNull())
    empty = F.array().cast("array<struct<criterion:string,passed:boolean>>")
    return F.when(absent(value), empty).when(whole, result), absent(value) | F.coalesce(whole, F.lit(False))


def truncated(value: Column, most: int) -> Column:
    """At most ``most`` code points, then a visible mark."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit(TRUNCATION_MARK))).otherwise(value)


def slug(value: Column) -> Column:
    """Lower case, all but letters and digits to underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
