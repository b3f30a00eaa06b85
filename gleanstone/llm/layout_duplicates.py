"""Duplicates hidden by formatting differences.

Two texts are copies if they differ at most in white space, letter case,
punctuation or, in JSON objects and lists of named fields, field order. A
canonical text drops these differences and a 128-bit digest of it is the key.

Keys are counted exactly with partial counts. A key with more rows than
``hot_rows``, by default a task's fair share of all rows, is hot: its rows are
salted and aggregated in two levels, and its representative reaches them by a
broadcast (there are at most rows / hot_rows hot keys; their number is checked
first). All other keys take one shuffle. The
representative is the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.session import BROADCAST_ROWS, fair_share, materialize

#: Rows of one key from which it may be hot, however few rows a task has.
LEAST_HOT = 1_000

_BLANK = r"\s\p{Z}\p{Cc}\p{Cf}"
#: Punctuation; the signs of Python's string.punctuation that Unicode calls symbols belong to it.
_PUNCT = r"\p{P}`^~|<>="
#: Quantifiers are possessive, so that names, tokens and runs of any length take one pass and no stack.
_KEY = r"[\p{L}_][\p{L}\p{N}_ -]*+\s*+[:=]"
_FIELD_START = rf"(?<![\s;|])[\s&&[^\r\n]]*+[\r\n;|][\s;|]*+(?={_KEY})"
#: Only texts that begin so can be an object or a list of named fields.
_STRUCTURED = rf"^(?:(?!\{{|{_KEY})(?:_++|[{_BLANK}{_PUNCT}]))*+(?:\{{|{_KEY})"
#: A string or a number of an object.
_JSON_ATOM = r'("(?:[^"\\]++|\\.)*+")|(-?\d[\d.e+-]*+)'
#: Marks and blanks around an object or a list.
_WRAPPING = rf"^[{_BLANK}{_PUNCT}&&[^{{\[]]++|(?<![{_BLANK}{_PUNCT}&&[^}}\]]])[{_BLANK}{_PUNCT}&&[^}}\]]]++$"
#: White space other than single blanks.
_LAYOUT = rf"(?![!-~])(?:[{_BLANK}&&[^ ]]| (?= |[{_BLANK}&&[^ ]]))[{_BLANK}]*+"
#: A token with a digit keeps its inner marks, the sign of a number before it and a per cent after it.
_CODED = rf"(?:(?!-\.?\p{{Nd}})[{_PUNCT}])*+([a-z]*+[^\p{{Nd}} ]*+\p{{Nd}}(?:[^ {_PUNCT}]++|%++|[{_PUNCT}&&[^%]]++(?=[^ ]))*+)[{_PUNCT}&&[^%]]*+"
#: A single letter with a sharp is a name of its own.
_SHARP = r"(\p{L}#)(?![\p{L}\p{N}#])"
#: All other marks are layout; one that stands alone goes with the blank before it.
_MARKS = rf"(?<![^ ])(?:{_CODED}|{_SHARP})|(?![a-z])(?: [{_PUNCT}]++(?![^ ])|[{_PUNCT}]++)"
#: Beside a word or number on the same line and before a number these compare; they become signs of private use.
_COMPARISON = r"(?<=[\p{L}\p{N})\]] ?)%s(?==? ?-?\p{Nd})"


def _fold(text: Column) -> Column:
    # The German sharp s has no capital of its own in upper-cased texts.
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _words(folded: Column) -> Column:
    """Words in order without layout; the marks inside a number or code, its sign, its per cent and comparisons of numbers stay."""
    compared = F.regexp_replace(F.regexp_replace(folded, _COMPARISON % "<", "\ue000"), _COMPARISON % ">", "\ue001")
    t = F.when(F.contains(folded, F.lit("<")) | F.contains(folded, F.lit(">")), compared).otherwise(folded)
    return F.trim(F.regexp_replace(F.regexp_replace(t, _LAYOUT, " "), _MARKS, "$1$2"))


def _sorted_fields(pairs: Column) -> Column:
    lines = F.transform(pairs, lambda p: F.concat(_words(p["key"]), F.lit("\x01"), _words(p["value"])))
    return F.concat(F.lit("\x02"), F.array_join(F.array_sort(lines), "\x02"))


def canonical(df: DataFrame, text: str, output: str) -> DataFrame:
    """``df`` with ``output``: the canonical text (null for null; blank and punctuation-only texts are all the same, empty one)."""
    df = df.withColumn("_folded", _fold(F.col(text)))
    core = F.regexp_replace("_folded", _WRAPPING, "")
    df = df.withColumn("_core", F.when(F.col("_folded").rlike(_STRUCTURED), core))
    # Objects: the variant type keeps names sorted, nested ones too. Numbers are quoted first, or it would tidy their spelling.
    apart = F.replace(F.regexp_replace("_core", _JSON_ATOM, "$1\x05$2"), F.lit('"\x05'), F.lit('"'))
    tidy = F.to_json(F.try_parse_json(F.regexp_replace(apart, r"\x05([^\s,}\]]++)", '"$1"')))
    df = df.withColumn("_json", F.when(F.col("_core").startswith("{") & F.col("_core").endswith("}"), tidy))
    df = df.withColumn("_object", F.when(F.col("_json").startswith("{"), F.map_entries(F.from_json("_json", "map<string,string>"))))
    # Lists of named fields: each segment has a name before a colon or equals sign.
    parts = F.when(F.col("_object").isNull() & F.col("_core").rlike(rf"^{_KEY}") & F.col("_core").rlike(_FIELD_START), F.split("_core", _FIELD_START))
    df = df.withColumn("_parts", F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^([^:=]*)", 1).alias("key"), F.regexp_extract(x, r"(?s)^[^:=]*[:=](.*)$", 1).alias("value"))))
    names = F.transform("_parts", lambda p: _words(p["key"]))
    df = df.withColumn("_fields", F.coalesce("_object", F.when(F.size(F.array_distinct(names)) == F.size("_parts"), F.col("_parts"))))
    df = df.withColumn(output, F.when(F.col("_fields").isNotNull(), _sorted_fields(F.col("_fields"))).otherwise(_words(F.col("_folded"))))
    return df.drop("_folded", "_core", "_json", "_object", "_parts", "_fields")


def keyed(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, key) of every row with an identifier and a text; null texts are copies of nothing."""
    df = records.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text"))
    df = canonical(df, "text", "canonical")
    return df.where("record_id is not null").select("record_id", F.unhex(F.substring(F.sha2("canonical", 256), 1, 32)).alias("key"))


def copies(records: DataFrame, record_id: str = "record_id", text: str = "input_text", hot_rows: int | None = None) -> DataFrame:
    """(keep_id, copy_id): every record that is a copy, once, with the smallest identifier of its copies.

    ``hot_rows``: rows beyond which a key is salted; it changes how the result comes about, never the result.

    Rows repeated whole are one record. Null identifiers and null texts take no part; empty tables
    give no rows; other columns are ignored, whatever their names.
    """
    # Only null texts have null keys; a filter on the key itself would repeat its whole expression.
    rows = materialize(keyed(records.where(F.col(text).isNotNull()), record_id, text))
    limit = fair_share(rows.count(), records.sparkSession, LEAST_HOT) if hot_rows is None else hot_rows
    hot = rows.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / max(limit, 1)).alias("parts"))
    hot = materialize(hot)
    many = hot.limit(BROADCAST_ROWS + 1).count()
    side = F.broadcast(hot) if many <= BROADCAST_ROWS else hot

    cold_rows = rows.join(side, "key", "left_anti") if many else rows
    # One shuffle: the repartitioning serves the removal of repeated rows and the window as well.
    cold = cold_rows.repartition("key").dropDuplicates(["key", "record_id"])
    cold = cold.withColumn("keep_id", F.min("record_id").over(Window.partitionBy("key")))
    out = cold.where("keep_id <> record_id").select("keep_id", F.col("record_id").alias("copy_id"))
    if not many:
        return out

    salted = rows.join(side, "key").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.col("parts"))).drop("parts")
    unique = salted.dropDuplicates(["key", "salt", "record_id"])
    least = unique.groupBy("key", "salt").agg(F.min("record_id").alias("keep_id")).groupBy("key").agg(F.min("keep_id").alias("keep_id"))
    least = F.broadcast(least) if many <= BROADCAST_ROWS else least
    hot_out = unique.join(least, "key").where("keep_id <> record_id").select("keep_id", F.col("record_id").alias("copy_id"))
    return out.unionByName(hot_out)


def collapsed(records: DataFrame, record_id: str = "record_id", text: str = "input_text", hot_rows: int | None = None) -> DataFrame:
    """(record_id, duplicates_dropped) of every kept record, those without copies included."""
    found = materialize(copies(records, record_id, text, hot_rows))
    dropped = found.groupBy(F.col("keep_id").alias("record_id")).agg(F.count("*").alias("duplicates_dropped"))
    ids = records.select(F.col(record_id).cast("string").alias("record_id")).where("record_id is not null").distinct()
    kept = ids.join(found.select(F.col("copy_id").alias("record_id")), "record_id", "left_anti")
    return kept.join(dropped, "record_id", "left").na.fill(0, ["duplicates_dropped"])
