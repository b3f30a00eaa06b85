"""Reaching into semi-structured rows: paths and extractors on variant columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanstone.errors import ConfigError


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def at_path(row: Column, path: str) -> Column:
    """The variant at a dotted path, null where there is none.

    ``.`` alone is the whole row; a whole number indexes a list, from its end if negative;
    an object's key of that name goes first.
    """
    if path == ".":
        return row
    value = row
    for part in path.split("."):
        if not part.strip() or "'" in part:
            raise ConfigError(f"a path has no empty parts or quotes: {path!r}")
        found = F.try_variant_get(value, f"$['{part}']", "variant")
        if re.fullmatch(r"-?\d+", part):
            n = int(part)
            found = F.coalesce(found, F.try_element_at(_items(value), F.lit(n + 1 if n >= 0 else n)))
        value = found
    return value


#: Options of a reader that takes only plain JSON.
PLAIN_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedControlChars": "false"}


def _wrapped(text: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))


def is_one_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value; a parser alone stops after the first. Null for null."""
    listed, named = _wrapped(text)
    return F.try_parse_json(listed).isNotNull() & F.try_parse_json(named).isNotNull() & (F.regexp_replace(text, r"\s+", "") != "") & F.try_variant_get(F.try_parse_json(listed), "$[1]", "variant").isNull()


def with_last_names(text: Column) -> Column:
    """The variant of an object that repeats names, the last of each winning; null for anything else that is no variant."""
    listed, named = _wrapped(text)
    one = F.from_json(listed, "array<map<string,string>>", PLAIN_JSON)
    sound = (F.size(one) == 1) & F.from_json(named, "v map<string,string>, _corrupt string", PLAIN_JSON)["_corrupt"].isNull() & text.rlike(r"^\s*\{")
    entries = F.map_entries(F.get(one, F.lit(0)))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    pair = lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.when(e["value"].isNull(), "null").when(e["value"].rlike(r"^\s*[\[{]"), e["value"]).otherwise(quoted(e["value"])))
    return F.when(sound, F.try_parse_json(F.concat(F.lit("{"), F.array_join(F.transform(last, pair), ","), F.lit("}"))))


def text_of(value: Column) -> Column:
    """The string, null for other types."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def join_text(value: Column) -> Column:
    """A string as it is; of a list its strings, a line each; else null."""
    strings = F.filter(F.transform(_items(value), text_of), lambda x: x.isNotNull())
    return F.coalesce(text_of(value), F.when(F.size(strings) > 0, F.array_join(strings, "\n")))


def last_message(role: str):
    """Text of the last message of ``role``: its string content, or its text parts, a line each. Earlier ones don't stand in."""

    def extract(value: Column) -> Column:
        said = F.filter(_items(value), lambda m: F.try_variant_get(m, "$.role", "string") == role)
        content = F.try_variant_get(F.try_element_at(said, F.lit(-1)), "$.content", "variant")
        parts = F.filter(_items(content), lambda p: F.try_variant_get(p, "$.type", "string") == "text")
        texts = F.filter(F.transform(parts, lambda p: text_of(F.try_variant_get(p, "$.text", "variant"))), lambda x: x.isNotNull())
        return F.coalesce(text_of(content), F.when(F.size(texts) > 0, F.array_join(texts, "\n")))

    return extract


#: Extractors that give text; ``identity`` passes the variant on.
EXTRACTORS = {"identity": None, "join_text": join_text, "openai_last_user_message": last_message("user"), "openai_assistant_message": last_message("assistant")}


def extract(row: Column, path: str, extractor: str = "identity") -> Column:
    """The variant that a field's path and extractor name."""
    if extractor not in EXTRACTORS:
        raise ConfigError(f"unknown extractor {extractor!r}; known: {', '.join(EXTRACTORS)}")
    value = at_path(row, path)
    make = EXTRACTORS[extractor]
    return value if make is None else _as_variant(make(value))


def _as_variant(text: Column) -> Column:
    return F.when(text.isNotNull(), F.try_variant_get(F.try_parse_json(F.to_json(F.struct(text.alias("v")))), "$.v", "variant"))
