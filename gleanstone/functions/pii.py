"""Eight classes of personal data as Column expressions: spans, overlap resolution, replacement.

Offsets come without leaving the JVM: the text is split at the matches, and the lengths
of the pieces and matches before one add up to where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanstone.config import NAME_ALLOWLIST

# The classes in order of priority, and the patterns of their formats.
CLASSES = ("EMAIL", "IBAN", "CARD", "SSN", "IPV4", "PHONE", "ADDRESS", "NAME")
STRUCTURAL = ("EMAIL", "CARD", "IBAN", "SSN", "IPV4")
EMAIL = r"[A-Za-z0-9._%+\-']+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
CARD = r"(?<!\d)\d(?:[ \-._]?\d){12,18}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Za-z0-9]{4}){2,7}(?:[ ]?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\d-])\d{3}([- ])\d{2}\1\d{4}(?![\d-])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
IPV4 = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]\d{2,6}){1,4}|\(\d{1,4}\)[ -]?\d{2,4}(?:[ -]\d{2,6}){1,4}|\d{2,4}(?:[ -]\d{2,6}){2,4})(?!\w)"
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}$|^\d{2}[-/]\d{2}[-/]\d{4}$"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Way|Close|Court|Ct|Place|Pl|Terrace|Square|Sq|Crescent|Gardens|Grove|Hill|Park|Walk"
STREETS_FIRST = "Rue|Via|Calle|Avenida|Piazza|Plaza|Strasse|Straat"
ADDRESS = rf"(?<!\d)\d{{1,5}}[A-Za-z]?\s+(?:[A-Z][A-Za-z'\-]+\s+){{0,3}}(?:{STREETS})\b"
ADDRESS_FIRST = rf"(?<!\d)\d{{1,5}}[A-Za-z]?\s+(?:{STREETS_FIRST})\s+[A-Z][A-Za-z'\-]+"
HONORIFICS = "mrs|miss|mr|ms|mx|dr|prof|sir|dame|rev|fr|capt|sgt|lord|lady"
NAME = rf"\b(?i:{HONORIFICS})\.?[ ]+[A-Z][A-Za-z'\-]+(?:[ ]+[A-Z][A-Za-z'\-]+)?"
TOKEN = r"\[[A-Z0-9]+_\d+\]"
MIN_PHONE_DIGITS = 7
PATTERNS = (("EMAIL", EMAIL), ("IBAN", IBAN), ("CARD", CARD), ("SSN", SSN), ("IPV4", IPV4), ("PHONE", PHONE), ("ADDRESS", ADDRESS), ("ADDRESS", ADDRESS_FIRST), ("NAME", NAME))

SPAN = "struct<start:int,stop:int,pii_class:string,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits with a valid check digit."""
    digits = _digits(value)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _kept(pii_class: str, value: Column, allowlist: tuple[str, ...]) -> Column:
    if pii_class == "CARD":
        return luhn(value)
    if pii_class == "IBAN":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)
    if pii_class == "PHONE":
        return (F.length(_digits(value)) >= MIN_PHONE_DIGITS) & ~value.rlike(DATE_LIKE)
    if pii_class == "NAME" and allowlist:
        return ~F.lower(value).isin(*[a.lower() for a in allowlist])
    return F.lit(True)


def matches(text: Column, pattern: str, pii_class: str) -> Column:
    """Spans of all matches of one pattern."""
    pattern = f"(?U){pattern}" if pii_class not in ("EMAIL",) else pattern
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        span = F.struct(begin.alias("start"), (begin + F.length(x["value"])).alias("stop"), F.lit(pii_class).alias("pii_class"), x["value"].alias("value"))
        return F.struct((begin + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.zip_with(F.slice(pieces, 1, F.size(values)), values, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.when(F.size(values) > 0, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(text: Column, allowlist: tuple[str, ...] = NAME_ALLOWLIST, classes: tuple[str, ...] = CLASSES) -> Column:
    """Spans of the classes' detectors on the original text, checks applied, overlaps not yet resolved."""
    def passing(c: str):
        return lambda s: _kept(c, s["value"], allowlist)

    return F.concat(*[F.filter(matches(text, pattern, c), passing(c)) for c, pattern in PATTERNS if c in classes])


def resolve(spans: Column, protected: Column) -> Column:
    """Without spans over placed tokens or each other: class priority, then longer, then earlier ones win; in order of position."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i)])
    keyed = F.transform(spans, lambda s: F.struct(F.element_at(rank, s["pii_class"]).alias("rank"), (s["start"] - s["stop"]).alias("shorter"), s["start"].alias("start"), s["stop"].alias("stop"), s["pii_class"].alias("pii_class"), s["value"].alias("value")))
    clear = F.filter(F.array_sort(keyed), lambda s: ~F.exists(protected, lambda t: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    plain = F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["pii_class"].alias("pii_class"), s["value"].alias("value")))
    taken = F.aggregate(plain, F.array().cast(f"array<{SPAN}>"), lambda acc, s: F.when(F.exists(acc, lambda t: (s["start"] < t["stop"]) & (t["start"] < s["stop"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(taken)


#: What every format needs: a digit, the sign of a mail address or an honorific.
SIGN = rf"[@\p{{Nd}}]|(?i)(?<![\p{{L}}\p{{N}}_])(?:{HONORIFICS})(?![\p{{L}}\p{{N}}_])"


def find_spans(text: Column, allowlist: tuple[str, ...] = NAME_ALLOWLIST, classes: tuple[str, ...] = CLASSES) -> Column:
    """Spans of personal data in one text; null for null."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(SIGN), resolve(candidates(text, allowlist, classes), matches(text, TOKEN, "TOKEN"))).when(text.isNotNull(), none)


def canonical(pii_class: Column, value: Column) -> Column:
    """The form in which two mentions of one value agree."""
    return (
        F.when(pii_class.isin("CARD", "IBAN", "SSN", "PHONE"), F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", "")))
        .when(pii_class == "EMAIL", F.lower(value))
        .otherwise(F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " "))))
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span's ``token`` in its place; ``spans`` (start, stop, token) ordered by position."""
    backwards = F.reverse(spans)
    return F.aggregate(backwards, text, lambda acc, s: F.concat(F.substr(acc, F.lit(1), s["start"]), s["token"], F.substr(acc, s["stop"] + 1, F.length(acc))))


def leaked(text: Column) -> Column:
    """Structural classes that a text still holds."""
    spans = F.filter(find_spans(text, ()), lambda s: s["pii_class"].isin(*STRUCTURAL))
    return F.array_distinct(F.transform(spans, lambda s: s["pii_class"]))
