"""Keyed replacements for detected values that keep type, gender, script and format.

A value's canonical form, class and the secret key fix its replacement, so one
entity has one replacement everywhere. Names are replaced part by part: a family
name has the same replacement beside different first names and titles.
"""

from __future__ import annotations

import hashlib
import hmac
import re

from gleanstone.llm.detect import _INITIALS, _PART, _SMALL, _TITLE_ONLY, Span

# Pieces that made-up names consist of.
_ONSETS = "b br c d dr f g gr h k l m n p r s st t th v w".split()
_VOWELS = "a e i o u ai ea".split()
_CODAS = "l n r s nd rt ll th m x".split()
_ENDINGS = {"f": ("a", "ia", "ine", "elle"), "m": ("o", "us", "an", "ric"), "": ("en", "is", "el", "y")}
_FAMILY = ("son", "field", "wick", "mann", "er", "ey", "dale", "ström")
_CYRILLIC = str.maketrans("abcdefghiklmnoprstuvwxyz", "абцдефгхиклмнопрстуввхыз")
_FEMALE = re.compile(r"^(?:mrs|ms|miss|frau|mme|mlle|madame|sra|srta|señora|senhora)\b", re.IGNORECASE)
_MALE = re.compile(r"^(?:mr|herr|monsieur|sr|señor|senhor)\b", re.IGNORECASE)


def _stream(key: str, *parts: str):
    """Endless numbers fixed by the key and the parts."""
    seed, counter = "\x1f".join(parts).encode(), 0
    while True:
        block = hmac.new(key.encode(), seed + counter.to_bytes(4, "big"), hashlib.sha256).digest()
        yield from block
        counter += 1


def canonical(span: Span) -> str:
    """The form in which all mentions of one entity agree."""
    value = span.value
    if span.pii_class == "EMAIL":
        value = re.sub(r"\s*[(\[]\s?at\s?[)\]]\s*", "@", value.lower())
        return re.sub(r"\s*[(\[]\s?dot\s?[)\]]\s*", ".", value)
    if span.pii_class == "PHONE":
        digits = re.sub(r"\D", "", value)
        return "+" + digits if value.lstrip().startswith("+") else "+" + digits[2:] if digits.startswith("00") else digits
    if span.pii_class == "IDENTITY":
        return re.sub(r"[\W_]", "", value).upper()
    if span.pii_class == "NAME":
        value = " ".join(_TITLE_ONLY.sub("", value).lower().split())
        if "," in value:
            value = " ".join(reversed([x.strip() for x in value.split(",", 1)]))
        return value
    return " ".join(re.sub(r"[^\w ]", " ", value.lower()).split())


def gender(value: str) -> str:
    if _FEMALE.match(value):
        return "f"
    if _MALE.match(value):
        return "m"
    first = re.sub(r"[\W\d_]", "", value.split(",")[-1].split()[0].lower()) if value.split() else ""
    return "f" if first.endswith(("a", "ia", "ine")) else ""


def _shape_letters(made: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return made.upper()
    return made.capitalize() if like[:1].isupper() else made.lower()


def _made(key: str, word: str, family: bool, sex: str, attempt: int) -> str:
    draw = _stream(key, "family" if family else "first", word.lower(), str(attempt))
    pick = lambda items: items[next(draw) % len(items)]
    made = pick(_ONSETS) + pick(_VOWELS) + pick(_CODAS)
    made += (pick(_VOWELS) + pick(_ONSETS[:9]) + pick(_FAMILY)) if family else (pick(_VOWELS) + pick("lnrst") + pick(_ENDINGS[sex]))
    return made.translate(_CYRILLIC) if re.search(r"[а-яё]", word.lower()) else made


def _name(span: Span, key: str, attempt: int, sex: str | None) -> str:
    title = m.group() if (m := _TITLE_ONLY.match(span.value)) else ""
    bare = span.value[len(title) :]
    sex = gender(span.value) if sex is None else sex
    initials = {m.start() for m in _INITIALS.finditer(bare)}
    words = [m for m in re.finditer(_PART, bare) if m.group().lower() not in _SMALL]
    turned = "," in bare
    out, at = [], 0
    for i, m in enumerate(words):
        family = (i == 0 if turned else i == len(words) - 1) if len(words) > 1 else True
        made = _made(key, m.group(), family, sex, attempt)
        out += [bare[at : m.start()], made[:1].upper() if m.start() in initials else _shape_letters(made, m.group())]
        at = m.end()
    return title + "".join(out) + bare[at:]


def _digits(value: str, draw, keep: int) -> str:
    """Other digits after the first ``keep``; letters and marks stay."""
    seen, out = 0, []
    for c in value:
        if c.isdigit():
            out.append(c if seen < keep else str(next(draw) % 10))
            seen += 1
        else:
            out.append(c)
    return "".join(out)


def _refill(shape: str, characters: str) -> str:
    """``shape`` with its letters and digits replaced one by one."""
    fresh = iter(characters)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


def _luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _identity(span: Span, key: str, attempt: int) -> str:
    code = re.sub(r"[\W_]", "", span.value).upper()
    draw = _stream(key, "identity", code, str(attempt))
    digit = lambda: str(next(draw) % 10)
    if span.kind == "card":
        body = code[:4] + "".join(digit() for _ in code[5:])
        return _refill(span.value, body + _luhn_digit(body))
    if span.kind == "iban":
        body = "".join(digit() if c.isdigit() else c for c in code[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + code[:2] + "00")) % 97
        return _refill(span.value, f"{code[:2]}{check:02d}{body}")
    if span.kind == "nif" and code[0].isdigit():
        number = "".join(digit() for _ in code[:-1])
        return _refill(span.value, number + "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23])
    return "".join(digit() if c.isdigit() else chr(65 + next(draw) % 26) if c.isupper() else chr(97 + next(draw) % 26) if c.islower() else c for c in span.value)


def replacement(span: Span, key: str, attempt: int = 0, sex: str | None = None) -> str:
    """A value of the same type and format; another ``attempt`` gives another one.

    With the entity's ``sex`` given, all mentions of one entity get one surrogate, but for title, letter case and format.
    """
    if span.pii_class == "NAME":
        return _name(span, key, attempt, sex)
    if span.pii_class == "IDENTITY":
        return _identity(span, key, attempt)
    form = canonical(span)
    draw = _stream(key, span.pii_class, form, str(attempt))
    if span.pii_class == "PHONE":
        return _digits(span.value, draw, 5 if span.value.lstrip().startswith("00") else 3 if span.value.lstrip().startswith("+") else 2)
    if span.pii_class == "EMAIL":
        local = re.split(r"@|\s*[(\[]\s?at", span.value, maxsplit=1, flags=re.IGNORECASE)[0]
        fresh = re.sub(r"[^\W\d_]+", lambda m: _shape_letters(_made(key, form + m.group(), False, "", attempt)[:8], m.group()), local)
        fresh = _digits(fresh, draw, 0) + format(next(draw) * 256 + next(draw), "04x")
        domain = span.value[len(local) :]
        return fresh + re.sub(r"[a-z0-9]+(?=(?:\.|\s*[(\[]\s?dot\s?[)\]]\s*)[a-z]{2,}$)", "masked", domain, flags=re.IGNORECASE)
    # Addresses: another number and another name of the street, its kind and order stay.
    kinds = {"street", "st", "road", "rd", "avenue", "ave", "lane", "row", "close", "drive", "court", "way", "place", "square", "rue", "bis", "ter", "calle", "avenida", "plaza", "del", "de", "des", "du", "la", "flat", "am", "wehr"}
    words = re.sub(r"[^\W\d_]{3,}", lambda m: m.group() if m.group().lower() in kinds else _street(m.group(), key, attempt), span.value)
    return _digits(words, draw, 0)


def _street(word: str, key: str, attempt: int) -> str:
    kind = re.search(r"(?:straße|strasse|stieg|weg|gasse|platz|allee)$", word, re.IGNORECASE)
    stem = word[: kind.start()] if kind else word
    return _shape_letters(_made(key, stem, True, "", attempt), stem or word) + (kind.group() if kind else "")
