"""Finding personal data in free text: spans of five classes with their kind of format.

Patterns tolerate other white space, letter case and swapped punctuation, as copies of
messages have them; check digits decide where a format has them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

CLASSES = ("EMAIL", "IDENTITY", "PHONE", "ADDRESS", "NAME")


class Span(NamedTuple):
    start: int
    end: int
    pii_class: str
    kind: str
    value: str


_I = re.IGNORECASE
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŸŹŻŽ"
_DASH = r"\-‐‑‒–"
_AT = r"(?:@|\s*[(\[]\s?at\s?[)\]]\s*)"
_DOT = r"(?:\.|\s*[(\[]\s?dot\s?[)\]]\s*)"
EMAIL = re.compile(rf"(?<![\w.+%'-])\w[\w.%+'-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![\w-])", _I)

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?:\s{1,2}[A-Za-z0-9]{4}){2,7}(?:\s{1,2}[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
CARD = re.compile(rf"(?<![\w+#])\d(?:[\s._{_DASH}]{{0,2}}\d){{12,18}}(?![\w])")
NUMBERED = re.compile(
    rf"(?<![\w{_DASH}.])(?:(?P<ssn>\d{{3}}(?P<s>[\s{_DASH}]+)\d{{2}}(?P=s)\d{{4}}(?![\w{_DASH}]))|(?P<nif>(?:[XYZxyz]-?\d{{7}}|\d{{8}})-?[A-Za-z](?!\w))"
    rf"|(?P<nino>[A-CEGHJ-PR-TW-Za-ceghj-pr-tw-z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-Da-d](?!\w)))"
)
_NO = r"(?:\s+(?:no|nr|number|nummer|núm|numéro|número|n[º°]))?\W{0,3}"
PASSPORT = re.compile(rf"\b(?:passport|passeport|reisepass|pasaporte|passaporte){_NO}([A-Z]{{0,3}}\d{{6,9}}[A-Z]?)(?!\w)", _I)
ID_CARD = re.compile(rf"\b(?:id\s+card|identity\s+card|personalausweis|ausweis|carte\s+d['’]identité|dni|nie|nif|bilhete\s+de\s+identidade){_NO}([A-Z]{{0,3}}\d{{6,10}}[A-Z]?)(?!\w)", _I)
TAX = re.compile(rf"\b(?:steuer-?\s?id|steuernummer|idnr|tax\s+(?:id|number)|tin|nino|numéro\s+fiscal|número\s+fiscal){_NO}(\d(?:[\s/{_DASH}]{{0,2}}\d){{7,12}})(?!\w)", _I)

_GAP = rf"[\s.{_DASH}/()]{{0,3}}"
_FREE = rf"(?<![\w+#/.{_DASH}])"
_FREE_PLUS = r"(?<![\w+#])"
PHONE = re.compile(
    rf"{_FREE_PLUS}\+\d(?:{_GAP}\d){{7,14}}(?!\d)"
    rf"|{_FREE_PLUS}\(\d{{2,5}}\)[\s.{_DASH}]{{0,2}}\d{{2,4}}(?:[\s.{_DASH}]{{1,2}}\d{{2,4}}){{1,3}}(?!\d)"
    rf"|{_FREE}(?:00[1-9]\d?(?:{_GAP}\d){{7,13}}(?!\d)"
    rf"|\d{{3}}(?P<p>[.{_DASH}])\d{{3}}(?P=p)\d{{4}}(?![\d{_DASH}])"
    rf"|0\d(?:[\s.{_DASH}]{{1,2}}\d{{2}}){{4}}(?!\d)"
    rf"|(?P<short>0\d{{1,4}}[\s/{_DASH}]{{1,2}}\d{{3,8}}(?:[\s{_DASH}]{{1,2}}\d{{2,4}}){{0,3}}(?!\d)))"
)

# Words for kinds of streets.
_KIND_AFTER = "street|st|road|rd|avenue|ave|lane|ln|row|close|drive|court|way|place|square|terrace|crescent|gardens|grove|hill|walk|boulevard|blvd|mews|parade"
_KIND_BEFORE_FR = "rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route"
_KIND_BEFORE_ES = "calle|avenida|avda|plaza|paseo|camino|carrer|rua|travessa|largo|praça|via|viale|piazza"
_KIND_JOINED = "straße|strasse|str|stieg|weg|gasse|platz|allee|ufer|damm|ring|chaussee"
_WORD = rf"[{_UP}][\w'’.-]*"
_NUM = r"\d{1,5}\s?[A-Za-z]?"
_FLAT = r"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite)\s+\w{1,4}\W{0,2}\s*)?"
ADDRESSES = (
    re.compile(rf"(?<![\w#/.{_DASH}])(?i:{_FLAT})\d{{1,5}}[A-Za-z]?\s+(?:{_WORD}\s+){{1,3}}(?i:{_KIND_AFTER})\b\.?"),
    re.compile(rf"(?<![\w#/.{_DASH}]){_NUM}\s+(?:bis\s+|ter\s+)?(?:{_KIND_BEFORE_FR})\s+(?:(?:de|du|des|la|le|les)\s+|[dl]['’]\s*)*[\w'’-]+", _I),
    re.compile(rf"(?<![\w-])[^\W\d_]{{3,}}(?:{_KIND_JOINED})\.?\s+\d{{1,4}}(?:\s?[a-z](?!\w))?(?![\w.,{_DASH}]*\d{{3}}\b|\s*(?:minut|stunden|tage|uhr|mal|eur|kg))", _I),
    re.compile(rf"(?<![\w-])(?:{_KIND_BEFORE_ES})\.?\s+(?:(?:de|del|la|las|los|el|da|do|dos|das)\s+)*[\w'’-]+(?:\s+[^\W\d_][\w'’-]*)?\W{{0,2}}\s*\d{{1,4}}(?:\W{{0,2}}\s*\d{{1,2}}\s?[º°ª]\s?\w?)?", _I),
)
#: Number and kind of street in texts written without capitals.
ADDRESS_LOWER = re.compile(rf"(?<![\w#/.{_DASH}])(?:(?:flat|apartment|apt|unit|suite)\s+\w{{1,4}}\W{{0,2}}\s*)?\d{{1,5}}[a-z]?\s+(?:(?!the|a|an|of|on|in|and|to|my|for|minutes|hours|days|eur|kg|x\b)[^\W\d_]+\s+){{1,3}}(?:{_KIND_AFTER})\b")

#: Postcode and town behind the street.
_TOWN = re.compile(rf"\s*,\s*(?:\d{{4,5}}\s+)?[{_UP}][\w'’]+(?:[\s-](?:(?:am|an|auf|der|im|sur|de|del)\s+)?[{_UP}][^\W\d_]+(?![\w]))?(?:\s+[A-Z]{{1,2}}\d\w?\s+\d[A-Z]{{2}})?")

_TITLES = r"(?:mr|mrs|ms|miss|mx|dr|prof|professor|herr|frau|mme|mlle|monsieur|madame|sr|sra|srta|señor|señora|senhor|senhora|dott)"
_TITLE = rf"{_TITLES}\b[.!;…—-]*\s+"
_PART = rf"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_])|[{_DASH}](?=[^\W\d_]))*"
_INITIAL = r"[^\W\d_][.!;…]"
_PARTICLES = r"(?:(?:van|von|de|del|della|der|den|di|da|dos|la|le|zu|ten|ter)\s+)*"
#: A name in any letter case, its validity is judged by its words.
_NAME = rf"(?:{_TITLE})?(?:{_PARTICLES}{_PART}\s*,\s*{_PART}|(?:{_INITIAL}\s+)+{_PARTICLES}{_PART}|{_PART}(?:\s+{_INITIAL})?\s+{_PARTICLES}{_PART}|{_PART})"
# Phrases before and after which a person is named.
NAMED_AFTER = (
    "this is|spoke to|spoke with|talked to|talked with|speak to|speak with|talk to|talk with|signed for by|ask for|my colleague|my wife|my husband|my boss|my name is|passed this to|regards|sincerely|thanks in advance|for customer|owner"
    "|habe mit|grüßen|grüße|grüssen|grüsse|mein name ist|ich heiße|ich heisse|mein kollege|meine kollegin"
    "|cordialement|parlé avec|parlé à|je m'appelle|mon collègue|ma collègue"
    "|saludos|atentamente|hablé con|me llamo|mi colega"
    "|cumprimentos|atenciosamente|falei com|chamo-me|meu nome é|o meu colega|a minha colega"
).split("|")
# Roles and phrases after which two capitalised words are a person.
ROLES = (
    "technician|engineer|agent|driver|customer|client|manager|director|supervisor|doctor|nurse|lawyer|tenant|landlord|neighbour|colleague|assistant|employee|recipient|contact|signed by|written by|sent by|dear|hello|hi|attention|attn|cc|met|met with|forward it to|belongs to|on behalf of"
    "|techniker|technikerin|fahrer|fahrerin|kunde|kundin|leiter|leiterin|arzt|nachbar|nachbarin|kollege|kollegin|mitarbeiter|ansprechpartner|unterschrieben von|liebe|lieber|hallo|gestern mit|heute mit|treffe"
    "|technicien|technicienne|chauffeur|client|cliente|directeur|directrice|voisin|voisine|collègue|signé par|cher|chère|contactez|rencontré"
    "|técnico|técnica|conductor|cliente|director|directora|vecino|vecina|compañero|firmado por|querido|querida|estimado|estimada|contacte con|contacte a"
    "|motorista|diretor|diretora|vizinho|vizinha|colega|assinado por|caro|cara|contacte"
    "|tecnico|autista|collega|direttore|firmato da|gentile"
    "|звонил|звонила|мастер|водитель|клиент|директор|сосед|соседка|коллега|врач|господин|госпожа|уважаемый|уважаемая|подписал|подписала|позвоните"
).split("|")
# Frequent given names; a capitalised word behind one makes a name. Russian ones may be declined.
GIVEN = (
    "adam alan alejandro alessandro alex alexander alexandra alice alicia amanda amy ana anders andrea andreas andrew angela anita anja ann anna anne annette antonio astrid barbara beatriz ben benjamin bernd birgit brian bruno carla carlos carmen carolina caroline catherine charles charlotte chiara chris christian christina christine claire claudia claus"
    " daniel daniela david deborah diana diego dieter dirk dmitri elena elisabeth elizabeth ella emily emma eric erik eva fabian felix fernando filipe florian francesca francesco francisco frank franz fatima gabriel george giovanni giulia giuseppe guillaume hanna hannah hans heike heinz helen helena helga henri igor ines ingrid isabel ivan jack jakob james jan jane"
    " jean jennifer jens jessica joana joao joão johan john jonas jorge jose josé juan julia julie jürgen karen karin karl katarina kate katharina kevin klaus lars laura lena lisa luca lucas luigi luis luisa manuel marco maria maría marie mario markus marta martin martina mary matthew michael miguel monika natalia nicolas nina olga oliver olivia oscar pablo patricia paul paula pedro peter petra"
    " philippe pierre rachel rafael ralf ricardo richard robert rosa sabine samuel sandra sara sarah sebastian silvia simon sofia sophie stefan stephen susan svetlana thomas tom tomasz ursula valentina vera victor vladimir werner wolfgang yusuf"
).split()
GIVEN_CYRILLIC = "алекс андре анатоли анн анастаси артём борис вадим валенти вер виктор владимир галин григори дарь денис дмитри евгени екатерин елен иван игор ирин кирилл ксени ларис людмил максим мари михаил надежд наталь никола никит олег ольг павел павл пётр петр роман светлан серге софь степан татьян фёдор юли юри".split()



def trie(phrases: list[str], blank: str) -> str:
    """A pattern of all phrases that compares each letter once."""
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [(blank if c == " " else re.escape(c)) + write(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in node else body

    return write(tree)


def sign_trie(signs: dict[str, str], blank: str) -> str:
    """A pattern that finds any sign with what must follow it; beyond a sign that nothing need follow it doesn't look."""
    tree: dict = {}
    for sign, tail in signs.items():
        node = tree
        for c in sign:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(tail)

    def write(node: dict) -> str:
        tails = node.get("", [])
        if "" in tails:
            return ""
        parts = [(blank if c == " " else re.escape(c)) + write(child) for c, child in sorted((c, n) for c, n in node.items() if c)]
        parts += tails
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return write(tree)


BEFORE = re.compile(rf"(?<!\w){trie(NAMED_AFTER, r'\s+')}(?!\w)")
_SKIP = re.compile(rf"\s*[,;:!.…{_DASH}—]*\s*")
NAME = re.compile(_NAME, _I)
#: A person of a part of a company.
_BELONGING = r"from\s+(?:the|our|your)\s+(?:\w+\s+){0,2}(?:desk|team|office|department|branch|company|shop)"
AFTER = re.compile(rf"(?:^|[.!?;:…\n\"“«>)—]|\s-)\s*({_NAME})\s+{_BELONGING}(?!\w)", _I)
_CAPITAL = rf"(?:[{_UP}][^\W\d_]*|[А-ЯЁ][а-яё]+)(?:['’\-][{_UP}]?[^\W\d_]+)*"
#: What stands between a given name and a family name.
_JOINED = r"(?:van|von|de|del|della|di|da|dos|ten|ter)(?:\s+(?:der|den|la|las|los))?\s+"
#: Two capitalised words or more, perhaps with an initial and particles between.
FULL = re.compile(rf"{_CAPITAL}(?:\s+[{_UP}А-ЯЁ]\.)?\s+(?:{_JOINED})?{_CAPITAL}(?:\s+{_CAPITAL})?")
_SMALL_WORD = re.compile(r"(?<![^\W_])[a-zß-öø-ÿа-яё][^\W\d_]{2,}")
GIVEN_FIRST = re.compile(rf"(?<![\w@./-])(?:{trie(GIVEN, ' ')}(?:-[^\W\d_]+)?|{trie(GIVEN_CYRILLIC, ' ')}[а-яё]{{0,3}})(?=\s)")
ROLE = re.compile(rf"(?<!\w){trie(ROLES, r'\s+')}(?:\s*[,:])?\s+(?=[^\W\d_])")
_TITLE_STEMS = ("mr", "ms", "miss", "mx", "dr", "prof", "herr", "frau", "mme", "mlle", "monsieur", "madame", "sr", "señor", "senhor", "dott")
TITLED = re.compile(rf"(?<![\w-])(?i:(?:{_TITLE})+)(?:{_PARTICLES}|[Vv]an\s+|[Vv]on\s+)*(?:[{_UP}][.!]\s+)?[{_UP}][\w'’-]*(?:\s+(?:[{_UP}][.!]\s+)?{_PARTICLES}[{_UP}][\w'’-]+)?")
TITLED_LOWER = re.compile(rf"(?<![\w-])(?<!\d\s)(?:mr|mrs|ms|herr|frau|mme|sra|prof|dr)\b[.!]?\s+({_PARTICLES}{_PART}(?:\s+{_PARTICLES}{_PART})?)")
_TITLE_ONLY = re.compile(rf"^{_TITLE}", _I)
_INITIALS = re.compile(rf"(?<!\w){_INITIAL}(?!\w)")
_WRITING = re.compile(r"\s+writing\b", _I)
#: Words that begin no name.
NO_NAME = frozenset(
    "the a an and or but to of for with from by in on at is are was were be been not no yes you your yours our we us they them he she it its i me my this that these those here there who what how why when where which please thanks thank"
    " team desk billing device parcel night returns onboarding support customer service colleague manager refund help someone somebody anyone everyone nobody order case ticket today tomorrow yesterday fine good sorry regards all"
    " has have had will would can could do does did say says said report reports"
    " account card number phone mobile tel contact link call text send write write reference see serial invoice firmware job batch bought width"
    " der die das den dem ein eine einer und oder ich sie wir ihr ihnen ihre mein meine nicht bitte mit von zu im am vorgang auftrag es"
    " le la les un une des du de et ou je vous nous il elle mon ma mes ne pas pour sur dossier"
    " el los las una y o yo usted mi su no por para con en caso pedido lo"
    " o os as um uma e eu você meu minha não por para com em processo".split()
)
_SMALL = frozenset("van von de del della der den di da dos la le zu ten ter".split())
PLACEHOLDER = re.compile(r"\[[A-Z]{2,12}_(?:\d+|[0-9a-f]{24})\]")
#: Cheap signs, tested in the JVM on lower-cased texts (white space is spelled out), that a text may hold any of the above.
#: They must miss nothing that the patterns find. Each begins with what rules out most positions at once.
_BLANKS = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
_SP = f"[{_BLANKS}]"
_LINE = r"\x{2010}-\x{2013}-"
_TITLE_WORDS = re.sub(r"[(?:)]", "", _TITLES).split("|")
_LABELS = "passport|passeport|pasaporte|passaporte|reisepass|id card|identity card|personalausweis|ausweis|carte d|dni|nie|nif|tin|nino|bilhete|steuer|idnr|tax id|tax n|numéro fiscal|número fiscal".split("|")
#: Letters that the patterns take for i and s, and digits of other scripts.
_OTHER_FORMS = r"[\x{17f}\x{131}\x{307}[\p{Nd}&&[^0-9]]]"
SUSPECT_FORMS = rf"(?![\x00-\x7f])(?:(?![“”‘’–—…])(?:{_OTHER_FORMS})|(?=[а-яё])(?<![а-яё]){trie(GIVEN_CYRILLIC, ' ')})"
#: Spelled-out signs of an e-mail address, looked for where one of their ends stands.
SUSPECT_AT = rf"[(\[]{_SP}?at{_SP}?[)\]]"
_SIGNS = dict.fromkeys([*NAMED_AFTER, *_LABELS, *[k + end for k in _KIND_BEFORE_ES.split("|") for end in (" ", ". ")]], "")
_SIGNS |= dict.fromkeys(_TITLE_WORDS, "(?![a-z0-9_])") | dict.fromkeys(GIVEN, rf"(?:-[^{_BLANKS}]+)?{_SP}")
_SIGNS |= dict.fromkeys(("from the ", "from our ", "from your "), rf"(?:[^{_BLANKS}]+{_SP}+){{0,2}}(?:desk|team|office|department|branch|company|shop)")
_SIGNS |= dict.fromkeys(("flat", "apartment", "apt", "apt.", "unit", "suite"), rf"{_SP}+[\p{{L}}\p{{N}}_]{{1,4}}\d{{1,5}}[a-z]?{_SP}")
_NUMBER_SIGNS = (
    rf"(?=[+(xyz\d])(?:\+\d|\(\d{{2,5}}\)|[xyz]-?\d{{7}}-?[a-z](?![a-z0-9_])|(?=\d)(?:(?<![/#.+-])(?:00[1-9][\d{_BLANKS}./(){_LINE}]|0\d{{1,4}}[{_BLANKS}./{_LINE}])"
    rf"|(?<![.-])\d{{3}}[{_BLANKS}.{_LINE}]+\d{{2,3}}[{_BLANKS}.{_LINE}]+\d{{4}}(?!\d)|(?<![+#])\d(?:[{_BLANKS}._{_LINE}]{{0,2}}\d){{12,18}}(?![a-z0-9_])"
    rf"|\d{{8}}-?[a-z](?![a-z0-9_])|(?<=(?:{_KIND_JOINED})\.?{_SP}{{1,3}})\d|(?<={_SP}{{4}})\d"
    rf"|\d{{1,5}}(?:{_SP}?[a-z])?{_SP}+(?:(?:(?:bis|ter){_SP}+)?(?:{_KIND_BEFORE_FR})(?![a-z0-9_])|(?:[^\s\d][^{_BLANKS}]*{_SP}+){{1,3}}(?:{_KIND_AFTER})(?![a-z0-9_]))))"
)
#: All signs that begin where a word or a number does, in one pass.
SUSPECT_SIGNS = (
    rf"(?<![a-z0-9])(?:(?<!_)(?:{sign_trie(_SIGNS, _SP + '+')}|{_NUMBER_SIGNS})"
    rf"|(?=[a-z]{{2}}{_SP}?\d)(?:[a-z]{{2}}\d{{2}}(?:[a-z0-9]{{11}}|{_SP}{{1,2}}[a-z0-9]{{4}}{_SP})|(?<!_)[a-z]{{2}}{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?\d{{2}}{_SP}?[a-d](?![a-z0-9])))"
)
#: On texts as they are: two capitalised words behind a small letter, a comma or a colon.
SUSPECT_CAPITALS = rf"(?![!-~]){_SP}(?<=[\p{{Ll}},:]{_SP}){_SP}*+\p{{Lu}}[\p{{L}}'’-]*+{_SP}++(?:\p{{Lu}}\.{_SP}++)?(?:{_JOINED.replace(chr(92) + 's', _SP)})?\p{{Lu}}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    moved = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def nif_ok(code: str) -> bool:
    code = code.upper().replace("-", "")
    number = code[:-1].translate(str.maketrans("XYZ", "012"))
    return number.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == code[-1]


_LABEL_STEMS = ("passp", "passe", "pasap", "passa", "reisep", "card", "ausweis", "identi", "dni", "nie", "nif", "steuer", "idnr", "tax", "tin", "nino", "fiscal", "bilhete")


def _identity(text: str, lower: str) -> list[Span]:
    out = []
    for m in IBAN.finditer(text):
        end = m.end()
        while end > m.start() + 14:
            code = re.sub(r"\W", "", text[m.start() : end]).upper()
            if iban_ok(code):
                out.append(Span(m.start(), end, "IDENTITY", "iban", text[m.start() : end]))
                break
            cut = max(text.rfind(x, m.start(), end) for x in (" ", "\n", "\t", " "))
            end = len(text[m.start() : cut].rstrip()) + m.start() if cut > 0 else 0
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(Span(m.start(), m.end(), "IDENTITY", "card", m.group()))
    for m in NUMBERED.finditer(text):
        if m.lastgroup != "nif" or nif_ok(m.group()):
            out.append(Span(m.start(), m.end(), "IDENTITY", "ssn" if m["ssn"] else m.lastgroup, m.group()))
    if any(stem in lower for stem in _LABEL_STEMS):
        for kind, pattern in (("passport", PASSPORT), ("id_card", ID_CARD), ("tax", TAX)):
            out += [Span(m.start(1), m.end(1), "IDENTITY", kind, m.group(1)) for m in pattern.finditer(text)]
    return out


def _phones(text: str) -> list[Span]:
    out = []
    for m in PHONE.finditer(text):
        count = sum(map(str.isdigit, m.group()))
        if (9 if m["short"] else 8) <= count <= 15:
            out.append(Span(m.start(), m.end(), "PHONE", "phone", m.group()))
    return out


#: What each address pattern needs to be there.
_STREET_STEMS = (
    tuple(_KIND_AFTER.split("|")),
    tuple(_KIND_BEFORE_FR.split("|")),
    ("str", "stieg", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "chaus"),
    tuple(_KIND_BEFORE_ES.split("|")),
)


def _addresses(text: str, lower: str) -> list[Span]:
    patterns = [p for p, stems in zip(ADDRESSES, _STREET_STEMS) if any(s in lower for s in stems)]
    if text == lower:
        patterns.append(ADDRESS_LOWER)
    out = []
    for m in (m for p in patterns for m in p.finditer(text)):
        end = m.end()
        if tail := _TOWN.match(text, end):
            end = _trimmed(text, end, tail.end())
        out.append(Span(m.start(), end, "ADDRESS", "address", text[m.start() : end]))
    return out


def _name_like(value: str, capitals: bool) -> bool:
    """Whether a name's words can be one: none is a function word, and in mixed case they begin with capitals."""
    bare = _INITIALS.sub(" ", _TITLE_ONLY.sub("", value))
    words = re.findall(_PART, bare)
    if not words or words[0].lower() in NO_NAME or words[-1].lower() in NO_NAME:
        return False
    strong = [w for w in words if w.lower() not in _SMALL]
    if not strong:
        return False
    return not capitals or all(w[0].isupper() for w in strong)


def _trimmed(text: str, start: int, end: int) -> int:
    """End of the name without a following function word that the pattern took along."""
    value = text[start:end]
    words = list(re.finditer(_PART, value))
    while len(words) > 1 and words[-1].group().lower() in NO_NAME:
        words.pop()
        end = start + words[-1].end()
    return end


def _names(text: str, lower: str, allowed: tuple[str, ...]) -> list[Span]:
    out = []
    for cue in BEFORE.finditer(lower):
        m = NAME.match(text, _SKIP.match(text, cue.end()).end())
        if not m:
            continue
        start, end = m.start(), _trimmed(text, *m.span())
        value = text[start:end]
        words = re.findall(_PART, _INITIALS.sub(" ", _TITLE_ONLY.sub("", value)))
        if not words or not _name_like(value, False):
            continue
        titled, upper = bool(_TITLE_ONLY.match(value) or _INITIALS.search(value)), words[0][:1].isupper()
        if not upper and not titled and (len(words) < 2 or (cue.group().startswith("this") and not _WRITING.match(text, end))):
            continue  # a word without capital is a name only beside another, and "this is" needs more
        if upper and len(words) == 2 and "," not in value and words[1][0].islower() and words[0].lower() not in _SMALL:
            end = start + re.search(_PART, value).end()  # the second word goes on with the sentence
        out.append(Span(start, end, "NAME", "name", text[start:end]))
    if " from " in lower:
        for m in AFTER.finditer(text):
            if _name_like(m.group(1), False):
                out.append(Span(m.start(1), m.end(1), "NAME", "name", m.group(1)))
    titles = any(t in lower for t in _TITLE_STEMS)
    if titles:
        out += [Span(m.start(), m.end(), "NAME", "name", m.group()) for m in TITLED.finditer(text) if _name_like(m.group(), False)]
    if titles and text == lower:
        out += [Span(m.start(), m.end(), "NAME", "name", m.group()) for m in TITLED_LOWER.finditer(text) if _name_like(m.group(), False)]
    if not text.isupper():
        starts = [m.start() for m in GIVEN_FIRST.finditer(lower)]
        if _SMALL_WORD.search(text):  # not in texts in which every word is capitalised
            starts += [m.end() for m in ROLE.finditer(lower)]
        for at in starts:
            if text[at].isupper() and (m := FULL.match(text, at)):
                end = _trimmed(text, at, m.end())
                if _name_like(text[at:end], True) and len(re.findall(_PART, text[at:end])) > 1:
                    out.append(Span(at, end, "NAME", "name", text[at:end]))
    return [s for s in out if not is_allowed(text, s.start, allowed)]


def is_allowed(text: str, start: int, allowed: tuple[str, ...]) -> bool:
    """Whether an allow-listed phrase begins here, in any letter case and spacing."""
    for phrase in allowed:
        here = " ".join(text[start : start + 3 * len(phrase)].lower().split())
        if here.startswith(phrase) and not here[len(phrase) : len(phrase) + 1].isalnum():
            return True
    return False


def find(text: str, allowed: tuple[str, ...] = ()) -> list[Span]:
    """Spans in order, none overlapping another: classes come in the order of ``CLASSES``, longer ones first; placeholders stay."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text  # offsets must agree
    found = _identity(text, lower) + _phones(text) + _addresses(text, lower) + _names(text, lower, allowed)
    if "@" in text or "at)" in lower or "at]" in lower:
        found += [Span(m.start(), m.end(), "EMAIL", "email", m.group()) for m in EMAIL.finditer(text)]
    if not found:
        return []
    taken = [m.span() for m in PLACEHOLDER.finditer(text)] if "[" in text else []
    out = []
    for s in sorted(found, key=lambda s: (CLASSES.index(s.pii_class), s.start - s.end, s.start)):
        if all(s.end <= a or b <= s.start for a, b in taken):
            taken.append((s.start, s.end))
            out.append(s)
    return sorted(out)
