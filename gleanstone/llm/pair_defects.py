"""Broken prompt and response pairs: which response is no proper answer, and why.

A linear-chain conditional random field tags the clauses of a response as
answer, refusal, echo, foreign or unfinished. It is trained here, on the driver,
on sequences composed from frames by fixed rules (their number is
``TRAINING_SEQUENCES``, whatever the data); weights of a few thousand features are
broadcast. Responses are tagged where they lie, in Arrow batches, and the share
of a response's letters under each tag gives the pair's defect.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanstone.llm.crf import ChainCRF
from gleanstone.llm.languages import CODES, asked_for, language
from gleanstone.llm.pair_training import ANSWERS, COURTESIES, QUESTIONS, REFUSALS, SHORT_ANSWERS, SIGN_OFFS, drawn

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
TRAINING_SEQUENCES = 6000
CACHE_CLAUSES = 200_000
#: What a clause without any known word lacks for being a refusal, in log-odds.
UNKNOWN = 4.0
#: Share of the question's word pairs that an echo holds at least.
HELD_BACK = 0.5
DEFECTS = ("empty", "truncated", "refusal", "echo", "wrong_language")

#: Words that frame a repeated question.
FRAMES = ("Question:", "Your message was:", "You asked:", "You wrote:", "Answer:", "Frage:", "Antwort:", "Votre question :", "Su pregunta:")
# Spellings of "there is no answer", without marks.
NOTHING = {"", "na", "n a", "none", "null", "nil", "nan", "empty", "no answer", "no response", "no output", "no reply", "no content", "undefined", "blank"}
#: Words after which no sentence ends.
OPEN_ENDS = frozenset("the a an and or but of to for with in on at by from is are was were will be that which who der die das den dem ein eine und oder aber mit für von zu zum zur ist sind le la les un une des et ou mais de du avec pour est el los las y o pero del con por os as e em um uma da do".split())
LIMIT_ERROR = re.compile(r"length|token limit|max(?:imum)?[_ ](?:output|tokens?|length)|output limit|truncat", re.IGNORECASE)
CUT_MARK = re.compile(r"(?:\[[^\]]*(?:truncated|cut|limit|continue)[^\]]*\]|<\|[^|]*\|>|\((?:truncated|cut off)\))\W*$", re.IGNORECASE)
_SPLIT = re.compile(r"(?<=[.!?…。])[\"”»')\]]*\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W_]+")
_LEXICAL = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_DIGITS = re.compile(r"\d+")
_NUMBERED = re.compile(r"^[ \t]*(?:\d{1,3}[.)]|[-*•])[ \t]+", re.MULTILINE)


_FRAME = re.compile("^(" + "|".join(map(re.escape, FRAMES)) + ")[ \t]+", re.MULTILINE)


def split_clauses(text: str) -> list[str]:
    """Sentences and lines, without the numbers and bullets of lists; words that frame a quotation stand alone."""
    return [c for c in _SPLIT.split(_FRAME.sub(r"\1\n", _NUMBERED.sub("", text))) if c and _WORD.search(c)]


def is_nothing(text: str | None) -> bool:
    """No content: null, blank, marks only or a word for nothing."""
    if text is None or len(text) > 60:
        return text is None or not _WORD.search(text)
    return " ".join(_WORD.findall(text.lower())) in NOTHING


class Clause:
    """What a clause says by itself, whatever its numbers; kept between records."""

    __slots__ = ("code", "ending", "features", "length", "pairs", "probes", "score", "size")

    def __init__(self, text: str) -> None:
        words = [w.lower().replace("’", "'") for w in _LEXICAL.findall(text)]
        tokens = _tokens(text)
        self.length = sum(map(len, tokens))
        # Numbers alone and one word alone repeat nothing, even if the question has them.
        self.pairs = frozenset(zip(tokens, tokens[1:])) if any(t.isalpha() for t in tokens) else frozenset()
        self.code = language(text)
        #: A question without any of these doesn't hold the clause.
        self.probes = tuple({t for t in tokens if len(t) >= 4} or set(tokens))
        end = text.rstrip().rstrip("\"”»')]}* ")
        if CUT_MARK.search(text):
            self.ending = "mark"
        elif end.endswith(("...", "…")):
            self.ending = "dots"
        elif end.endswith((".", "!", "?", "。", "！", "？", "।", "؟")):
            self.ending = "stop"
        elif end.endswith((":", ",", ";", "-")):
            self.ending = "open"
        else:
            self.ending = "open" if words and words[-1] in OPEN_ENDS else "word"
        n = len(words)
        self.size = "short" if n <= 3 else "medium" if n <= 7 else "long"
        self.features = [f"w:{w}" for w in words] + [f"p:{a} {b}" for a, b in zip(words, words[1:])]
        self.features += [self.size]
        if any(text.lstrip("> ").startswith(f) for f in FRAMES):
            self.features.append("frame")
        self.score = None


def context_features(overlap: int, foreign: bool | None, whole: bool, last: bool, ending: str, before: str, size: str, limited: bool, broken: bool) -> list[str]:
    out = [f"echo:{overlap}", f"foreign:{foreign}", "whole" if whole else "part"]
    if last:
        out += [f"end:{ending}:{before}", f"end:{ending}:{size}:{whole}"]
        if ending in ("mark", "open"):
            out.append(f"end:{ending}")
        if limited:
            out.append("limited")
        if broken:
            out.append("broken")
    elif ending == "word":
        out.append("inner:word")
    return out


def _tokens(text: str) -> list[str]:
    """Words, whatever their numbers, case and sharp s."""
    return _WORD.findall(_DIGITS.sub("0", text).lower().replace("ß", "ss"))


def grams(text: str) -> frozenset:
    """Pairs of neighbouring words."""
    tokens = _tokens(text)
    return frozenset(zip(tokens, tokens[1:]))


def overlap_with(clause: Clause, question: frozenset) -> int:
    """Step of the share of the clause's word pairs that the question has."""
    share = len(clause.pairs & question) / len(clause.pairs) if clause.pairs else 0.0
    return 0 if share < 0.4 else 1 if share < 0.7 else 2 if share < 0.95 else 3


def _training(seed: int = 11) -> list[list[tuple[list[str], str]]]:
    rng = random.Random(seed)
    out = []
    for _ in range(TRAINING_SEQUENCES):
        lang = rng.choice(CODES) if rng.random() < 0.5 else "en"
        asked = lambda code=lang: " ".join(drawn(rng, QUESTIONS[code]) for _ in range(rng.choice((1, 2, 2))))
        question = asked()
        kind = rng.choice(("answer", "answer", "answer", "answer", "refusal", "refusal", "refusal", "refusal", "echo", "quoted", "foreign", "unfinished", "unfinished", "broken", "short", "signed", "list"))
        good = lambda code=lang, low=1, high=4: [drawn(rng, ANSWERS[code]) for _ in range(rng.randint(low, high))]
        pairs: list[tuple[str, str]] = []
        broken = False
        if kind == "answer":
            pairs = [(c, "answer") for c in good(high=rng.choice((1, 2, 4)))]
            if rng.random() < 0.3:
                pairs.insert(0, (drawn(rng, COURTESIES[lang]), "answer"))
        elif kind == "refusal":
            pairs = [(drawn(rng, REFUSALS[lang]), "refusal")]
            if rng.random() < 0.5:
                pairs.insert(0, (drawn(rng, COURTESIES[lang]), "refusal"))
            while rng.random() < 0.4 and len(pairs) < 4:
                pairs.append((drawn(rng, COURTESIES[lang]), "refusal"))
        elif kind in ("echo", "quoted"):
            text = question if rng.random() < 0.6 else question.upper() if rng.random() < 0.5 else question.lower()
            if rng.random() < 0.3:
                text = text.rstrip(".?! ")  # given back without its closing mark
            frame = rng.choice((*FRAMES[:4], "", "", ">"))
            frame = frame or ("You asked:" if kind == "quoted" else "")
            pairs = [(c, "echo") for c in split_clauses(f"{frame} {text}")]
            if kind == "quoted":
                pairs += [(c, "answer") for c in good()]
            elif rng.random() < 0.3:
                pairs.append(("Answer:", "echo"))
        elif kind == "foreign":
            other = rng.choice([c for c in CODES if c != lang])
            pairs = [(c, "foreign") for c in good(other)]
        elif kind == "unfinished":
            pairs = [(c, "answer") for c in good(low=1, high=rng.choice((1, 3, 5)))]
            text = pairs[-1][0]
            cut = text[: rng.randint(3, max(4, len(text) - 4))].rstrip(" .")
            pairs[-1] = (cut + rng.choice(("", "", "", "… [truncated]", " [output cut at limit]", " <|cut|>")), "unfinished")
        elif kind == "broken":
            broken = True
            whole = json.dumps({"summary": drawn(rng, ANSWERS[lang]), "steps": good(low=2, high=5)}, ensure_ascii=False)
            clauses = split_clauses(whole[: rng.randint(25, len(whole) - 2)])
            pairs = [(c, "answer") for c in clauses[:-1]] + [(clauses[-1], "unfinished")]
        elif kind == "short":
            lang, question = "en", asked("en")
            pairs = [(drawn(rng, SHORT_ANSWERS), "answer")]
        elif kind == "signed":
            pairs = [(c, "answer") for c in (*good(), *rng.choice(SIGN_OFFS))]
        else:
            pairs = [("Steps for this:", "answer")] + [(c.rstrip("."), "answer") for c in good(low=2)]
        if not pairs:
            continue
        out.append(_featurise([c for c, _ in pairs], [label for _, label in pairs], question, rng.random() < (0.4 if kind == "unfinished" else 0.0), broken, rng))
    return out


def _featurise(clauses: list[str], labels: list[str], question: str, limited: bool, broken: bool, rng: random.Random) -> list[tuple[list[str], str]]:
    seen = [Clause(_DIGITS.sub("0", c)) for c in clauses]
    asked, own = grams(question), language(question, 1.0, 0.5)
    # A few proper answers keep no word: what is merely unknown is an answer.
    unknown = rng.random() < (0.4 if len(seen) == 1 else 0.15) and set(labels) <= {"answer", "foreign"}
    out = []
    for t, clause in enumerate(seen):
        foreign = None if clause.code is None or own is None else clause.code != own
        last = t == len(seen) - 1
        context = context_features(overlap_with(clause, asked), foreign, len(seen) == 1, last, clause.ending, seen[t - 1].ending if t else "none", clause.size, limited, broken and last)
        # Dropped words teach the field to rely on endings, overlap and language as well.
        words = [f for f in clause.features if rng.random() < 0.5] if rng.random() < 0.7 else clause.features
        if unknown:
            words = [f for f in clause.features if f[:2] not in ("w:", "p:")]
        out.append((words + context, labels[t]))
    return out


_MODEL: list[ChainCRF] = []


def model() -> ChainCRF:
    """The trained field; training takes seconds and is done once in a driver."""
    if not _MODEL:
        _MODEL.append(ChainCRF(LABELS).fit(_training()))
    return _MODEL[0]


class Tagger:
    """Applies a trained field to records; remembers clauses, which never changes a result."""

    def __init__(self, field: ChainCRF) -> None:
        self.field, self.known, self.context = field, {}, {}

    def clause(self, text: str) -> Clause:
        text = _DIGITS.sub("0", text)
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= CACHE_CLAUSES:
                self.known.clear()
            found = Clause(text)
            if found.code not in (None, *CODES):  # words of a language without training say nothing
                found.features = [f for f in found.features if f[:2] not in ("w:", "p:")]
            found.score = self.field.emission(found.features)
            if not any(f[:2] in ("w:", "p:") and f in self.field.index for f in found.features):
                found.score[LABELS.index("refusal")] -= UNKNOWN  # nobody declines without a word for it
            found.features = None
            self.known[text] = found
        return found

    def emissions(self, question: str | None, response: str, error: str | None) -> tuple[list[Clause], np.ndarray]:
        body, broken = response.strip(), False
        if body[:1] == "{":
            try:
                body = "\n".join(_strings(json.loads(body)))
            except ValueError:
                broken = True
        clauses = [self.clause(c) for c in split_clauses(body)]
        question = question or ""
        lower, asked = question.lower().replace("ß", "ss"), None
        own = language(question, 1.0, 0.5)
        allowed = {own}
        if own and any(c.code not in (None, own) for c in clauses):
            allowed.add(asked_for(question))
        limited = bool(error) and bool(LIMIT_ERROR.search(error))
        n, before, context = len(clauses), "none", self.context
        rows = np.empty((n, len(LABELS)))
        for t, c in enumerate(clauses):
            overlap = 0
            if c.pairs and any(p in lower for p in c.probes):
                asked = grams(question) if asked is None else asked
                overlap = overlap_with(c, asked)
            last = t == n - 1
            key = (overlap, None if c.code is None or not own else c.code not in allowed, n == 1, last, c.ending, before if last else "", c.size if last else "", limited and last, broken and last)
            score = context.get(key)
            if score is None:
                score = context[key] = self.field.emission(context_features(*key))
            np.add(c.score, score, out=rows[t])
            before = c.ending
        return clauses, rows


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)
    elif value is not None and not isinstance(value, bool):
        yield str(value)


def judge(clauses: list[Clause], tags: np.ndarray, question: str | None, response: str) -> tuple[str | None, dict[str, float]]:
    """The pair's defect from the shares of letters under each tag. Who only gives the question back holds at least half of it."""
    tags, sums = tags.tolist(), [0] * len(LABELS)
    for clause, tag in zip(clauses, tags):
        sums[tag] += clause.length
    whole = max(sum(sums), 1)
    share = {name: n / whole for name, n in zip(LABELS, sums)}
    if share["echo"] + (share["unfinished"] if share["echo"] > 0.5 else 0.0) >= 0.8:
        asked = grams(question or "")
        if len(asked & grams(response)) >= HELD_BACK * len(asked):
            return "echo", share
    if tags and tags[-1] == LABELS.index("unfinished"):
        return "truncated", share
    if share["refusal"] >= 0.5:
        return "refusal", share
    if share["foreign"] >= 0.5:
        return "wrong_language", share
    return None, share


def tag_pairs(records: DataFrame, record_id: str = "record_id", question: str = "input_text", response: str = "output_text", error: str = "error") -> DataFrame:
    """(record_id, defect, and the share of letters under each tag) of every row; defect is null for proper pairs.

    ``empty``: no error and a response without content. A response without content beside an
    error is no case; a null question is in no language and is never echoed. Whole texts are
    tagged, however long; repeated rows come out as often; rows with a null identifier stay.
    """
    shared = records.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            ids, asked, said, failed = (batch.column(i).to_pylist() for i in range(4))
            defects: list[str | None] = [None] * len(ids)
            shares = np.zeros((len(ids), len(LABELS)))
            waiting, who = [], []
            for i, (q, r, e) in enumerate(zip(asked, said, failed)):
                if is_nothing(r):
                    defects[i] = "empty" if e is None or not e.strip() else None
                    continue
                clauses, scores = tagger.emissions(q, r, e)
                if not clauses:
                    defects[i] = "empty" if e is None or not e.strip() else None
                    continue
                waiting.append(scores)
                who.append((i, clauses))
            for (i, clauses), tags in zip(who, tagger.field.decode(waiting)):
                defects[i], share = judge(clauses, tags, asked[i], said[i])
                shares[i] = [share[name] for name in LABELS]
            columns = [pa.array(shares[:, k]) for k in range(len(LABELS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(defects, pa.string()), *columns], names=[record_id, "defect", *LABELS])

    kind = dict(records.dtypes)[record_id]
    schema = f"`{record_id}` {kind}, defect string, " + ", ".join(f"{name} double" for name in LABELS)
    return records.select(record_id, question, response, error).mapInArrow(run, schema)


def defective_pairs(records: DataFrame, **columns: str) -> DataFrame:
    """(record_id, defect), one row per defective record."""
    key = columns.get("record_id", "record_id")
    return tag_pairs(records, **columns).where("defect is not null").select(key, "defect").dropDuplicates([key])
