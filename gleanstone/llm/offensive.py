"""Abusive, hateful or sexual content: a score for every document and rates per source.

Texts are first undone of disguises (look-alike letters, invisible characters, stretched
and spaced letters). A document is scored by its worst sentence: the length-normalised
log-likelihood ratio of class-conditional Kneser-Ney models. They are trained on the driver
on sentences composed by frames and on at most ``MAX_LABELLED`` rated documents, drawn by a digest;
as ratings are of documents, a few rounds decide which sentence of an offensive document
the rating was for. Masked letters are filled in from the words of offensive sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.llm.kneser_ney import EDGE, ClassModels
from gleanstone.llm.offensive_training import sentences_of_classes

MAX_LABELLED = 10_000
ROUNDS = 3
THRESHOLD = 0.45
#: Log-odds of a sentence for being offensive: before all evidence, and for each document with it that is called offensive or not.
PRIOR, TOLD_BAD, TOLD_GOOD = -3.0, 1.9, -1.8
#: Below these log-odds a sentence of a document called offensive is learnt as ordinary.
DOUBT = -1.5
#: Bound of what ratings can say, and what they must say at least of a sentence that alone explains a rating.
MOST, LONE = 6.0, 1.2
#: Offensive ratings from which unlike sentences are learnt and the threshold is fitted.
ENOUGH = 30
CACHE_SENTENCES = 200_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁɡһցոսαενικορτυχдл", "abekmhopctyxijsdghgnuaevikoptuxdl")
_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠-⁤︀-️﻿]")
_COMBINING = {c: None for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))}
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·]{1,2}[^\W\d_](?![^\W_])){2,}(?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"(?<=[.!?…。！？])[\"”»')\]]*\s+|[。！？]|\s*[\n|]\s*")
_LEAD = re.compile(r"^\W*(?:\[[^\]]*\]\W*)?(?:(?:user|assistant|agent|caller|customer|system|human|bot)\s*:\s*)?", re.IGNORECASE)
#: A speaker's label without speech.
_LABEL = re.compile(r"\W*[^\W\d_]+\s*:\W*$")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[*#@$!%&_\-'’.](?=[*#@$!%&_.]*[^\W_]))*|[^\W_]+")
#: Letters of scripts that put no blanks between words: each counts as a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_MASK = re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[a-z]")
_OTHER = re.compile(r"[Ͱ-ϿЀ-ԯա-ևɡ]")
_NUMBER = re.compile(r"\d+")


def plain(text: str) -> str:
    """Lower case without invisible characters, accents, look-alikes and spaced or stretched letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = text.translate(_COMBINING) if not text.isascii() else text
    text = text.lower()
    if not text.isascii() and _OTHER.search(text):
        text = " ".join(_latin_word(w) for w in text.split(" "))
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m.group()), text)
    return _STRETCHED.sub(r"\1", text)


def _latin_word(word: str) -> str:
    return word.translate(LOOKALIKES) if _OTHER.search(word) and _LATIN.search(word) else word


def pieces(text: str) -> list[str]:
    """Sentences and lines as they stand."""
    return [p for p in _END.split(text) if p]


def sentence(piece: str) -> str:
    """A piece without disguises and speaker."""
    return _LEAD.sub("", plain(piece), count=1)


def sentences(text: str) -> list[str]:
    return [s for p in pieces(text) if (s := sentence(p))]


class Words:
    """Splits sentences into words and fills masked letters in from known offensive words."""

    def __init__(self, vocabulary: set[str] = frozenset()) -> None:
        self.by_shape: dict[tuple, list[str]] = defaultdict(list)
        self.vocabulary = vocabulary
        for w in vocabulary:
            self.by_shape[len(w), w[0]].append(w)

    def __call__(self, sentence: str) -> tuple[str, ...]:
        out = []
        if not sentence.isascii():
            sentence = _UNSPACED.sub(r" \g<0> ", sentence)
        for token in _TOKEN.findall(sentence):
            if token.isalpha():
                out.append(token)
            elif token.isdigit():
                out.append("0")
            else:
                out += self._fill(token)
        return tuple(out)

    def _fill(self, token: str) -> list[str]:
        bare = token.strip("'’.-_!")
        if _LATIN.search(bare) and not bare.isalpha() and len(bare) >= 4:
            letters = sum(map(str.isalpha, bare))
            if letters >= 2 and "'" not in bare and "’" not in bare:
                for w in self.by_shape.get((len(bare), bare[0]), ()):
                    if all(a == b or not (a.isalpha()) for a, b in zip(bare, w)):
                        return [w]
        return [p if p.isalpha() else "0" for p in re.findall(r"[^\W\d_]+|\d+", token)]


class Scorer:
    def __init__(self, models: ClassModels, words: Words, threshold: float) -> None:
        self.models, self.words, self.threshold, self.known = models, words, threshold, {}

    def piece(self, piece: str) -> float | None:
        """The score of a sentence as it stands, whatever its numbers; null if nothing is left of it."""
        key = _NUMBER.sub("0", piece)
        if key not in self.known:
            if len(self.known) >= CACHE_SENTENCES:
                self.known.clear()
            self.known[key] = self.sentence(text) if (text := sentence(piece)) else None
        return self.known[key]

    def sentence(self, text: str) -> float:
        words = self.words(text)
        return self.models.score(words) if words and not _LABEL.match(text) else -1.0

    def document(self, text: str | None) -> float | None:
        """The worst sentence's score; null for texts without words."""
        if not text:
            return None
        return max((s for p in pieces(text) if (s := self.piece(p)) is not None), default=None)


def _pairs(words: tuple[str, ...]) -> list[tuple[str, str]]:
    line = (EDGE, *words, EDGE)
    return list(zip(line, line[1:]))


def _ratings_of_pairs(documents: list[tuple[list[tuple[str, ...]], bool]]) -> dict[tuple[str, str], float]:
    """What the ratings of the documents that hold a pair of words say, as log-odds of being what they were for."""
    total: Counter = Counter()
    for lines, offensive in documents:
        weight = TOLD_BAD if offensive else TOLD_GOOD
        for pair in {p for w in lines for p in _pairs(w)}:
            total[pair] += weight
    return {p: max(-MOST, min(MOST, x)) for p, x in total.items()}


def _known() -> tuple[Counter, Counter]:
    """Sentences of both classes that are known before any rating."""
    return tuple(Counter(w for s in known if (w := Words()(plain(s)))) for known in sentences_of_classes())


def train(rated: list[tuple[str, float]]) -> Scorer:
    """``rated``: texts and the share of annotators who called them offensive.

    Ratings are of documents and err in both directions. For each sentence the log-odds that it is what a
    rating was for add up from the models' score and from the ratings of all documents that hold its pairs of
    words: it is learnt as offensive if they are positive and its document was called so, as ordinary if they
    are negative (clearly, in such a document), and not at all otherwise. With few ratings no unexplained rating is explained.
    """
    seeds = _known()
    texts = [(sentences(text), rate >= 0.5) for text, rate in rated if text]
    enough = sum(offensive for _, offensive in texts) >= ENOUGH
    models, words = ClassModels().fit(*seeds), Words(_telling(*seeds))
    for _ in range(ROUNDS):
        documents = [([w for s in lines if (w := words(s))], offensive) for lines, offensive in texts]
        told = _ratings_of_pairs(documents)
        toxic, ordinary = Counter(seeds[0]), Counter(seeds[1])
        for lines, offensive in documents:
            best = None
            for w in lines:
                pairs = _pairs(w)
                ratings = sum(told[p] for p in pairs) / len(pairs)
                odds = PRIOR + ratings + max(-4.0, min(4.0, 2.0 * models.score(w)))
                if odds > 0 and offensive:
                    toxic[w] += 1
                elif odds < (DOUBT if offensive else 0.0):
                    ordinary[w] += 1
                if offensive and (best is None or odds > best[0]):
                    best = (odds, ratings, w)
            if best and enough and best[0] <= 0 and best[1] > LONE:
                # Nothing explains the rating but the sentence that ordinary documents know least.
                toxic[best[2]] += 1
                ordinary[best[2]] -= best[0] < DOUBT
        models = ClassModels().fit(+toxic, +ordinary)
        words = Words(_telling(+toxic, +ordinary))
    scorer = Scorer(models, words, THRESHOLD)
    scorer.threshold = _best_threshold([(scorer.document(text), rate >= 0.5) for text, rate in rated if text])
    scorer.known.clear()
    models.known.clear()
    return scorer


def _telling(toxic: Counter, ordinary: Counter) -> set[str]:
    bad, good = Counter(), Counter()
    for counts, into in ((toxic, bad), (ordinary, good)):
        for sentence, n in counts.items():
            for w in set(sentence):
                into[w] += n
    return {w for w, n in bad.items() if len(w) >= 4 and w.isalpha() and good[w] * 5 < n}


def _best_threshold(rated: list[tuple[float | None, bool]]) -> float:
    """The cut with the best F measure on the rated documents; few ratings leave the default."""
    known = [(s, o) for s, o in rated if s is not None]
    positives = sum(o for _, o in known)
    if positives < ENOUGH:
        return THRESHOLD
    best, cut = -1.0, THRESHOLD
    for t in [x / 20 for x in range(-2, 21)]:
        hits = sum(1 for s, o in known if s > t and o)
        chosen = sum(1 for s, _ in known if s > t)
        f = 2 * hits / (chosen + positives)
        if f > best + 0.01 or (f >= best - 0.01 and abs(t - THRESHOLD) < abs(cut - THRESHOLD)):
            best, cut = max(best, f), t
    return cut


def rated_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, float]]:
    """Texts and mean ratings of at most ``most`` rated documents, drawn by a digest of their identifier."""
    rates = labels.where("offensive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("offensive").alias("rate"))
    drawn = rates.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Only the drawn documents' texts move: the join, with at most ``most`` rows on its side, comes first.
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])
    return [(r["text"], float(r["rate"])) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def scores(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, source, score, offensive) of every row.

    Null, empty and wordless texts have a null score and are not offensive; texts are read whole;
    repeated rows come out as often; without ratings the exemplars alone are the training.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(rated_sample(docs, labels, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            found = [scorer.document(t) for t in batch.column(2).to_pylist()]
            flags = [s is not None and s > scorer.threshold for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array(flags, pa.bool_())], names=["doc_id", "source", "score", "offensive"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, source string, score double, offensive boolean")


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, labels).where("offensive").select("doc_id").distinct()


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, offensive ones and their rate of each source; documents without source count under null."""
    out = scores(docs, labels).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("offensive").alias("offensive"), F.avg("score").alias("mean_score"))
    return out.withColumn("rate", F.round(F.col("offensive") / F.col("documents"), 6))
