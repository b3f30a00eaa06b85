"""Class-conditional trigram models with interpolated Kneser-Ney smoothing and one shared backoff."""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log

DISCOUNT = 0.75
EDGE = "\x02"
#: Words of the stretch whose mean counts in longer sentences.
WINDOW = 5
#: Bounds of what one word can say, so that no single word decides for a stretch.
LEAST, MOST = 3.0, 4.0
#: Trigrams whose ratio is kept; it depends on nothing but the trigram.
CACHE = 1_000_000


class ClassModels:
    """Two trigram models, ``toxic`` and ``ordinary``.

    Trigrams, bigrams and the continuation counts of single words belong to a class. Below them
    lies one distribution that both classes share: in how many contexts of either class a word
    occurs. Rare expressions fall back to it under both classes and speak for none.
    """

    def __init__(self) -> None:
        self.tri = (Counter(), Counter())
        self.bi = (Counter(), Counter())
        self.one = (Counter(), Counter())
        self.tri_total, self.tri_kinds = (Counter(), Counter()), (Counter(), Counter())
        self.bi_total, self.bi_kinds = (Counter(), Counter()), (Counter(), Counter())
        self.one_total, self.one_share = [0, 0], [1.0, 1.0]
        self.shared: dict[str, float] = {}
        self.floor = 1e-6
        self.known: dict[tuple[str, str, str], float] = {}

    def fit(self, toxic: Counter, ordinary: Counter) -> ClassModels:
        """Counters of sentences (tuples of words)."""
        shared: dict[str, set] = defaultdict(set)
        for c, sentences in enumerate((toxic, ordinary)):
            seen: dict[tuple, set] = defaultdict(set)
            before: dict[str, set] = defaultdict(set)
            for words, weight in sentences.items():
                line = (EDGE, EDGE, *words, EDGE)
                for i in range(2, len(line)):
                    u, v, w = line[i - 2 : i + 1]
                    self.tri[c][u, v, w] += weight
                    seen[v, w].add(u)
                    before[w].add(v)
                    shared[w].add(v)
            for (u, v, _), n in self.tri[c].items():
                self.tri_total[c][u, v] += n
                self.tri_kinds[c][u, v] += 1
            for (v, w), contexts in seen.items():  # continuation counts
                self.bi[c][v, w] = len(contexts)
                self.bi_total[c][v] += len(contexts)
                self.bi_kinds[c][v] += 1
            for w, contexts in before.items():
                self.one[c][w] = len(contexts)
            self.one_total[c] = sum(self.one[c].values())
            self.one_share[c] = DISCOUNT * len(before) / self.one_total[c] if before else 1.0
        total = sum(map(len, shared.values())) or 1
        self.floor = DISCOUNT * len(shared) / total / (len(shared) + 1.0)
        self.shared = {w: max(len(v) - DISCOUNT, 0.0) / total + self.floor for w, v in shared.items()}
        self.known = {}
        return self

    def single(self, c: int, w: str) -> float:
        own = max(self.one[c].get(w, 0) - DISCOUNT, 0.0) / self.one_total[c] if self.one_total[c] else 0.0
        return own + self.one_share[c] * self.shared.get(w, self.floor)

    def pair(self, c: int, v: str, w: str) -> float:
        total = self.bi_total[c].get(v)
        if not total:
            return self.single(c, w)
        return (max(self.bi[c].get((v, w), 0) - DISCOUNT, 0.0) + DISCOUNT * self.bi_kinds[c][v] * self.single(c, w)) / total

    def probability(self, c: int, u: str, v: str, w: str) -> float:
        total = self.tri_total[c].get((u, v))
        if not total:
            return self.pair(c, v, w)
        return (max(self.tri[c].get((u, v, w), 0) - DISCOUNT, 0.0) + DISCOUNT * self.tri_kinds[c][u, v] * self.pair(c, v, w)) / total

    def ratio(self, u: str, v: str, w: str) -> float:
        """Log-likelihood ratio, toxic over ordinary, of a word, at the highest order at which either class knows it.

        Above that order both classes only tell how much they back off, which is no sign of either;
        a word that neither class knows, a number and a Latin letter alone are none at all.
        """
        found = self.known.get((u, v, w))
        if found is not None:
            return found
        if (u, v, w) in self.tri[0] or (u, v, w) in self.tri[1]:
            p = [self.probability(c, u, v, w) for c in (0, 1)]
        elif (v, w) in self.bi[0] or (v, w) in self.bi[1]:
            p = [self.pair(c, v, w) for c in (0, 1)]
        elif w in self.shared and w not in (EDGE, "0") and (len(w) > 1 or not w.isascii()):
            p = [self.single(c, w) for c in (0, 1)]
        else:
            p = [1.0, 1.0]
        if len(self.known) >= CACHE:
            self.known.clear()
        found = self.known[u, v, w] = max(-LEAST, min(MOST, log(p[0] / p[1])))
        return found

    def ratios(self, words: tuple[str, ...]) -> list[float]:
        """The ratio of each word and of the end."""
        line = [w if w in self.shared else "" for w in words]
        out, u, v = [], EDGE, EDGE
        for w in line:
            out.append(self.ratio(u, v, w))
            u, v = v, w
        out.append(self.ratio(u, v, EDGE))
        return out

    def score(self, words: tuple[str, ...], window: int = WINDOW) -> float:
        """Mean ratio per word; of sentences longer than ``window`` that of their worst stretch of so many words."""
        ratios = self.ratios(words)
        n = len(ratios)
        if n <= window:
            return sum(ratios) / n
        now = best = sum(ratios[:window])
        for i in range(window, n):
            now += ratios[i] - ratios[i - window]
            best = max(best, now)
        return best / window
