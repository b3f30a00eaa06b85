"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The vocabulary file (a path, never copied) is read on the driver and broadcast:
its size is that of the vocabulary, not of the data. Texts stay where they are;
each Arrow batch is split into words, and each word not seen before by this
worker is encoded over a contiguous rank array: the list of part boundaries and
the list of ranks of adjacent parts. The smallest rank is found by scanning, its
boundary deleted and the two neighbouring ranks looked up again. Words of more
than ``LONG_WORD`` bytes, for which scanning is quadratic, take a heap over linked
parts that merges in the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LONG_WORD = 128
CACHE_WORDS = 300_000
NONE = 1 << 30
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{folder}/{name}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _encode_long(word, ranks)
    get = ranks.get
    bounds = list(range(len(word) + 1))
    adjacent = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == NONE:
            break
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, n = ranks.get, len(word)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once the part is merged away
    left = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
            r = get(word[i : end[stop]], NONE)
            if r != NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        h = left[i]
        if h >= 0:
            r = get(word[h:stop], NONE)
            if r != NONE:
                heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Splits texts into words and remembers the ids of words; the memory is bounded and never changes a result."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.ranks, self.known, self.words = ranks, {}, regex.compile(PATTERN).findall

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = known[word] = encode_word(word.encode("utf-8", "replace"), self.ranks)
            out += ids
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each broadcast vocabulary in a worker, kept between tasks."""
    ranks = shared.value
    if id(ranks) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(ranks)] = Encoder(ranks)
    return _ENCODERS[id(ranks)]


def _shared_ranks(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(read_ranks(path or vocabulary_path()))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens, whose names in a text are ordinary text.

    Null and empty texts have the empty list. Rows are neither dropped nor merged; repeated ones
    come out as often; other columns are ignored.
    """
    shared = _shared_ranks(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            ids, offsets = [], [0]
            for value in batch.column(1):
                value = value.as_py()
                if value:
                    ids += encoder.encode(value)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[doc_id, "ids"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(encode, f"`{doc_id}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens`` (0 for null and empty texts) of every row."""
    shared = _shared_ranks(docs, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            sizes = [encoder.count(v) if (v := value.as_py()) else 0 for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint")
