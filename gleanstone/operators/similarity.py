"""Shingles, MinHash, LSH and exact Jaccard as joins on shingles and buckets."""

from __future__ import annotations

import copy
import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.session import attach, materialize

PRIME = (1 << 61) - 1
#: Members of a bucket or shingle that are compared all with all; larger ones compare by parts.
BLOCK = 1_000


def normalised(text: Column) -> Column:
    """Lower case, placed tokens without numbers, no digits, white space collapsed."""
    t = F.regexp_replace(F.lower(text), r"\[([a-z]+)_\d+\]", "[$1]")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)\d+", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def shingles(docs: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """(key, shingle), each once: windows of ``size`` words; shorter texts are one shingle; texts without words have none.

    Short and long texts take separate branches, so that the window expression stands bare under its explode.
    """
    words = docs.select(F.col(key), F.split(normalised(F.col(text)), " ").alias("_w")).where("_w is not null and _w[0] <> ''")
    short = words.where(F.size("_w") <= size).select(key, F.array_join("_w", " ").alias("shingle"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_w") - (size - 1)), lambda i: F.array_join(F.slice("_w", i, size), " "))
    long = words.where(F.size("_w") > size).select(key, F.explode(grams).alias("shingle"))
    return short.unionByName(long).distinct()


def shingle_sizes(sets: DataFrame, key: str) -> DataFrame:
    return sets.groupBy(key).agg(F.count("*").alias("size"))


def minhash_family(permutations: int = 64, seed: int = 1729) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Multipliers and offsets: all multipliers are drawn first, then all offsets."""
    rng = random.Random(seed)
    multipliers = tuple(rng.randrange(1, PRIME) for _ in range(permutations))
    return multipliers, tuple(rng.randrange(0, PRIME) for _ in range(permutations))


def _mulmod(a: int | np.ndarray, x: np.ndarray) -> np.ndarray:
    """(a * x) mod 2**61 - 1 on 64-bit arrays that broadcast together, by halves of 32 bits."""
    p = np.uint64(PRIME)
    a = np.asarray(a, dtype=np.uint64)
    low, high = a & np.uint64(0xFFFFFFFF), a >> np.uint64(32)
    xl, xh = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    fold = lambda v: (v & p) + (v >> np.uint64(61))
    shift = lambda v, n: ((v << np.uint64(n)) & p) + (v >> np.uint64(61 - n))
    middle = fold(fold(low * xh) + fold(high * xl))
    top = fold(high * xh)
    total = fold(fold(low * xl) + shift(middle, 32)) + fold(shift(shift(top, 32), 32))
    total = fold(total)
    return np.where(total >= p, total - p, total)


#: Base hashes of a shingle: what is taken of which digest; both below the prime or brought there.
DIGESTS = {"blake2b": lambda g: int.from_bytes(hashlib.blake2b(g, digest_size=8).digest(), "big") % PRIME, "md5": lambda g: int(hashlib.md5(g).hexdigest()[:15], 16)}


def signatures(docs: DataFrame, key: str, text: str, size: int = 5, permutations: int = 64, seed: int = 1729, digest: str = "blake2b") -> DataFrame:
    """(key, shingles as 64-bit hashes, signature) of the texts that have words, computed where the texts lie.

    ``digest`` is ``blake2b``, or ``md5`` where other engines are to make the same signatures.
    """
    multipliers, offsets = minhash_family(permutations, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_hash, p = DIGESTS[digest], np.uint64(PRIME)
        many, shifts = np.array(multipliers, dtype=np.uint64)[:, None], np.array(offsets, dtype=np.uint64)[:, None]
        for batch in batches:
            rows, sets, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.split(" ") if text else []
                if not words:
                    continue
                grams = {" ".join(words)} if len(words) <= size else {" ".join(words[j : j + size]) for j in range(len(words) - size + 1)}
                base = np.array(sorted({base_hash(g.encode()) for g in grams}), dtype=np.uint64)
                rows.append(i)
                sets.append(base.astype(np.int64).tolist())
                # All permutations at once; long texts go in pieces, so the table stays small.
                least = np.full(permutations, p, dtype=np.uint64)
                for k in range(0, len(base), 4096):
                    mixed = _mulmod(many, base[None, k : k + 4096]) + shifts
                    least = np.minimum(least, np.where(mixed >= p, mixed - p, mixed).min(axis=1))
                values.append(least.astype(np.int64).tolist())
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))], names=[key, "hashes", "signature"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, normalised(F.col(text)).alias("_n")).mapInArrow(run, f"`{key}` {kind}, hashes array<bigint>, signature array<bigint>")


def estimated_jaccard(left: Column, right: Column) -> Column:
    return F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x)) / F.size(left)


def bands(signed: DataFrame, key: str, number: int = 16) -> DataFrame:
    """(band, bucket, key): the rows of each band as one digest."""
    rows = F.size("signature") / number
    slices = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.slice("signature", (b * rows + 1).cast("int"), rows.cast("int"))).alias("bucket")))
    return signed.select(key, F.inline(slices)).select("band", "bucket", key)


def candidate_pairs(buckets: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of all keys that share a bucket, each pair once.

    Each key's buckets go with it, and a pair comes out of the first bucket that both share: pairs are never gathered or
    shuffled, however many they are. Buckets are cut into blocks of at most about ``block`` keys by digest, which are
    gathered as lists of their keys; every two blocks of a bucket meet in a task of their own, so no task holds a whole large bucket.
    """
    buckets = materialize(buckets.where(F.col(key).isNotNull()))
    own = buckets.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("band", "bucket"))).alias("all"))
    rows = own.select(key, "all", F.posexplode("all").alias("at", "x")).select(key, "x.band", "x.bucket", F.slice("all", F.lit(1), F.col("at")).alias("before"))
    sizes = materialize(buckets.groupBy("band", "bucket").agg(F.count_distinct(key).alias("n")).where("n > 1"))
    rows = attach(rows, sizes, ["band", "bucket"], "inner")
    parts = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    lists = materialize(rows.groupBy("band", "bucket", "parts", "part").agg(F.collect_list(F.struct(F.col(key).alias("k"), "before")).alias("held")))
    # Of two blocks the lower one is the left side, so that every two meet once; a block also meets itself.
    left = lists.select("band", "bucket", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"), F.col("held").alias("l"))
    right = lists.select("band", "bucket", F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), "part")).alias("part"), F.col("held").alias("r"))
    met = left.join(right, ["band", "bucket", "part", "other"]).select((F.col("part") == F.col("other")).alias("same"), "r", F.explode("l").alias("x"))
    met = met.select("same", "x", F.explode("r").alias("y")).where(~F.col("same") | (F.col("x.k") < F.col("y.k")))
    met = met.where((F.size("x.before") == 0) | (F.size("y.before") == 0) | ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, key: str, threshold: float, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(a, b, jaccard) of the pairs whose exact similarity reaches the threshold; only the sets of keys that are in a pair are shuffled."""
    pairs, (one, two) = materialize(pairs), names
    met = pairs.select(F.col(one).alias(key)).union(pairs.select(F.col(two).alias(key))).distinct()
    held = materialize(attach(sets.select(key, "hashes"), met, [key], "left_semi"))
    side = lambda name, values: held.select(F.col(key).alias(name), F.col("hashes").alias(values))
    both = pairs.join(side(one, "_l"), one).join(side(two, "_r"), two)
    common = F.size(F.array_intersect("_l", "_r"))
    value = common / (F.size("_l") + F.size("_r") - common)
    return both.select(one, two, value.alias("jaccard")).where(F.col("jaccard") >= threshold)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which close ones lie far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(words: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the windows of ``size`` word digests of each text, each once in a text; a shorter text is one window."""
    windows = np.maximum(sizes - size + 1, 1)
    owner = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(owner)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(windows) + windows, windows)
    width, out = np.minimum(sizes, size)[owner], np.zeros(len(owner), dtype=np.uint64)
    for j in range(size):
        there = width > j
        longer = _mixed((out ^ words[np.minimum(at + j, len(words) - 1)]) + np.uint64(0x9E3779B97F4A7C15))
        out = longer if there.all() else np.where(there, longer, out)
    order = np.argsort(out)
    order = order[np.argsort((owner if len(sizes) > 1 << 16 else owner.astype(np.uint16))[order], kind="stable")]  # few owners are sorted by their digits
    owner, out = owner[order], out[order]
    first = np.ones(len(out), dtype=bool)
    first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], out[first]


def shingle_hashes(docs: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """(key, hashes): the shingle set of each text with words as sorted 64-bit digests, made where the text lies, without a shuffle.

    Words are digested once each, and windows from the digests of their words for many texts at once.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 1_000):
                batch = whole.slice(k, 1_000)
                batch = batch.filter(pa.compute.greater(pa.compute.binary_length(batch.column(1)), 0))
                if not batch.num_rows:
                    continue
                lists = pa.compute.split_pattern(batch.column(1), " ")
                sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                if len(known) > 500_000:
                    known.clear()
                own = coded.dictionary.to_pylist()
                for w in own:
                    if w not in known:
                        known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                words = np.array([known[w] for w in own], dtype=np.uint64)[coded.indices.to_numpy()]
                owner, hashes = _windows(words, sizes, size)
                offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
                np.cumsum(np.bincount(owner, minlength=len(sizes)), out=offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], names=[key, "hashes"])

    return docs.select(key, normalised(F.col(text)).alias("_n")).mapInArrow(run, f"`{key}` {kind}, hashes array<bigint>")


#: Counters of shingles; shingles that share one only make the order of rarity coarser.
COUNTERS = 1 << 20


def _counters(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each counter: a table of fixed size, whatever the input."""
    piece = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                hashes = np.asarray(batch.column(0).slice(k, 1_000).flatten(), dtype=np.int64)
                counts += np.bincount(hashes & (COUNTERS - 1), minlength=COUNTERS)
        for i in range(0, COUNTERS, piece):
            if counts[i : i + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([counts[i : i + piece].tolist()], pa.list_(pa.int64()))], names=["at", "counts"])

    def add(key: tuple, batches: Iterator[pa.Table]) -> pa.Table:
        rows = batches if isinstance(batches, pa.Table) else pa.concat_tables(batches)
        total = np.zeros(piece, dtype=np.int64)
        for one in rows.column("counts").to_pylist():
            total += np.array(one, dtype=np.int64)
        return pa.table({"at": pa.array([key[0].as_py()]), "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, dtype=np.int32)
    for r in sets.select("hashes").mapInArrow(run, "at bigint, counts array<bigint>").groupBy("at").applyInArrow(add, "at bigint, counts binary").collect():
        out[r["at"] : r["at"] + piece] = np.frombuffer(r["counts"], dtype="<i4")
    return out


def _prefixes(sets: DataFrame, key: str, threshold: float, counts: np.ndarray) -> DataFrame:
    """(h, key, at, s0, s1) of the rarest n - ceil(t n) + 1 shingles of each set, made where the set lies.

    ``h`` is half of a shingle's digest, ``at`` the size of its set and its place there, and s0, s1 are 128 bits that each shingle of the set flips one of.
    """
    kind, shared = dict(sets.dtypes)[key], sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1_000):
                batch = whole.slice(k, 1_000)
                batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(1)), 0))
                if not batch.num_rows:
                    continue
                sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                hashes = np.asarray(batch.column(1).flatten(), dtype=np.int64)
                owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
                flip = np.left_shift(np.int64(1), (hashes >> 20) & 63)
                first = ((hashes >> 26) & 1) == 0
                sketch = [np.bitwise_xor.reduceat(np.where(half, flip, 0), starts) for half in (first, ~first)]
                order = np.lexsort((hashes, known[hashes & (COUNTERS - 1)], owner))
                place = np.arange(len(hashes)) - np.repeat(starts, sizes)
                kept = place < np.repeat(sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1, sizes)
                rows = owner[kept]
                fields = [pa.array((hashes[order][kept] >> 32).astype(np.int32)), batch.column(0).take(pa.array(rows)), pa.array((sizes[rows] << 32) | place[kept]), *[pa.array(w[rows]) for w in sketch]]
                yield pa.RecordBatch.from_arrays(fields, names=["h", key, "at", "s0", "s1"])

    return sets.select(key, "hashes").mapInArrow(run, f"h int, `{key}` {kind}, at bigint, s0 bigint, s1 bigint")


def _likely(prefixes: DataFrame, key: str, threshold: float, tile: int = 1_000) -> DataFrame:
    """(key, other) of the sets that meet on a shingle and may reach the threshold, some of them more than once.

    c common shingles of sets of n and m reach it from c = t (n + m) / (1 + t) on. So many are there behind the first common one, which
    is at known places, or the pair is left out; so it is if the sketches differ in more bits than n + m - 2 c shingles could flip.
    """
    kind = dict(prefixes.dtypes)[key]

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        at, keys = group.column("at").to_numpy(), group.column(key).combine_chunks()
        n, rest = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
        s0, s1 = (group.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("s0", "s1"))
        for i in range(0, len(n), tile):
            for j in range(i, len(n), tile):
                if n[i : i + tile][-1] < n[j] * threshold - 1e-9:
                    break  # rows come by size: no later one is near either
                x, y = slice(i, i + tile), slice(j, j + tile)
                both = n[x, None] + n[None, y]
                least = np.ceil(both * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
                good = np.minimum(rest[x, None], rest[None, y]) >= least
                if i == j:
                    good &= np.arange(len(both))[:, None] < np.arange(both.shape[1])[None, :]
                l, r = np.nonzero(good)
                differ = np.bitwise_count(s0[x][l] ^ s0[y][r]).astype(np.int64) + np.bitwise_count(s1[x][l] ^ s1[y][r])
                near = differ <= both[l, r] - 2 * least[l, r]
                if near.any():
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(l[near] + i)), keys.take(pa.array(r[near] + j))], names=[key, "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                if held and held[-1].column(0)[0] != part.column(0)[0]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                if end < len(h) and not held:
                    if end - start > 1:
                        yield from pairs(pa.Table.from_batches([part]))
                else:
                    held.append(part)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    grouped = prefixes.repartition("h").sortWithinPartitions("h", "at")
    out = grouped.mapInArrow(run, f"`{key}` {kind}, other {kind}")
    return out.where(F.col(key) != F.col("other")).select(F.least(key, "other").alias(key), F.greatest(key, "other").alias("other"))


def similar_pairs(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, other, jaccard) of all pairs, key < other, that reach ``threshold`` > 0, exact.

    Prefix filtering: shingles are ordered by how often they, or others on the same counter, occur in the corpus. Two sets
    that reach the threshold share one of the first n - ceil(t n) + 1 shingles of each in any such order, so the others,
    boilerplate that meets all with all among them, are never joined on. Only prefixes are shuffled, once, and the sets of keys
    that are likely to be in a pair; ``sets`` is best a plan that makes them from the texts again, as they are larger than these.
    """
    pairs = _likely(_prefixes(sets, key, threshold, _counters(sets)), key, threshold).distinct()
    return verified(pairs, sets, key, threshold, (key, "other"))


#: Shingles of a reference set whose index is sent to the executors at once.
INDEXED = 6_000_000
#: Classes of an index that are kept as rows of all its sets, and the share of the sets from which on a class may be one.
ROWS, OFTEN = 256, 1 / 16
#: Common shingles up to which a set is compared by bits, and the words of one array of them that stay in a core's cache.
FEW, WORDS = 15, 1 << 16


class _Index:
    """Sets of a reference by shingle, in their order; shingles that the same sets hold are one class with one list of these sets."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray) -> None:
        owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(first)
        self.sizes, self.shingles = sizes, hashes[first]
        held = np.diff(np.append(first, len(hashes)))
        marks = np.random.default_rng(1729).integers(0, 2**64, len(sizes), dtype=np.uint64)
        sums = np.add.reduceat(marks[owners], first) if len(first) else np.zeros(0, dtype=np.uint64)
        _, one, classes = np.unique(sums, return_index=True, return_inverse=True)
        self.classes, self.held, self.shingles_of = classes.astype(np.int32), held[one], np.bincount(classes, minlength=len(one))
        self.ends = np.cumsum(self.held)
        self.sets = owners[np.arange(self.held.sum()) + np.repeat(first[one] - self.ends + self.held, self.held)]
        self.made: dict[str, tuple] = {}  # by the worker that uses the index, once for all its tasks

    def prepare(self) -> None:
        """Rows of the classes that many sets hold: adding a whole row is cheaper than picking these sets."""
        often = np.argsort(-self.held, kind="stable")[:ROWS]
        often = often[(self.held[often] >= max(len(self.sizes) * OFTEN, 8)) & (self.shingles_of[often] < 256)]
        self.row_of = np.full(len(self.held), -1, dtype=np.int32)
        self.row_of[often] = np.arange(len(often))
        self.rows, self.sets = np.zeros((len(often), len(self.sizes)), dtype=np.uint8), self.sets.astype(np.int64)
        for i, c in enumerate(often.tolist()):
            self.rows[i, self.sets[self.ends[c] - self.held[c] : self.ends[c]]] = self.shingles_of[c]

    def best(self, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest similarity of each set with one of the index, and the last of these, -1 without any common shingle."""
        value, where = np.zeros(len(sizes)), np.full(len(sizes), -1, dtype=np.int64)
        if not len(self.shingles) or not len(hashes):
            return value, where
        at = np.searchsorted(self.shingles, hashes)
        at[at == len(self.shingles)] = 0
        known = self.shingles[at] == hashes
        owner, classes = np.repeat(np.arange(len(sizes)), sizes)[known], self.classes[at[known]]
        common = np.bincount(owner, minlength=len(sizes))
        few, many = (common > 0) & (common <= FEW), common > FEW
        if few.sum() >= many.sum():
            self._best_of_few(few, common, sizes, classes, value, where)
        else:
            many |= few
        if many.any():
            self._best_of_many(sizes, owner[many[owner]], classes[many[owner]], value, where)
        return value, where

    def bits(self) -> tuple[np.ndarray, ...]:
        """Which sets hold a class, as bits in the order of their sizes, later ones of a size first: 64 in a word, words without any left out.

        The sets by place, the number of words of all, whole rows of the classes that touch half of them (the last row has no bit),
        each class's row or -1, and the ends of its words, their places and bits.
        """
        if "bits" not in self.made:
            order = np.lexsort((-np.arange(len(self.sizes)), self.sizes))
            place, words = np.empty(len(order), dtype=np.int64), -(-len(order) // 64)
            place[order] = np.arange(len(order))
            at = place[self.sets]
            keys = np.repeat(np.arange(len(self.held)), self.held) * words + (at >> 6)
            by = np.argsort(keys, kind="stable")
            keys, bits = keys[by], np.left_shift(np.uint64(1), (at[by] & 63).astype(np.uint64))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            bits, (classes, at) = np.add.reduceat(bits, first), np.divmod(keys[first], words)
            touched = np.bincount(classes, minlength=len(self.held))
            whole = np.flatnonzero(touched * 2 >= words)
            row_of, rows = np.full(len(self.held), -1, dtype=np.int64), np.zeros((len(whole) + 1, words), dtype=np.uint64)
            row_of[whole] = np.arange(len(whole))
            apart = row_of[classes] < 0
            rows[row_of[classes[~apart]], at[~apart]] = bits[~apart]
            touched[whole] = 0
            self.made["bits"] = order, words, rows, row_of, np.cumsum(touched), touched, at[apart], bits[apart]
        return self.made["bits"]

    def _best_of_few(self, few: np.ndarray, common: np.ndarray, sizes: np.ndarray, classes: np.ndarray, value: np.ndarray, where: np.ndarray) -> None:
        """Sets with few common shingles: their rows of bits are added up by four binary digits for 64 sets of the index at once.

        Of the sets that have c shingles in common the smallest is most alike, the first bit of those with this sum.
        """
        picked = np.flatnonzero(few)
        picked = picked[np.argsort(-common[picked], kind="stable")]
        begins = np.cumsum(common) - common
        order, words, rows, row_of, ends, touched, places, bits = self.bits()
        most = max(1, WORDS // words)
        for k in range(0, len(picked), most):
            mine = picked[k : k + most]
            counts, starts, n = common[mine], begins[mine], sizes[mine]
            most_common = int(counts[0])
            digits = np.zeros((most_common.bit_length(), len(mine), words), dtype=np.uint64)
            carry, spare = np.empty_like(digits[0]), np.empty_like(digits[0])
            # Those with the most common shingles come first, so that each step takes a part from the front.
            live = np.searchsorted(-counts, -np.arange(most_common + 1), side="right").tolist()
            for j in range(most_common):
                end = live[j + 1]
                now = classes[starts[:end] + j]
                row = row_of[now]
                np.take(rows, row, axis=0, out=carry[:end], mode="wrap")
                apart = np.flatnonzero(row < 0)
                held = touched[now[apart]]
                span = np.arange(held.sum()) + np.repeat(ends[now[apart]] - np.cumsum(held), held)
                carry[np.repeat(apart, held), places[span]] = bits[span]
                for digit in digits[: (j + 1).bit_length(), :end]:
                    np.bitwise_and(digit, carry[:end], out=spare[:end])
                    np.bitwise_xor(digit, carry[:end], out=digit)
                    carry, spare = spare, carry
            best, found = np.zeros(len(mine)), np.full(len(mine), -1, dtype=np.int64)
            for c in range(1, most_common + 1):
                end = live[c]
                same = carry[:end]
                same.fill(np.uint64(2**64 - 1))
                for b, digit in enumerate(digits[:, :end]):
                    np.bitwise_and(same, digit if c >> b & 1 else np.invert(digit, out=spare[:end]), out=same)
                word = (same != 0).argmax(axis=1)
                held = same[np.arange(end), word]
                one = order[np.minimum(word * 64 + np.bitwise_count(~held & (held - np.uint64(1))), len(order) - 1)]
                alike = np.where(held != 0, c / (n[:end] + self.sizes[one] - c), 0.0)
                better = (alike > best[:end]) | (alike == best[:end]) & (held != 0) & (one > found[:end])
                best[:end][better], found[:end][better] = alike[better], one[better]
            value[mine], where[mine] = best, found

    def _best_of_many(self, sizes: np.ndarray, owner: np.ndarray, classes: np.ndarray, value: np.ndarray, where: np.ndarray) -> None:
        """Sets with many common shingles, one by one against all sets of the index."""
        number = len(self.held)
        keys, weights = np.unique(owner * number + classes, return_counts=True)
        owner, classes = np.divmod(keys, number)
        as_row = (self.row_of[classes] >= 0) & (weights == self.shingles_of[classes])
        order = np.argsort(owner * 2 + as_row, kind="stable")
        owner, classes, weights, as_row = owner[order], classes[order], weights[order], as_row[order]
        cuts, rows = np.searchsorted(owner * 2 + as_row, np.arange(len(sizes) * 2 + 1)).tolist(), self.row_of[classes].tolist()
        spans, ends = self.held[classes], self.ends[classes].tolist()
        starts = (self.ends[classes] - spans).tolist()
        others, held = self.sizes.astype(np.float32), -1
        score, share, likely = np.empty_like(others), np.empty_like(others), np.empty(len(others), dtype=bool)
        counts = {kind: np.empty(len(self.sizes), dtype=kind) for kind in (np.uint8, np.uint16, np.uint32)}
        for i in np.argsort(sizes, kind="stable").tolist():
            begin, middle, end = cuts[2 * i : 2 * i + 3]
            if begin == end:
                continue
            n = int(sizes[i])
            if n != held:
                held = n
                np.reciprocal(np.add(others, np.float32(n), out=share), out=share)
            common = counts[np.uint8 if n < 1 << 8 else np.uint16 if n < 1 << 16 else np.uint32]
            common.fill(0)
            if begin < middle:
                picked = [self.sets[starts[k] : ends[k]] for k in range(begin, middle)]
                np.add.at(common, np.concatenate(picked), np.repeat(weights[begin:middle].astype(common.dtype), spans[begin:middle]))
            for k in range(middle, end):
                np.add(common, self.rows[rows[k]], out=common)
            # c / (n + m) orders as the similarity does; single precision leaves a few, which are compared exactly.
            np.multiply(common, share, out=score)
            np.greater_equal(score, score.max() * np.float32(1 - 1e-6), out=likely)
            one = int(likely.argmax())
            if not likely[one + 1 :].any():
                c = int(common[one])
                value[i], where[i] = c / (n + int(self.sizes[one]) - c), one
                continue
            near = np.flatnonzero(likely)
            c = common[near].astype(np.int64)
            exact = c / (n + self.sizes[near] - c)
            k = np.flatnonzero(exact == exact.max())[-1]
            value[i], where[i] = exact[k], near[k]


def best_overlap(docs: DataFrame, against: DataFrame, key: str, other: str, indexed: int = INDEXED) -> DataFrame:
    """(key, best_overlap, nearest) of every key of ``docs``, exact; both sides are sets of hashes (``shingle_hashes``); 0 without any common shingle.

    The reference goes to the executors as an inverted index, so that nothing is emitted per common shingle. Of one of
    more than ``indexed`` shingles equal sets are taken once, documents with an equal set there are settled at once, and it
    is cut into blocks by a digest of its sets, one at a time; every block meets all other documents where they lie and each keeps
    its best, ties by the larger key. Null keys of the reference take no part.
    """
    against = materialize(against.where(F.col(other).isNotNull()).select(other, "hashes"))
    held = against.agg(F.sum(F.size("hashes"))).first()[0] or 0
    kinds = (dict(docs.dtypes)[key], dict(against.dtypes)[other])
    if held <= indexed:
        return _overlap_with_index(docs, against.toArrow(), key, kinds)[0]
    digests = [F.size("hashes").alias("_n"), F.xxhash64("hashes").alias("_x"), F.xxhash64(F.lit(1), "hashes").alias("_y")]
    same = ["_n", "_x", "_y"]
    distinct = materialize(against.select(other, *digests).groupBy(*same).agg(F.max(other).alias(other)))
    blocks = max(1, -(-(distinct.agg(F.sum("_n")).first()[0] or 0) // indexed))
    docs = materialize(docs.select(key, "hashes"))
    equal = materialize(docs.select(key, *digests).where("_n > 0").join(distinct, same).select(key, F.lit(1.0).alias("best_overlap"), F.col(other).alias("nearest")))
    rest = attach(docs, equal.select(key).where(F.col(key).isNotNull()).distinct(), [key], "left_anti", max_rows=1_000_000)
    best = equal
    for b in range(blocks):
        mine = lambda x: F.pmod(x, F.lit(blocks)) == b
        part = attach(against.where(mine(F.xxhash64("hashes"))), distinct.where(mine(F.col("_x"))).select(other), [other], "left_semi")
        found, shared = _overlap_with_index(rest, part.toArrow(), key, kinds)
        best = best.unionByName(materialize(found))
        shared.destroy()
    top = best.groupBy(key).agg(F.max(F.struct("best_overlap", "nearest")).alias("_b"))
    return top.select(key, "_b.best_overlap", "_b.nearest")


def _overlap_with_index(docs: DataFrame, rows: pa.Table, key: str, kinds: tuple[str, str]) -> tuple[DataFrame, Broadcast]:
    rows = rows.combine_chunks()
    names, name_type = rows.column(0).to_pylist(), rows.schema.field(0).type
    order = sorted(range(len(names)), key=names.__getitem__)
    names = [names[i] for i in order]
    lists = rows.column(1).take(pa.array(order, pa.int64()))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((names, _Index(sizes, np.asarray(lists.flatten(), dtype=np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = shared.value
        index = copy.copy(index)
        index.prepare()
        for whole in batches:
            for k in range(0, whole.num_rows, 2_000):
                batch = whole.slice(k, 2_000)
                sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                best, where = index.best(sizes, np.asarray(batch.column(1).flatten(), dtype=np.int64))
                nearest = pa.array([names[i] if i >= 0 else None for i in where.tolist()], name_type)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), nearest], names=[key, "best_overlap", "nearest"])

    return docs.select(key, "hashes").mapInArrow(run, f"`{key}` {kinds[0]}, best_overlap double, nearest {kinds[1]}"), shared


def near_duplicate_links(docs: DataFrame, key: str, text: str, size: int = 5, permutations: int = 64, number: int = 16, seed: int = 1729, threshold: float = 0.6, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(links between representatives of different texts, membership of keys in exact classes).

    Texts that normalise alike have one representative, the smallest key; only representatives are compared.
    Candidates come from bands of signatures, which find a pair at the threshold with a likelihood below one
    (0.9998 at 0.8, 0.64 at 0.5 with 16 bands of 4), or, ``exact``, from prefixes of rare shingles, which lose none.
    """
    copies = docs.select(F.col(key), F.sha2(normalised(F.col(text)), 256).alias("_d")).where("_d is not null")
    reps = copies.groupBy("_d").agg(F.min(key).alias("representative"))
    members = materialize(copies.join(reps, "_d").select(key, "representative"))
    # Texts stay where they lie if the few copies may be broadcast.
    distinct = attach(docs, members.where(F.col(key) != F.col("representative")).select(key), [key], "left_anti").where(F.col(text).isNotNull() & F.col(key).isNotNull())
    if exact:
        sets = shingle_hashes(distinct, key, text, size)
        return similar_pairs(sets, key, threshold).select(F.col(key).alias("a"), F.col("other").alias("b"), "jaccard"), members
    pairs = candidate_pairs(bands(signatures(distinct, key, text, size, permutations, seed), key, number), key)
    return verified(pairs, shingle_hashes(distinct, key, text, size), key, threshold), members
