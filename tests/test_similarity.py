import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanstone.config import Cluster
from gleanstone.operators import cluster, similarity
from gleanstone.operators.components import connected_components
from gleanstone.session import attach, numbered


@settings(max_examples=200, deadline=None)
@given(st.integers(1, similarity.PRIME - 1), st.integers(0, similarity.PRIME - 1))
def test_modular_product(a, x):
    assert int(similarity._mulmod(a, np.array([x], dtype=np.uint64))[0]) == a * x % similarity.PRIME


def grams(text, size=5):
    w = text.lower().split()
    return {" ".join(w)} if 0 < len(w) <= size else {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfgk" for b in ("ant", "ell", "ime", "ost", "und", "ay")]
    docs = []
    for f in range(12):
        base = [rng.choice(words) for _ in range(40)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(40)] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += [docs[0].upper(), docs[0] + "  ", "", "   ", "12 34", "one two", "One  two"]
    return [(f"d{i:03d}", t) for i, t in enumerate(docs)]


def test_signature_by_hand(spark):
    a, b = similarity.minhash_family(8, 5)
    text = "one two three four five six seven"
    base = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") % similarity.PRIME for g in grams(text)]
    want = [min((m * x + o) % similarity.PRIME for x in base) for m, o in zip(a, b)]
    df = spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "key string, text string")
    got = similarity.signatures(df, "key", "text", permutations=8, seed=5).collect()
    assert [r["key"] for r in got] == ["k"] and got[0]["signature"] == want


def test_clusters_against_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id string, text string")
    s = Cluster(jaccard_threshold=0.5)
    sets = {k: grams(t) for k, t in docs if any(c.isalpha() for c in t)}
    links = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.5}
    parent = {k: k for k, _ in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in sorted(links):
        parent[max(root(x), root(y))] = min(root(x), root(y))
    got = {r["doc_id"]: r["class_id"] for r in cluster.classes(df, s, exact=False).collect()}
    assert {r["doc_id"]: r["class_id"] for r in cluster.classes(df, s).collect()} == {k: root(k) for k in parent}
    assert set(got) == {k for k, _ in docs}
    together = {(x, y) for x in got for y in got if x < y and got[x] == got[y]}
    want = {(x, y) for x in parent for y in parent if x < y and root(x) == root(y)}
    assert together <= want and len(together & want) >= 0.95 * len(want)
    heads = cluster.cluster_records(df, None, s, "doc_id", "text").collect()
    assert sum(r["size"] for r in heads) == len(docs) and sorted(r["cluster_id"] for r in heads)[0] == "c-0001"


def test_precision_and_recall_on_planted_families(spark):
    """Ten families of five paraphrases and twenty singles, against all 2,415 pairs; shingles of three words, threshold 0.5."""
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfglmprst" for b in "aeiou" for c in ("nd", "st", "ll", "rk")]
    rows = []
    for f in range(10):
        base = [rng.choice(words) for _ in range(60)]
        for k in range(5):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(60)] = rng.choice(words)
            rows.append((f"f{f}-{k}", " ".join(text)))
    rows += [(f"s{i:02d}", " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    sets = {k: grams(t, 3) for k, t in rows}
    want = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.5}
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for exact, least in ((False, 0.9), (True, 1.0)):
        links, _ = similarity.near_duplicate_links(df, "doc_id", "text", size=3, permutations=64, number=16, seed=1729, threshold=0.5, exact=exact)
        got = {(r["a"], r["b"]) for r in links.collect()}
        print(f"exact {exact}: precision {len(got & want) / len(got):.3f}, recall {len(got & want) / len(want):.3f} of {len(want)} pairs")
        assert got <= want and len(got) >= least * len(want)


def test_blocks_lose_no_pair(spark):
    rows = [(0, 7, f"k{i:02d}") for i in range(40)] + [(1, 7, "k01"), (1, 7, "k02"), (1, 8, "x")]
    df = spark.createDataFrame(rows, "band int, bucket bigint, key string")
    pairs = {tuple(r) for r in similarity.candidate_pairs(df, "key", block=6).collect()}
    assert len(pairs) == 40 * 39 // 2 and similarity.candidate_pairs(df, "key", block=6).count() == len(pairs)


def test_best_overlap(spark):
    docs = corpus()
    left, right = docs[:20], docs[20:]
    a = similarity.shingle_hashes(spark.createDataFrame(left, "k string, text string"), "k", "text")
    b = similarity.shingle_hashes(spark.createDataFrame(right, "o string, text string"), "o", "text")
    joined = {r["k"]: (r["best_overlap"], r["nearest"]) for r in similarity.best_overlap(a, b, "k", "o", indexed=400).collect()}
    indexed = {r["k"]: (r["best_overlap"], r["nearest"]) for r in similarity.best_overlap(a, b, "k", "o").collect()}
    assert joined == indexed and similarity.best_overlap(a, b.limit(0), "k", "o").first()["best_overlap"] == 0
    got = {k: v for k, (v, _) in indexed.items()}
    for k, t in left:
        want = max((len(grams(t) & grams(u)) / len(grams(t) | grams(u)) for _, u in right if u.strip() and any(c.isalpha() for c in u)), default=0.0)
        assert abs(got[k] - want) < 1e-9


def passes(monkeypatch):
    """The calls of an index over documents, as they come."""
    seen, plain = [], similarity._overlap_with_index
    monkeypatch.setattr(similarity, "_overlap_with_index", lambda docs, rows, *rest: (seen.append(rows.num_rows), plain(docs, rows, *rest))[1])
    return seen


def test_a_reference_of_many_shingles_takes_one_pass(spark, monkeypatch):
    """600 sets of 1,000 shingles: the first of each is its own, all others are everyone's."""
    own = F.concat(F.array(F.col("id")), F.expr("sequence(1000000L, 1000998L)"))
    sets = spark.range(600).select(F.col("id").alias("o"), own.alias("hashes"))
    seen = passes(monkeypatch)
    docs = spark.createDataFrame([("a", [5, 1000001]), ("b", [1000000 + i for i in range(999)] + [7]), ("c", [-1]), ("d", [1000000])], "k string, hashes array<bigint>")
    got = {r["k"]: (r["best_overlap"], r["nearest"]) for r in similarity.best_overlap(docs, sets, "k", "o").collect()}
    assert got == {"a": (2 / 1000, 5), "b": (1.0, 7), "c": (0.0, None), "d": (1 / 1000, 599)} and seen == [600]


def test_equal_sets_of_a_reference_are_taken_once(spark, monkeypatch):
    """Forty copies of each text on both sides, cut into blocks by distinct sets; equal texts meet the last copy."""
    texts = [t for _, t in corpus() if any(c.isalpha() for c in t)]
    rows = lambda side, texts: similarity.shingle_hashes(spark.createDataFrame([(f"{side}{c:02d}-{i:02d}", t) for i, t in enumerate(texts) for c in range(40)], "k string, text string"), "k", "text")
    left, right = texts[::2], texts[1::2] + texts[:4:2]
    seen = passes(monkeypatch)
    docs = rows("l", left)
    got = {r["k"]: (r["best_overlap"], r["nearest"]) for r in similarity.best_overlap(docs, rows("r", right).withColumnRenamed("k", "o"), "k", "o", indexed=400).collect()}
    assert len(seen) <= -(-sum(len(g) for g in {frozenset(grams(t)) for t in right}) // 400) and sum(seen) <= len(right)
    assert len(got) == 40 * len(left)
    for i, t in enumerate(left):
        values = [len(grams(t) & grams(u)) / len(grams(t) | grams(u)) for u in right]
        nearest = f"r39-{max(j for j, v in enumerate(values) if v == max(values)):02d}" if max(values) else None
        assert {got[f"l{c:02d}-{i:02d}"] for c in range(40)} == {(max(values), nearest)}


def test_index_has_one_list_for_shingles_of_the_same_sets():
    sizes, rng = np.full(300, 40), np.random.default_rng(4)
    blocks = rng.integers(-(2**62), 2**62, (30, 20))
    picked = [rng.choice(30, 2, replace=False) for _ in range(300)]
    index = similarity._Index(sizes, np.concatenate([blocks[p].ravel() for p in picked]))
    assert len(index.held) == 30 and len(index.sets) == 600
    index.prepare()
    sets = [set(blocks[p].ravel().tolist()) for p in picked]
    mine = [sorted(set(blocks[p].ravel()[: 10 + i].tolist()) | {i}) for i, p in enumerate(picked[:30])] + [list(range(70_000)), blocks.ravel().tolist() + list(range(300))]
    value, where = index.best(np.array([len(m) for m in mine]), np.array([h for m in mine for h in m]))
    for m, v, w in zip(mine, value.tolist(), where.tolist()):
        every = [len(s & set(m)) / len(s | set(m)) for s in sets]
        assert v == max(every) and w == (max(i for i, x in enumerate(every) if x == v) if v else -1)


def test_sets_with_few_common_shingles_are_compared_by_bits(monkeypatch):
    """500 sets, many of the same size, of common, rare and single shingles, against 400 documents of up to 15 of them and others."""
    rng = np.random.default_rng(8)
    pick = lambda: np.unique(np.concatenate([rng.choice(20, rng.integers(0, 8), replace=False), rng.integers(20, 300, rng.integers(1, 12)), rng.integers(300, 20_000, rng.integers(0, 4))]))
    sets = [pick() for _ in range(500)]
    index = similarity._Index(np.array([len(s) for s in sets]), np.concatenate(sets))
    docs = [np.unique(np.concatenate([rng.choice(400, rng.integers(0, 16), replace=False), rng.integers(50_000, 60_000, rng.integers(1, 30))])) for _ in range(400)]
    monkeypatch.setattr(similarity, "WORDS", 100)
    monkeypatch.setattr(similarity._Index, "_best_of_many", None)
    value, where = index.best(np.array([len(m) for m in docs]), np.concatenate(docs))
    rows = index.made["bits"][2]
    assert 1 < len(rows) < len(index.held) and rows.shape[1] == 8
    held, found = [set(s.tolist()) for s in sets], 0
    for m, v, w in zip(docs, value.tolist(), where.tolist()):
        mine = set(m.tolist())
        every = [len(s & mine) / len(s | mine) for s in held]
        assert v == max(every) and w == (max(i for i, x in enumerate(every) if x == v) if v else -1)
        found += every.count(v) > 1
    assert found > 20


def test_texts_of_records_are_not_shuffled(spark, tmp_path):
    """Rows delivered twice are dropped by their overlaps, not by their texts."""
    import json

    from gleanstone.plans import stages

    rows = [(k, t) for k, t in corpus() if any(c.isalpha() for c in t)]
    spark.createDataFrame(rows + rows[:9], "record_id string, input_text string").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([(i, t, stages.GOLDEN_SOURCE) for i, (_, t) in enumerate(rows[:5])], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    best = stages._best_of_records(spark, str(tmp_path))
    plan = json.loads(best._jdf.queryExecution().optimizedPlan().toJSON())
    names = [x["class"].rpartition(".")[2] for x in plan]
    assert names.count("Aggregate") == 1 and names.index("Aggregate") < names.index("MapInArrow")
    got = [tuple(r) for r in best.select("record_id", "best_overlap").collect()]
    assert len(got) == len(set(got)) == len(rows) and {v for k, v in got if k in dict(rows[:5])} == {1.0}


def test_shingle_hashes_are_the_sets_of_windows(spark):
    docs = [(k, t) for k, t in corpus()] + [("x1", "Ünï cödé ünï cödé ünï cödé"), ("x2", None), ("x3", "a a a a a a a a a")]
    for size in (1, 2, 5):
        got = {r["k"]: r["hashes"] for r in similarity.shingle_hashes(spark.createDataFrame(docs, "k string, text string"), "k", "text", size).collect()}
        sets = {k: grams(t, size) for k, t in docs if t and any(c.isalpha() for c in t)}
        assert set(got) == set(sets) and all(h == sorted(h, key=lambda x: x % 2**64) and len(set(h)) == len(h) for h in got.values())
        for k in sets:
            assert len(got[k]) == len(sets[k])
        for x in sets:
            for y in sets:
                assert len(set(got[x]) & set(got[y])) == len(sets[x] & sets[y])


def test_similar_pairs_against_all_pairs(spark):
    docs = [(k, t + " " + "the same closing words in every text here") for k, t in corpus() if any(c.isalpha() for c in t)]
    sets = {k: grams(t) for k, t in docs}
    df = similarity.shingle_hashes(spark.createDataFrame(docs, "k string, text string"), "k", "text")
    for threshold in (0.05, 0.3, 0.6, 1.0):
        want = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in sets for y in sets if x < y}
        got = {(r["k"], r["other"]): r["jaccard"] for r in similarity.similar_pairs(df, "k", threshold).collect()}
        assert set(got) == {p for p, v in want.items() if v >= threshold - 1e-12} and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_a_long_chain_is_one_component(spark):
    rows = connected_components(spark.range(1 << 12).selectExpr("id as a", "id + 1 as b")).groupBy("component").count().collect()
    assert [tuple(r) for r in rows] == [(0, (1 << 12) + 1)]


def test_numbered_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, "clash") for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, v int, n string").drop("n").repartition(7)
    got = {(r["g"], r["v"]): r["n"] for r in numbered(df, [F.asc("v")], ["g"]).collect()}
    assert got == {(g, v): i + 1 for g in "ab" for i, v in enumerate(sorted(v for h, v, _ in rows if h == g))}
    every = {r["v"]: r["n"] for r in numbered(df, [F.desc("v")]).collect()}
    assert every == {v: i + 1 for i, v in enumerate(sorted((v for _, v, _ in rows), reverse=True))}
    assert numbered(df.limit(0), [F.asc("v")]).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)] + [(900, 900 + i) for i in range(1, 30)]
    parent = {}

    def root(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in edges:
        a, b = root(x), root(y)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: root(k) for k in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_attached_sides_are_copied_for_hot_keys_only(spark):
    big = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    small = spark.range(2_900).select(F.when(F.col("id") == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.repeat(F.lit("x"), 100).alias("text"))
    want = {(r["id"], r["key"], "x" * 100 if r["key"] and (r["key"] == "hot" or 0 < r["id"] < 2_900) else None) for r in big.collect()}
    for limits in ({}, {"max_bytes": 200_000}, {"max_rows": 100, "hot_rows": 50}, {"max_rows": 100, "hot_rows": 5_000}):
        out = attach(big, small, ["key"], **limits)
        assert {(r["id"], r["key"], r["text"]) for r in out.select("id", "key", "text").collect()} == want and out.count() == 3_000
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (not limits) and ("Generate" in plan) == (limits.get("hot_rows") == 50)


def test_pairs_come_once_and_are_not_shuffled(spark):
    rows = [(b, 7, f"k{i:02d}") for b in (0, 1) for i in range(30)] + [(0, 7, None), (1, 9, "k01"), (1, 9, "k40")]
    out = similarity.candidate_pairs(spark.createDataFrame(rows, "band int, bucket bigint, key string"), "key", block=6)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2 + 1 and ("k01", "k40") in got and all(a < b for a, b in got)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
