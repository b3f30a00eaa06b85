import random

import pytest
from pyspark.sql import functions as F

from gleanstone.llm import layout_duplicates, quota_sample, top_per_group

SAME = [
    ["Hello there, it weighs 7.5 kg.", "hello   there it weighs 7.5 kg", "“HELLO THERE; IT WEIGHS 7.5 KG!”", "> Hello\nthere — it weighs 7.5 kg …", " Hello​ there, it weighs 7.5 kg."],
    ["Hello there, it weighs 75 kg."], ["there Hello, it weighs 7.5 kg."], ["Hello there, it weighs -7.5 kg."], ["Hello there, it weighs 7.5% kg."],
    ['{"a": "x y", "b": {"d": 1, "c": "K0-1"}}', '{ "B":{"C":"k0-1","D":1},\n"A":"X y" }', '* {"b": {"c": "K0-1", "d": 1}, "a": "x, y"}'],
    ['{"a": "K0-1", "b": "x y"}'],
    ["from: night desk\nto: day desk", "TO : day desk\r\n\r\nFROM : night desk", "from=night desk; to=day desk;", "to=day desk;  from=night desk."],
    ["from: day desk\nto: night desk"],
    ["Straße 5 gesperrt", "STRASSE 5 GESPERRT"],
    ["code lb.100/A"], ["code lb100A"], ["A1" + "b" * 200 + "-x"], ["A1" + "b" * 200 + "x"],
    ["the customers shipping address of the order as they told it to us: red"], ["customer shipping address line number two of the whole order as given: red; part: lid", "part: LID; customer shipping address line number two of the whole order as given: red"],
    ["x > 5"], ["x < 5", "X < 5."], ["> 7 lamps", "7 lamps"], ["C# and more", "c# and more!"], ["C and more"], ['{"price": 7.50, "b": [1e3]}', '{"B": [1E3], "Price": 7.50}', '{"b": ["1e3"], "price": "7.50"}'], ['{"price": 7.5, "b": [1e3]}'],
    ["-" * 100_000 + "dash"], ["a: b" + "\n " * 50_000 + "; _c: d"], ["1-" * 50_000 + "1"],
    [""], ["x" * 100_000 + " 1.5", "X" * 100_000 + "  1.5!"],
]


def rows(spark):
    out, n = [], 0
    for group in SAME:
        for text in group:
            out.append((f"r{n:03d}", text, "clash", 1))
            n += 1
    random.Random(4).shuffle(out)
    return spark.createDataFrame(out + out[:5] + [("null1", None, "", 0), ("null2", None, "", 0), (None, "Hello there, it weighs 7.5 kg.", "", 0)], "record_id string, input_text string, key string, salt int")


def expected():
    out, n = set(), 0
    for group in SAME:
        out |= {(f"r{n:03d}", f"r{n + i:03d}") for i in range(1, len(group))}
        n += len(group)
    return out


@pytest.mark.parametrize("hot", [None, 2, 0])
def test_layout_duplicates(spark, hot):
    got = layout_duplicates.copies(rows(spark), hot_rows=hot).collect()
    assert {tuple(r) for r in got} == expected() and len(got) == len(expected())


def test_blank_texts_are_copies_and_nulls_are_not(spark):
    df = spark.createDataFrame([("a", ""), ("b", " ?! "), ("c", None), ("d", None)], "record_id string, input_text string")
    assert [tuple(r) for r in layout_duplicates.copies(df).collect()] == [("a", "b")]
    assert layout_duplicates.copies(df.limit(0)).count() == 0
    kept = {r["record_id"]: r["duplicates_dropped"] for r in layout_duplicates.collapsed(df).collect()}
    assert kept == {"a": 1, "c": 0, "d": 0}


def brute_top(items, scores, n):
    best = {}
    for r, s in scores:
        if s is not None and r is not None:
            best[r] = max(s, best.get(r, s))
    out = set()
    for g in {g for g, _ in items if g is not None}:
        members = sorted({r for c, r in items if c == g and r in best}, key=lambda r: (-best[r], r))[:n]
        out |= {(g, r, i + 1) for i, r in enumerate(members)}
    return out


@pytest.mark.parametrize("heavy", [None, 20, 0])
def test_top_n(spark, heavy):
    rng = random.Random(5)
    items = [(rng.choice([None, "big", "big", *[f"g{i}" for i in range(40)]]), f"r{rng.randrange(300):03d}") for _ in range(900)] + [("g1", None)]
    scores = [(f"r{i:03d}", rng.choice([None, 1, 2, 3])) for i in range(280)] + [(None, 9)]
    scores += scores[:40]
    a = spark.createDataFrame([(*x, "clash") for x in items], "cluster_id string, record_id string, score string")
    b = spark.createDataFrame(scores, "record_id string, score int")
    got = {(r["cluster_id"], r["record_id"], r["rank"]) for r in top_per_group.top_n(a, b, heavy_rows=heavy).collect()}
    assert got == brute_top(items, scores, 3)
    assert top_per_group.top_n(a.limit(0), b, heavy_rows=heavy).count() == 0 and top_per_group.top_n(a, b.limit(0), heavy_rows=heavy).count() == 0


CANDIDATE = "window_id string, record_id string, cluster_id string, stratum string, cluster_size bigint, reasons array<string>"
STRATA = "window_id string, stratum string, target_share double, min_rows bigint, quota bigint, selected bigint"


def pool(spark, seed=6):
    rng = random.Random(seed)
    names = ["Error", " error", "ordinary", "rare", None]
    out = [("w1", f"r{i:04d}", None, rng.choices(names, [3, 3, 30, 1, 2])[0], rng.choice([None, 1, 3, 9]), rng.choice([None, [], ["x"], ["x", "y"]])) for i in range(1500)]
    out += out[:100] + [("w2", "r1", None, "rare", 1, []), (None, "r2", None, "rare", 1, []), ("w2", None, None, "rare", 1, [])]
    return spark.createDataFrame(out, CANDIDATE), out


GOALS = [("w1", "error", 0.3, 5, 60, 1), ("w1", "ORDINARY ", 0.6, 5, 120, None), ("w1", "rare", 0.1, 50, 90, 0), ("w1", "absent", None, None, 3, 0), ("w2", "rare", 1.0, 1, 1, 0), ("w3", "rare", 1.0, 1, 2, 0), ("w2", "none wanted", 0.0, 0, 0, 0), ("w2", None, 0.1, 1, 5, 0)]


def test_floors_hold_beside_quotas(spark):
    candidates = spark.createDataFrame([("w1", s, f"{s}{i}", ["a"], 1) for s in ("low", "high") for i in range(20)], "window_id string, stratum string, record_id string, reasons array<string>, cluster_size bigint")
    strata = spark.createDataFrame([("w1", "low", 0.1, 5, 2, 0), ("w1", "high", 0.9, 1, 8, 0)], STRATA)
    told = {r["stratum"]: r for r in quota_sample.report(candidates, strata).collect()}
    assert {s: (r["selected"], r["repaired"], r["floor_met"]) for s, r in told.items()} == {"low": (5, 3, True), "high": (8, 0, True)}
    picked = quota_sample.sample(candidates, strata).collect()
    assert sum(r["stratum"] == "low" for r in picked) == 5 and len(picked) == 13


def test_quota_sample(spark):
    candidates, rows = pool(spark)
    strata = spark.createDataFrame(GOALS, STRATA)
    there = {}
    for w, r, _, s, *_ in rows:
        if w and r and s:
            there.setdefault((w, s.strip().lower()), set()).add(r)
    picked = quota_sample.sample(candidates, strata).collect()
    assert len({(r["window_id"], r["stratum"], r["record_id"]) for r in picked}) == len(picked)
    for w, s, _, _, quota, _ in GOALS:
        if s:
            mine = {r["record_id"] for r in picked if (r["window_id"], r["stratum"]) == (w, s.strip().lower())}
            have = there.get((w, s.strip().lower()), set())
            assert mine <= have and len(mine) == min(quota, len(have))
    told = {(r["window_id"], r["stratum"]): r for r in quota_sample.report(candidates, strata).collect()}
    assert told["w1", "rare"]["gap"] == 90 - len(there["w1", "rare"]) > 0 and not told["w3", "rare"]["floor_met"]
    assert {tuple(r) for r in quota_sample.short_strata(candidates, strata).collect()} == {("w1", "rare"), ("w1", "absent"), ("w3", "rare")}
    again = quota_sample.sample(candidates.repartition(7), strata).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in picked}
    assert quota_sample.sample(candidates.limit(0), strata).count() == 0 and quota_sample.report(candidates, strata.limit(0)).count() == 0


def test_smallest_keys_are_taken(spark):
    candidates, _ = pool(spark)
    strata = spark.createDataFrame([("w1", "ordinary", 1.0, 1, 100, 0)], STRATA)
    everything = quota_sample.sample(candidates, spark.createDataFrame([("w1", "ordinary", 1.0, 1, 10_000, 0)], STRATA)).collect()
    some = quota_sample.sample(candidates, strata).collect()
    ordered = lambda rows: sorted((round(r["draw_key"], 9), r["record_id"]) for r in rows)
    assert ordered(some) == ordered(everything)[:100]


def cells_of(rows, **columns):
    import pandas as pd

    return pd.DataFrame([("w", s, b, r, n, None, share, float("nan")) for s, b, r, n, share in rows], columns=["window_id", "stratum", "band", "reasons", "n", "quota", "share", "total"]).assign(**columns)


POOL = [("x", "small", "one", 10, 0.5), ("x", "large", "one", 40, 0.5), ("y", "small", "none", 100, 0.5), ("y", "large", "one", 50, 0.5), ("x", "small", "none", 20, 0.5)]


def test_raking_meets_all_margins():
    out = quota_sample.rake(cells_of(POOL))
    # Without quotas the total is what the scarcer stratum allows at its share: 70 / 0.5.
    assert abs(out.groupby("stratum")["fitted"].sum()["x"] - 70) < 1e-6 and out["planned"].tolist() == [70] * 5
    assert abs(out.groupby("band")["fitted"].sum()["small"] - 140 * 130 / 220) < 1 and abs(out.groupby("reasons")["fitted"].sum()["one"] - 140 * 100 / 220) < 1
    given = quota_sample.rake(cells_of(POOL, quota=[30.0, 30.0, float("nan"), float("nan"), 30.0], share=[0.25, 0.25, 0.75, 0.75, 0.25], total=120.0))
    assert given.groupby("stratum")["planned"].first().to_dict() == {"x": 30, "y": 90} and abs(given.groupby("stratum")["fitted"].sum()["y"] - 90) < 1e-6


def test_shares_decide_where_no_quota_is_given_and_residuals_are_reported(spark):
    candidates, _ = pool(spark)
    strata = spark.createDataFrame([("w1", "ordinary", 0.8, 0, None, 0), ("w1", "rare", 0.1, 0, None, 0), ("w1", "error", 0.1, 0, None, 0), ("w1", "absent", None, 4, None, 0)], STRATA)
    told = {r["stratum"]: r for r in quota_sample.report(candidates, strata).collect()}
    assert told["rare"]["selected"] == told["error"]["selected"] == told["rare"]["available"] and told["ordinary"]["selected"] == 8 * told["rare"]["selected"] and abs(told["ordinary"]["reached_share"] - 0.8) < 1e-6
    assert told["absent"]["gap"] == 4 and not told["absent"]["floor_met"]
    rows = quota_sample.margins(candidates, strata).collect()
    assert {r["margin"] for r in rows} == {"stratum", "band", "reasons"} and all(abs(r["selected"] - r["aimed"] - r["residual"]) < 0.01 for r in rows)
    assert all(abs(r["residual"]) < 1 for r in rows if r["margin"] == "stratum") and all(abs(r["residual"]) < 40 for r in rows)


def test_columns_are_chosen_by_name(spark):
    df = rows(spark).withColumnRenamed("record_id", "id").withColumn("record_id", F.lit("clash"))
    assert layout_duplicates.copies(df, record_id="id").count() == len(expected())


def test_random_layouts_meet_and_random_contents_do_not(spark):
    rng = random.Random(9)
    words = "alpha beta gamma don't well-known K0-77 7.5 1,000 lb.42 12/B résumé größer".split()
    out, want = [], set()
    for b in range(60):
        base = [f"no{b}"] + [rng.choice(words) for _ in range(rng.randrange(3, 12))]
        first = f"r{b:03d}-0"
        out.append((first, " ".join(base) + "."))
        for k in range(1, 4):
            styled = [w.upper() if rng.random() < 0.3 else w.title() if rng.random() < 0.2 and w.isalpha() else w for w in base]
            text = "".join(rng.choice(["", "“", "(", "- "] if i == 0 else [""]) + w + rng.choice([" ", "  ", "\n", "　", ", ", "; ", " — ", "! "]) for i, w in enumerate(styled)) + rng.choice(["", "…", "?", " ”"])
            out.append((f"r{b:03d}-{k}", text))
            want.add((first, f"r{b:03d}-{k}"))
        other = list(base)
        i = next(i for i, w in enumerate(other) if i and w != other[i - 1])
        other[i - 1], other[i] = other[i], other[i - 1]
        out.append((f"x{b:03d}", " ".join(other)))
    df = spark.createDataFrame(out, "record_id string, input_text string")
    assert {tuple(r) for r in layout_duplicates.copies(df).collect()} == want
