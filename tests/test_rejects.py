import json
import random

from gleanstone.operators.rejects import classify_lines, line_accounts, rejected_lines

HEAD = "ticket_id,opened_at,question,answer,variant,duration_ms,rating"
T = "2026-01-05T10:00:00Z"
CSV = [
    (f"a,{T},why,because,x,12,up", None), (f'"a","{T}","why, so","say ""hi""","x","12.0","up"', None), (f'a,{T},"two\nlines",b,c, 5 ,', None),
    (f"a,{T},why,because,x,12", "column_count"), (f"a,{T},why,because,x,12,up,more", "column_count"), ("a", "column_count"),
    (f'a,{T},"why,because,x,12,up', "broken_quoting"), (f'a,{T},"why"x,because,x,12,up', "broken_quoting"), (f'a,{T},"say "hi" there",b,x,12,up', "broken_quoting"), (f'a,{T},why,b,x,12,up"', "broken_quoting"),
    (f",{T},why,because,x,12,up", "missing_value"), (f"a,{T},  ,because,x,12,up", "missing_value"), ("a,,why,because,x,12,up", "missing_value"),
    ("a,2026-02-30T10:00:00Z,why,b,x,12,up", "invalid_value"), ("a,2026-01-05,why,b,x,12,up", "invalid_value"), (f"a,{T},why,b,x,-1,up", "invalid_value"), (f"a,{T},why,b,x,1.5,up", "invalid_value"), (f"a,{T},why,b,x,abc,up", "invalid_value"),
    ("", None), (" \t", None), (None, None),
]
GOOD = {"request_id": "r", "ts_utc": T, "question": "why", "answer": "so", "latency_ms": 3}


def J(**changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v != "DROP"})


JSONL = [
    (J(), None), (J(latency_ms="7"), None), (J(latency_ms=7.0), None), (J(latency_ms=None), None), (J(latency_ms=" "), None), (J(answer=None, error_type="E"), None), ('{"a":1,"a":2,' + J()[1:], None), ("﻿" + J(), None),
    (J() + J(), "broken_json"), (J() + "]", "broken_json"), (J() + "}", "broken_json"), (J()[:-1], "broken_json"), (J()[:-1] + ",}", "broken_json"), (J().replace('"', "'"), "broken_json"), ("nope", "broken_json"), (J() + "," + J(), "broken_json"), ('{"a": NaN}', "broken_json"),
    ("[1]", "not_object"), ("17", "not_object"), ('"x"', "not_object"), ("null", "not_object"),
    (J(request_id="DROP"), "missing_value"), (J(question=""), "missing_value"), (J(ts_utc=None), "missing_value"), (J(answer=None), "missing_value"), (J(answer=" "), "missing_value"),
    (J(ts_utc="later"), "invalid_value"), (J(ts_utc=[T]), "invalid_value"), (J(question=17), "invalid_value"), (J(question={"text": "x"}), "invalid_value"), (J(latency_ms=True), "invalid_value"), (J(latency_ms=-1), "invalid_value"), (J(latency_ms=1.5), "invalid_value"), (J(latency_ms=[1]), "invalid_value"), (J(error_type="E"), "invalid_value"),
    ("", None), (None, None),
]
SCHEMA = "source_path string, source_format string, line_no bigint, line string, status string, _row string"


def lines(spark):
    rows = [("c.csv", "csv", 0, "﻿" + HEAD, "clash", "clash")] + [("c.csv", "csv", i + 1, l, "", "") for i, (l, _) in enumerate(CSV)]
    rows += [("j.jsonl", "jsonl", i, l, "", "") for i, (l, _) in enumerate(JSONL)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_reasons(spark):
    got = {(r["source_path"], r["line_no"]): r["reason"] for r in rejected_lines(lines(spark)).collect()}
    want = {("c.csv", i + 1): r for i, (_, r) in enumerate(CSV) if r} | {("j.jsonl", i): r for i, (_, r) in enumerate(JSONL) if r}
    assert got == want


def test_salted_headers_give_the_same(spark):
    df = lines(spark).select("source_path", "source_format", "line_no", "line")
    a = {tuple(r) for r in classify_lines(df).select("source_path", "line_no", "status", "reason").collect()}
    b = {tuple(r) for r in classify_lines(df, max_broadcast=0).select("source_path", "line_no", "status", "reason").collect()}
    assert a == b


def test_accounts_add_up_even_if_lines_come_twice(spark):
    df = lines(spark)
    counts = spark.createDataFrame([("c.csv", len(CSV)), ("j.jsonl", len(JSONL)), ("none.csv", 0)], "source_path string, lines_read bigint")
    for rows in (df, df.union(df)):
        assert all(r["adds_up"] for r in line_accounts(rows, counts).collect())


def test_empty(spark):
    assert rejected_lines(lines(spark).limit(0)).count() == 0


def test_header_order_and_missing_header(spark):
    rows = [("a", "csv", 0, "rating,duration_ms,variant,answer,question,opened_at,ticket_id"), ("a", "csv", 1, f"up,5,x,b,why,{T},a"), ("a", "csv", 2, f"up,5,x,b,why,{T},"), ("b", "csv", 1, f"up,5,x,b,why,{T},a")]
    got = {(r[0], r[1]): r[2] for r in rejected_lines(spark.createDataFrame(rows, "source_path string, source_format string, line_no bigint, line string")).collect()}
    assert got == {("a", 2): "missing_value", ("b", 1): "column_count"}
