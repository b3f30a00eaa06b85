import json

import pytest

from gleanstone import config
from gleanstone.errors import ConfigError, SourceError
from gleanstone.operators import ingest, redact
from gleanstone.sources import files, lines, mapping

CHAT = mapping.load("chat_jsonl")


def chat(i, **changes):
    row = {"id": f"r{i}", "created": 1767607200, "messages": [{"role": "user", "content": "old"}, {"role": "user", "content": f"Question {i}?"}, {"role": "assistant", "content": "Answer."}], "usage": {"prompt_tokens": 5}, "latency_ms": 7}
    return json.dumps({k: v for k, v in {**row, **changes}.items() if v != "DROP"})


ROWS = [
    chat(1), "", "nope", "[1]", chat(1, id="r1b", messages=[{"role": "user", "content": "  question   1? "}, {"role": "assistant", "content": "x"}]),
    chat(2, created="2026-01-05T10:00:00"), chat(3, latency_ms=True), chat(4, messages=[{"role": "user", "content": "q"}]), chat(5, error="boom"),
    chat(6, id=17), chat(7, id=" "), chat(8, created=1767607200123), chat(9, messages=[{"role": "user", "content": [{"type": "text", "text": "part a"}, {"type": "image"}, {"type": "text", "text": "part b"}]}, {"role": "assistant", "content": "x"}]),
    chat(10, messages=[{"role": "user", "content": "x" * 50}, {"role": "assistant", "content": "y"}]), chat(11, usage={"prompt_tokens": "12"}), chat(12, usage={"prompt_tokens": 1.5}), chat(13, created=-4),
]


def test_every_line_is_accounted_for(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_bytes("﻿".encode() + "\n".join(ROWS).encode() + b"\n")
    cfg = config.Config(ingest=config.Ingest(max_text_chars=20))
    records, failures, counts = ingest.ingest(lines.read_source(spark, str(path), "jsonl"), CHAT, cfg)
    got = {r["record_id"]: r for r in records.collect()}
    assert set(got) == {"r1", "17", "r8", "r9", "r10", "r11"}
    assert got["r8"]["ts_utc"] == "2026-01-05T10:00:00Z" and got["r11"]["input_tokens"] == 12
    assert got["r9"]["input_text"] == "part a\npart b" and got["r10"]["input_text"] == "x" * 20 + " …[TRUNCATED]"
    why = {r["line_no"]: (r["error_type"], r["detail"]) for r in failures.collect()}
    assert why == {3: ("line_parse", "not one JSON value"), 4: ("line_parse", "not an object"), 6: ("field_type", "ts_utc"), 7: ("field_type", "latency_ms"), 8: ("invalid_record", "outcome"), 9: ("invalid_record", "outcome"), 11: ("missing_field", "record_id"), 16: ("field_type", "input_tokens"), 17: ("field_type", "ts_utc")}
    c = counts.first()
    assert (c["lines"], c["blank"], c["unparsed"], c["rows"], c["invalid"], c["written"], c["duplicates"]) == (17, 1, 2, 14, 7, 6, 1)
    assert c["lines"] == c["rows"] + c["blank"] + c["unparsed"] and c["rows"] == c["written"] + c["invalid"] + c["duplicates"]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('ticket_id,opened_at,question,answer,variant,duration_ms,rating\na,2026-01-05T10:00:00Z,"two\nlines",yes,,5,up\n\nb,2026-01-05T10:00:00Z,why,,,,\nc,2026-01-05T10:00:00Z,short,ok\nd,1,2,3,4,5,6,7,8\n')
    got = {r["line_no"]: r for r in lines.read_csv(spark, str(path)).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and got[3]["is_blank"] and got[6]["error_type"] == "line_parse"
    records, failures, _ = ingest.ingest(lines.read_csv(spark, str(path)), mapping.load("tickets_csv"))
    assert {r["record_id"]: r["input_text"] for r in records.collect()} == {"a": "two\nlines", "c": "short"}
    assert [(r["line_no"], r["error_type"]) for r in failures.orderBy("line_no").collect()] == [(4, "invalid_record"), (6, "line_parse")]
    path.write_text("a,a\n1,2\n")
    with pytest.raises(SourceError):
        lines.csv_header(spark, str(path))
    with pytest.raises(SourceError):
        lines.read_source(spark, str(path), "xml")


def test_sidecar_and_existing(spark, tmp_path):
    import hashlib

    side = tmp_path / "side.jsonl"
    side.write_text('{"text": "hello there"}\n\n{"text": "other"}\n{"text": "other"}\n')
    texts = files.load_sidecar(spark, str(side))
    assert texts.count() == 2
    m = mapping.parse('schema_version=1\nname="x"\nsource_format="jsonl"\n[fields]\nrecord_id={path="i"}\nts_utc={path="t"}\noutput_text={path="o"}\n[sidecar]\nkey_field="h"\ntext_field="text"\ntarget="input_text"\n')
    log = tmp_path / "e.jsonl"
    rows = [{"i": "a", "t": "2026-01-05T10:00:00Z", "o": "x", "h": hashlib.sha256(b"hello there").hexdigest()}, {"i": "b", "t": "2026-01-05T10:00:00Z", "o": "x", "h": "0"}]
    log.write_text("\n".join(map(json.dumps, rows)))
    records, failures, _ = ingest.ingest(lines.read_jsonl(spark, str(log)), m, sidecar=texts)
    assert [r["input_text"] for r in records.collect()] == ["hello there"]
    assert failures.first()["error_type"] == "sidecar_miss"
    from gleanstone.functions.text import fingerprint
    from pyspark.sql import functions as F

    seen = spark.createDataFrame([("Hello  THERE ",)], "t string").select(fingerprint(F.col("t")).alias("fingerprint"))
    assert ingest.ingest(lines.read_jsonl(spark, str(log)), m, sidecar=texts, existing=seen)[0].count() == 0
    side.write_text("{}")
    with pytest.raises(SourceError):
        files.load_sidecar(spark, str(side))


def test_paths_and_coercion(spark):
    from pyspark.sql import functions as F

    from gleanstone.functions import coerce, extract

    row = F.parse_json(F.lit('{"a": {"b": [10, {"c": "x"}, 30], "0": "key"}, "l": ["p", 1, "q"], "t": "yes", "v": [{"criterion": "k", "ok": 1}], "w": {"k": true}, "n": null}'))
    df = spark.range(1).withColumn("r", row)
    at = lambda p: F.try_variant_get(extract.at_path(F.col("r"), p), "$", "string")
    got = df.select(at("a.b.-1").alias("last"), at("a.b.1.c").alias("deep"), at("a.0").alias("key"), at("a.b.9").alias("none"), extract.join_text(extract.at_path(F.col("r"), "l")).alias("joined")).first()
    assert tuple(got) == ("30", "x", "key", None, "p\nq")
    v = lambda p: extract.at_path(F.col("r"), p)
    got = df.select(coerce.boolean(v("t"))[0].alias("t"), coerce.verdicts(v("v"), "criterion", "ok")[0].alias("v"), coerce.verdicts(v("w"))[0].alias("w"), coerce.absent(v("n")).alias("n"), coerce.integer(v("t"))[1].alias("bad")).first()
    assert got["t"] is True and got["v"][0]["passed"] is True and got["w"][0]["criterion"] == "k" and got["n"] and not got["bad"]
    with pytest.raises(ConfigError):
        extract.at_path(F.col("r"), "a..b")


def test_settings(tmp_path):
    good = tmp_path / "c.toml"
    good.write_text("[cluster]\nbands = 8\n[score]\nnon_ascii_threshold = 0.5\n")
    assert config.load(good).cluster.bands == 8
    for text in ("[nope]\na=1", "[cluster]\nbands=7", "[cluster]\nbands=true", "[score]\nnon_ascii_threshold=1", "[score]\noutlier_percentile=100", "[select]\nquotas={error=1}"):
        good.write_text(text)
        with pytest.raises(ConfigError):
            config.load(good)
    for text in ("schema_version=2", 'schema_version=1\nsource_format="csv"', 'schema_version=1\nsource_format="csv"\n[fields]\nzzz={path="a"}'):
        with pytest.raises(ConfigError):
            mapping.parse(text)


PII = [
    ("mail bob.o'hara+x@mail.example.org, now", ["EMAIL"]), ("https://x.example/u/a@b.example/p", ["EMAIL"]), ("card 4242 4242 4242 4242 ok", ["CARD"]), ("card 4242.4242.4242.4242", ["CARD"]), ("order 4242424242424241", []),
    ("id 907060504030201000102030", []), ("iban DE89 3704 0044 0532 0130 00.", ["IBAN"]), ("ssn 123-45-6789", ["SSN"]), ("ip 10.20.30.41.", ["IPV4"]), ("v 1.2.3.4.5", []), ("on 2026-01-05", []), ("on 05/01/2026", []),
    ("call +44 20 7946 0958", ["PHONE"]), ("call (555) 010-9999", ["PHONE"]), ("call 020 7946 0958", ["PHONE"]), ("invoice 9911-2233", []), ("at 221B Baker Street now", ["ADDRESS"]), ("at 7 Rue Lafayette", ["ADDRESS"]), ("ask Dr. Susan Calvin", ["NAME"]), ("a Dr Pepper please", []),
    ("[EMAIL_1] and [NAME_2]", []), ("", []), (None, None),
]


def test_spans_and_tokens(spark):
    from pyspark.sql import functions as F

    from gleanstone.functions import pii

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PII)], "line_no int, input_text string")
    got = {r["line_no"]: r["s"] for r in df.select("line_no", pii.find_spans(F.col("input_text")).alias("s")).collect()}
    for i, (text, want) in enumerate(PII):
        assert (None if got[i] is None else [s["pii_class"] for s in got[i]]) == want, text
        assert all(text[s["start"] : s["stop"]] == s["value"] for s in got[i] or [])
    texts = [("x@y.example 1", "Mr Smith"), ("X@Y.example and z@y.example", None), ("mr smith no", "ask Mr Smith")]
    df = spark.createDataFrame([(i, a, b, [("knows Dr Who", True)]) for i, (a, b) in enumerate(texts)], "line_no int, input_text string, output_text string, judge_verdicts array<struct<criterion:string,passed:boolean>>")
    out, report = redact.redact(df, fields=("input_text", "output_text"))
    rows = out.orderBy("line_no").collect()
    assert [(r["input_text"], r["output_text"]) for r in rows] == [("[EMAIL_1] 1", "[NAME_2]"), ("[EMAIL_1] and [EMAIL_2]", None), ("mr smith no", "ask [NAME_2]")]
    assert rows[0]["judge_verdicts"][0]["criterion"] == "knows [NAME_1]"
    assert {r["pii_class"]: (r["found"], r["distinct_values"]) for r in report.collect()} == {"EMAIL": (3, 2), "NAME": (5, 2)}
    redact.guard(out, ("input_text", "output_text"))
    with pytest.raises(redact.LeakError, match="EMAIL in input_text"):
        redact.guard(df, ("input_text", "output_text"))
    assert redact.redact_text(spark, "write to a@b.example") == "write to [EMAIL_1]"
