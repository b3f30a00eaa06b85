"""Rows that fail to parse: valid rows load, the others are set apart with the first reason.

Lines are read permissively under an explicit schema that keeps the raw text of
corrupt ones; what the reader found corrupt, or read too leniently, is then
reclassified by quoting, cell count and cast checks. Everything stays in JVM
expressions. CSV column orders differ by file: each line meets its file's
header in a join that broadcasts headers while they are few and salts the
lines of a file otherwise, as one file may hold a third of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.functions.calendar import real_canonical
from gleanstone.functions.text import SPACE, first_of, is_blank
from gleanstone.session import BROADCAST_ROWS, where_computed

UNPARSED = ("broken_quoting", "column_count", "broken_json", "not_object")
INVALID = ("missing_value", "invalid_value")
LINE = ("source_path", "source_format", "line_no", "line")
TICKET_COLUMNS = 7
SALTS = 32

_CELL = r'(?:"(?:[^"]|"")*+"|[^",\r\n][^",]*+|)'
#: A record of RFC 4180: quotes only around whole cells, doubled inside them.
WELL_QUOTED = rf"^{_CELL}(?:,{_CELL})*+$"
EACH_CELL = rf",({_CELL})"
NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _csv_cells(line: Column) -> Column:
    """Cells of a well-quoted record, unquoted; the exact reading used where the permissive one gave up."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(EACH_CELL), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def _whole(number: Column) -> Column:
    """A whole number >= 0 as text, outer blanks allowed."""
    t = F.regexp_replace(number, f"^{SPACE}+|{SPACE}+$", "")
    x = t.try_cast("double")
    exact = t.rlike(r"^[+-]?\d+(?:\.0*)?$|^[+-]?\.0+$|[eE]")
    return F.coalesce(t.rlike(NUMERIC) & exact & (x >= 0) & (x == F.floor(x)), F.lit(False))


def _headers(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("line", r"^\x{FEFF}", "")
    cells = F.transform(_csv_cells(F.regexp_replace(text, r"[\r\n]+$", "")), lambda c: F.trim(c))
    heads = lines.where((F.col("source_format") == "csv") & (F.col("line_no") == 0))
    return heads.select("source_path", cells.alias("_header")).groupBy("source_path").agg(F.min("_header").alias("_header"))


def _with_headers(lines: DataFrame, max_broadcast: int) -> DataFrame:
    heads = _headers(lines)
    if heads.limit(max_broadcast + 1).count() <= max_broadcast:
        return lines.join(F.broadcast(heads), "source_path", "left")
    salted = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_salt", F.pmod("line_no", F.lit(SALTS)).cast("int")).join(salted, ["source_path", "_salt"], "left").drop("_salt")


def _csv_reason(lines: DataFrame) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(TICKET_COLUMNS)) + ", _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "emptyValue": "", "nullValue": "\x00"}
    df = lines.withColumn("_text", F.regexp_replace("line", r"[\r\n]+$", ""))
    df = df.withColumns({"_row": F.from_csv("_text", schema, options), "_quoted": F.col("_text").rlike(WELL_QUOTED)})
    read_well = F.col("_row._corrupt").isNull() & (F.size("_header") == TICKET_COLUMNS)
    permissive = F.array(*[F.coalesce(F.col(f"_row.c{i}"), F.lit("")) for i in range(TICKET_COLUMNS)])
    df = df.withColumn("_cells", F.when(~F.col("_quoted"), None).when(read_well, permissive).otherwise(_csv_cells(F.col("_text"))))
    cell = lambda name: F.get("_cells", F.array_position("_header", F.lit(name)).cast("int") - 1)
    ticket, opened, question, duration = map(cell, ("ticket_id", "opened_at", "question", "duration_ms"))
    df = df.withColumns({"_ticket": ticket, "_opened": opened, "_question": question, "_duration": duration})
    missing = is_blank(F.col("_ticket")) | is_blank(F.col("_opened")) | is_blank(F.col("_question"))
    return df.withColumn("reason", first_of(
        (is_blank(F.col("line")), None),
        (~F.col("_quoted"), "broken_quoting"),
        (F.size("_cells") != F.coalesce(F.size("_header"), F.lit(-1)), "column_count"),
        (missing, "missing_value"),
        (~real_canonical(F.col("_opened")) | ~(is_blank(F.col("_duration")) | _whole(F.col("_duration"))), "invalid_value"),
    )).drop("_text", "_row", "_quoted", "_cells", "_ticket", "_opened", "_question", "_duration")


JSON_SCHEMA = "request_id string, ts_utc string, question string, answer string, error_type string, latency_ms string, _corrupt string"
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedControlChars": "false"}


def _json_reason(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("line", r"^\x{FEFF}", "")
    df = lines.withColumn("_text", text)
    # A reader stops after the first value. In both wrappings at once only exactly one value is well formed.
    listed, named = F.concat(F.lit("["), F.col("_text"), F.lit("]")), F.concat(F.lit('{"v":'), F.col("_text"), F.lit("}"))
    df = df.withColumns({"_row": F.from_json("_text", JSON_SCHEMA, JSON_OPTIONS), "_listed": F.try_parse_json(listed), "_named": F.try_parse_json(named)})
    again = F.col("_listed").isNull() & F.col("_row._corrupt").isNull()
    df = df.withColumns({
        "_twins": F.when(again, F.from_json(listed, "array<map<string,string>>", JSON_OPTIONS)),
        "_wrapped": F.when(again, F.from_json(named, "v map<string,string>, _corrupt string", JSON_OPTIONS)),
    })
    single = F.col("_listed").isNotNull() & F.col("_named").isNotNull() & F.try_variant_get("_listed", "$[1]", "variant").isNull()
    # Objects that repeat a name are no variant; the permissive reader takes them.
    doubled = again & (F.size("_twins") == 1) & F.col("_wrapped.v").isNotNull() & F.col("_wrapped._corrupt").isNull() & F.col("_text").rlike(r"^\s*\{")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_listed", path, "variant"))
    df = df.withColumns({"_one": single | F.coalesce(doubled, F.lit(False)), "_object": F.coalesce(kind("$[0]").startswith("OBJECT"), doubled, F.lit(False))})
    row = {k: F.col(f"_row.{k}") for k in ("request_id", "ts_utc", "question", "answer", "error_type", "latency_ms")}
    blank = {k: is_blank(v) for k, v in row.items()}
    is_text = lambda k: F.coalesce(kind(f"$[0].{k}") == "STRING", ~row[k].rlike(r"^\s*[\[{]"))
    boolean = F.coalesce(kind("$[0].latency_ms") == "BOOLEAN", F.lit(False))
    return df.withColumn("reason", first_of(
        (is_blank(F.col("line")), None),
        (~F.col("_one"), "broken_json"),
        (~F.col("_object"), "not_object"),
        (blank["request_id"] | blank["ts_utc"] | blank["question"] | (blank["answer"] & blank["error_type"]), "missing_value"),
        (~is_text("ts_utc") | ~real_canonical(row["ts_utc"]) | ~is_text("question") | boolean | ~(blank["latency_ms"] | _whole(row["latency_ms"])) | (~blank["answer"] & ~blank["error_type"]), "invalid_value"),
    )).drop("_text", "_row", "_listed", "_named", "_twins", "_wrapped", "_one", "_object")


def classify_lines(lines: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Every line with ``status`` (header, blank, row, unparsed, invalid) and, where it failed, ``reason``.

    Null and blank lines are blank; a file without header has only ``column_count`` failures besides
    broken quoting; a line delivered twice comes out twice. Other columns stay, save ``_`` names.
    """
    csv = _csv_reason(_with_headers(lines.where("source_format = 'csv'"), max_broadcast)).drop("_header")
    out = csv.unionByName(_json_reason(lines.where("source_format = 'jsonl'")))
    status = first_of(
        ((F.col("source_format") == "csv") & (F.col("line_no") == 0), "header"),
        (is_blank(F.col("line")), "blank"),
        (F.col("reason").isin(*UNPARSED), "unparsed"),
        (F.col("reason").isin(*INVALID), "invalid"),
        otherwise="row",
    )
    out = out.withColumn("status", status)
    return out.withColumn("reason", F.when(F.col("status") != "header", F.col("reason")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(source_path, line_no, reason) of every failed line, once."""
    failed = where_computed(classify_lines(lines.select(*LINE)), F.col("status").isin("unparsed", "invalid"))
    return failed.select("source_path", "line_no", "reason").distinct()


def line_accounts(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Per source: lines read as stated and as found, blank, unparsed, invalid and loaded, and whether they add up."""
    # A line delivered twice counts once.
    found = where_computed(classify_lines(lines.select(*LINE)), F.col("status") != "header").dropDuplicates(["source_path", "line_no"])
    number = lambda s: F.count_if(F.col("status") == s)
    sums = found.groupBy("source_path").agg(F.count("*").alias("lines_found"), number("blank").alias("blank_lines"), number("unparsed").alias("unparsed"), number("invalid").alias("invalid"), number("row").alias("loaded"))
    out = counts.select("source_path", "lines_read").dropDuplicates(["source_path"]).join(sums, "source_path", "left").na.fill(0)
    return out.withColumn("adds_up", F.col("lines_read") == F.col("blank_lines") + F.col("unparsed") + F.col("invalid") + F.col("loaded"))
