"""A window: batches of records with a manifest as commit marker, and artefacts beside them, on any file system.

A run writes its records and failures into a batch folder of its own; they belong to the window only when the
manifest, replaced in one step, lists the batch. What a broken run left behind is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.errors import WindowError
from gleanstone.functions.text import fingerprint
from gleanstone.operators import redact
from gleanstone.schema import FIELDS, RECORD, record_fault
from gleanstone.sinks import storage

SCHEMA_VERSION = 2
COUNTERS = ("lines", "blank", "unparsed", "invalid", "rows", "written", "duplicates", "truncated")


def check_sums(counts: dict[str, int]) -> None:
    if counts["lines"] != counts["rows"] + counts["blank"] + counts["unparsed"]:
        raise WindowError("lines aren't rows, blank and unparsed ones together")
    if counts["rows"] != counts["written"] + counts["duplicates"] + counts["invalid"]:
        raise WindowError("rows aren't written, duplicate and invalid ones together")


class Window:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self.batch = f"batch-{uuid.uuid4().hex[:12]}"

    @property
    def name(self) -> str:
        return self.folder.rsplit("/", 1)[-1]

    def at(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def check_writable(self, append: bool) -> None:
        there = self.manifest() is not None
        if there and not append:
            raise WindowError(f"{self.name} is there already; append to it or choose another name")
        if append and not there:
            raise WindowError(f"{self.name} is not there to be appended to")

    def append_records(self, records: DataFrame, guarded: bool = True) -> None:
        """All or nothing: the guard runs over the whole batch before the first row is written, and ``commit`` makes it count."""
        if guarded:
            redact.guard(records)
        storage.private_folder(self.spark, self.folder)
        records.select(*FIELDS).write.mode("errorifexists").parquet(self.at("records", self.batch))

    def records(self) -> DataFrame:
        """The records of all committed batches; a single invalid one refuses the read."""
        batches = (self.manifest() or {}).get("batches", [])
        if not batches:
            raise WindowError(f"{self.name} has no records")
        df = self.spark.read.schema(RECORD).parquet(*[self.at("records", b) for b in batches])
        if df.where(record_fault().isNotNull()).limit(1).count():
            raise WindowError(f"{self.name} holds an invalid record")
        return df

    def fingerprints(self) -> DataFrame:
        return self.records().select(fingerprint(F.col("input_text")).alias("fingerprint"))

    def append_errors(self, failures: DataFrame) -> None:
        failures.write.mode("errorifexists").parquet(self.at("errors", self.batch))

    def errors(self) -> DataFrame:
        return self.spark.read.parquet(*[self.at("errors", b) for b in (self.manifest() or {}).get("batches", [])])

    def write_artefact(self, name: str, df: DataFrame) -> None:
        """Derived results replace earlier ones."""
        df.write.mode("overwrite").parquet(self.at(name))

    def artefact(self, name: str, command: str) -> DataFrame:
        if not storage.exists(self.spark, self.at(name)):
            raise WindowError(f"{self.name} has no {name}; run {command} first")
        return self.spark.read.parquet(self.at(name))

    def write_text(self, name: str, text: str) -> None:
        storage.write_text(self.spark, self.at(name), text)

    def manifest(self) -> dict | None:
        if not storage.exists(self.spark, self.at("manifest.json")):
            return None
        data = json.loads(storage.read_text(self.spark, self.at("manifest.json")))
        if data.get("schema_version") != SCHEMA_VERSION:
            raise WindowError(f"the manifest has schema version {data.get('schema_version')!r}")
        if missing := {"sources", "batches", "counts", "errors_by_type", "redactions"} - set(data):
            raise WindowError(f"the manifest lacks {', '.join(sorted(missing))}")
        return data

    def refuse_again(self, path: str, sha256: str) -> None:
        for source in (self.manifest() or {"sources": []})["sources"]:
            if (source["path"], source["sha256"]) == (path, sha256):
                raise WindowError(f"{path} was ingested already")

    def commit(self, source: dict, counts: dict[str, int], errors_by_type: dict[str, int], redactions: dict[str, int], dedupe: bool) -> dict:
        """Adds a source and its batch to the manifest, which makes them count: counters add up, the sums are checked, the file is replaced at once."""
        check_sums(counts)
        old = self.manifest() or {"sources": [], "batches": [], "counts": dict.fromkeys(COUNTERS, 0), "errors_by_type": {}, "redactions": {}, "dedupe_enabled": True}
        add = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in sorted({*a, *b})}
        new = {
            "schema_version": SCHEMA_VERSION, "window": self.name, "sources": [*old["sources"], source], "batches": [*old["batches"], self.batch],
            "counts": add(old["counts"], {k: counts[k] for k in COUNTERS}), "errors_by_type": add(old["errors_by_type"], errors_by_type),
            "redactions": add(old["redactions"], redactions), "dedupe_enabled": bool(old["dedupe_enabled"] and dedupe),
        }
        check_sums(new["counts"])
        self.write_text("manifest.json", json.dumps(new, indent=2, sort_keys=True))
        self.batch = f"batch-{uuid.uuid4().hex[:12]}"
        return new


def table_report(title: str, rows: list[dict]) -> str:
    """A small aggregate as a Markdown table; reports name counts, never texts of records."""
    if not rows:
        return f"# {title}\n\nNothing to report.\n"
    names = list(rows[0])
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def write_report(window: Window, name: str, title: str, df: DataFrame) -> None:
    """Renders a report of few rows (counts per signal, stratum, reason and the like)."""
    window.write_text(f"{name}.md", table_report(title, [r.asDict() for r in df.collect()]))
