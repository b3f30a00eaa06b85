"""Whole-file sources: digests, sidecars, golden cases, windows."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.errors import SourceError
from gleanstone.functions.text import is_blank
from gleanstone.sources.lines import read_jsonl

CHUNK = 1 << 20


def source_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as source:
        while block := source.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()


def load_sidecar(spark: SparkSession, path: str, text_field: str = "text") -> DataFrame:
    """(text_sha256, text), one row per text; a bad line or one without text refuses the file."""
    lines = read_jsonl(spark, path).where("not is_blank")
    rows = lines.select("error_type", F.try_variant_get("payload", f"$['{text_field}']", "string").alias("text"))
    if rows.where(F.col("error_type").isNotNull() | is_blank(F.col("text"))).limit(1).count():
        raise SourceError(f"{path}: a line has no {text_field}")
    return rows.select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])


def load_goldens(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases of a YAML list: id, tags, input, criteria, notes."""
    import yaml

    cases = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    if not isinstance(cases, list):
        raise SourceError(f"{path} is no list of cases")
    rows, seen = [], set()
    for case in cases:
        if not isinstance(case, dict) or not str(case.get("id", "")).strip() or not str(case.get("input", "")).strip():
            raise SourceError(f"{path}: a case needs id and input")
        if case["id"] in seen:
            raise SourceError(f"{path}: {case['id']} is there twice")
        seen.add(case["id"])
        rows.append((str(case["id"]), list(case.get("tags") or []), str(case["input"]), list(case.get("criteria") or []), str(case.get("notes") or "")))
    return spark.createDataFrame(rows, "id string, tags array<string>, input string, criteria array<string>, notes string")


def list_windows(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders that hold a manifest, the sign of a committed window."""
    from gleanstone.sinks import storage

    return [n for n in storage.folders(spark, folder) if storage.exists(spark, f"{folder.rstrip('/')}/{n}/manifest.json")]
