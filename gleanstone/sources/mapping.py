"""Field mappings: which path of a source row becomes which field of the record, read from strict TOML."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from gleanstone.errors import ConfigError
from gleanstone.functions.extract import EXTRACTORS
from gleanstone.schema import FIELDS

REQUIRED = ("record_id", "ts_utc", "input_text")
FORMATS = ("jsonl", "csv")


@dataclass(frozen=True)
class FieldSpec:
    path: str
    extractor: str = "identity"
    criterion_key: str = "criterion"
    passed_key: str = "passed"


@dataclass(frozen=True)
class SidecarSpec:
    """Texts kept apart: ``target`` is filled by the text whose SHA-256 the row holds at ``key_field``."""

    target: str
    key_field: str
    text_field: str = "text"


@dataclass(frozen=True)
class FieldMapping:
    name: str
    source_format: str
    fields: dict[str, FieldSpec]
    defaults: dict[str, object] = field(default_factory=dict)
    naive_is_utc: bool = False
    expect_output_json: bool = False
    sidecar: SidecarSpec | None = None
    sha256: str = ""


def _only(where: str, data: dict, *allowed: str) -> None:
    if unknown := set(data) - set(allowed):
        raise ConfigError(f"{where}: unknown keys {', '.join(sorted(unknown))}")


def parse(text: str, sha256: str = "") -> FieldMapping:
    data = tomllib.loads(text)
    _only("mapping", data, "schema_version", "name", "description", "source_format", "fields", "defaults", "timestamp", "expect", "sidecar")
    if data.get("schema_version") != 1:
        raise ConfigError("a mapping has schema_version 1")
    if data.get("source_format") not in FORMATS:
        raise ConfigError(f"source_format is one of {', '.join(FORMATS)}")
    fields: dict[str, FieldSpec] = {}
    for name, spec in data.get("fields", {}).items():
        if name not in FIELDS:
            raise ConfigError(f"a record has no field {name!r}")
        _only(f"fields.{name}", spec, "path", "extractor", "criterion_key", "passed_key")
        if spec.get("extractor", "identity") not in EXTRACTORS:
            raise ConfigError(f"unknown extractor {spec['extractor']!r}")
        fields[name] = FieldSpec(**{k: str(v) for k, v in spec.items()})
    defaults = dict(data.get("defaults", {}))
    if unknown := set(defaults) - set(FIELDS):
        raise ConfigError(f"a record has no field {', '.join(sorted(unknown))}")
    sidecar = None
    if raw := data.get("sidecar"):
        _only("sidecar", raw, "target", "key_field", "text_field")
        sidecar = SidecarSpec(raw["target"], raw["key_field"], raw.get("text_field", "text"))
    given = set(fields) | set(defaults) | ({sidecar.target} if sidecar else set())
    if missing := [f for f in REQUIRED if f not in given]:
        raise ConfigError(f"the mapping leaves out {', '.join(missing)}")
    times, expect = data.get("timestamp", {}), data.get("expect", {})
    _only("timestamp", times, "naive_is_utc")
    _only("expect", expect, "output_json")
    return FieldMapping(
        str(data.get("name", "")), data["source_format"], fields, defaults, bool(times.get("naive_is_utc", False)),
        bool(expect.get("output_json", False)), sidecar, sha256,
    )


def load(name: str, folder: str | Path = "mappings") -> FieldMapping:
    """A bare name means ``folder/name.toml``; anything else is a path."""
    path = Path(name) if "/" in name or name.endswith(".toml") else Path(folder) / f"{name}.toml"
    if not path.is_file():
        raise ConfigError(f"no mapping at {path}")
    raw = path.read_bytes()
    return parse(raw.decode("utf-8"), hashlib.sha256(raw).hexdigest())


def available(folder: str | Path = "mappings") -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.toml"))
