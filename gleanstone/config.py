"""Settings with their defaults, read from strict TOML: unknown sections and keys are refused."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from gleanstone.errors import ConfigError

# The signals in their order, with weights and quotas.
SIGNAL_WEIGHTS = {
    "error": 4, "judge_failure": 5, "negative_feedback": 4, "feedback_conflict": 6, "version_disagreement": 5,
    "injection_pattern": 4, "refusal_pattern": 3, "format_violation": 3, "novelty": 3, "latency_outlier": 2,
    "length_outlier": 2, "non_ascii_ratio": 1, "tiny_input": 1,
}
QUOTAS = {
    "error": 6, "judge_failure": 8, "negative_feedback": 6, "feedback_conflict": 4, "version_disagreement": 4,
    "injection_pattern": 3, "refusal_pattern": 3, "format_violation": 3, "novelty": 4, "latency_outlier": 2,
    "length_outlier": 2, "non_ascii_ratio": 2, "tiny_input": 1, "ordinary": 6,
}
NEGATIVE_WORDS = ("down", "thumbs_down", "bad", "negative", "unhelpful", "1", "2")
POSITIVE_WORDS = ("up", "thumbs_up", "good", "positive", "helpful", "4", "5")
NAME_ALLOWLIST = ("Dr Pepper", "Dr Martens", "Mr Muscle")
ORDINARY = "ordinary"


@dataclass(frozen=True)
class Privacy:
    redact: bool = True
    name_allowlist: tuple[str, ...] = NAME_ALLOWLIST


@dataclass(frozen=True)
class Ingest:
    max_text_chars: int = 20_000


@dataclass(frozen=True)
class Dedupe:
    dedupe: bool = True


@dataclass(frozen=True)
class Score:
    tiny_input_chars: int = 24
    non_ascii_threshold: float = 0.25
    novelty_max_jaccard: float = 0.3
    outlier_percentile: int = 95
    min_outlier_sample: int = 12
    negative_feedback_words: tuple[str, ...] = NEGATIVE_WORDS
    positive_feedback_words: tuple[str, ...] = POSITIVE_WORDS
    weights: dict[str, int] = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))


@dataclass(frozen=True)
class Cluster:
    shingle_words: int = 5
    permutations: int = 64
    bands: int = 16
    seed: int = 1729
    jaccard_threshold: float = 0.6


@dataclass(frozen=True)
class Select:
    max_candidates: int = 40
    max_per_cluster: int = 1
    quotas: dict[str, int] = field(default_factory=lambda: dict(QUOTAS))


@dataclass(frozen=True)
class Label:
    min_interval_ms: int = 6500
    max_calls: int = 120


@dataclass(frozen=True)
class Health:
    neighbour_jaccard: float = 0.6
    max_recommendations: int = 10


@dataclass(frozen=True)
class Drift:
    novel_cluster_jaccard: float = 0.4


@dataclass(frozen=True)
class Config:
    privacy: Privacy = Privacy()
    ingest: Ingest = Ingest()
    dedupe: Dedupe = Dedupe()
    score: Score = Score()
    cluster: Cluster = Cluster()
    select: Select = Select()
    label: Label = Label()
    health: Health = Health()
    drift: Drift = Drift()


def _typed(section: str, key: str, value: object, like: object) -> object:
    where = f"[{section}] {key}"
    if isinstance(like, bool) or isinstance(value, bool):
        if isinstance(like, bool) and isinstance(value, bool):
            return value
        raise ConfigError(f"{where} must be {type(like).__name__}, not {value!r}")
    if isinstance(like, float):
        if isinstance(value, float) and 0 < value < 1:
            return value
        raise ConfigError(f"{where} must be a fraction between 0 and 1, not {value!r}")
    if isinstance(like, int):
        if isinstance(value, int) and value >= 0:
            return value
        raise ConfigError(f"{where} must be a whole number, not {value!r}")
    if isinstance(like, tuple):
        if isinstance(value, list) and all(isinstance(x, str) and x.strip() for x in value):
            return tuple(value)
        raise ConfigError(f"{where} must be a list of words")
    if isinstance(like, dict):
        if not isinstance(value, dict) or set(value) != set(like):
            raise ConfigError(f"{where} must name exactly {', '.join(like)}")
        if not all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in value.values()):
            raise ConfigError(f"{where} must hold whole numbers")
        return dict(value)
    raise ConfigError(f"{where} can't be set")


def checked(config: Config) -> Config:
    """The rules that hold across keys."""
    if not 1 <= config.score.outlier_percentile <= 99:
        raise ConfigError("a percentile is a whole number from 1 to 99")
    if config.cluster.bands < 1 or config.cluster.permutations % config.cluster.bands:
        raise ConfigError("the bands must divide the permutations")
    if not any(config.score.weights.values()):
        raise ConfigError("not every weight can be 0")
    if set(config.score.positive_feedback_words) & set(config.score.negative_feedback_words):
        raise ConfigError("a word of feedback can't be positive and negative")
    return config


def load(path: str | Path) -> Config:
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    config = Config()
    known = {f.name for f in fields(Config)}
    for section, values in data.items():
        if section not in known or not isinstance(values, dict):
            raise ConfigError(f"unknown section [{section}]")
        part = getattr(config, section)
        keys = {f.name for f in fields(part)}
        if unknown := set(values) - keys:
            raise ConfigError(f"unknown keys in [{section}]: {', '.join(sorted(unknown))}")
        part = replace(part, **{k: _typed(section, k, v, getattr(part, k)) for k, v in values.items()})
        config = replace(config, **{section: part})
    return checked(config)
