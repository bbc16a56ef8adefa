"""Typed configuration, read from the YAML layout ``general`` plus one section."""

from __future__ import annotations

import argparse
import hashlib
import json
from dataclasses import asdict, dataclass, fields
from typing import TypeVar

import yaml

T = TypeVar("T")


def _typed(cls: type[T], values: dict) -> T:
    kinds = {f.name: f.type for f in fields(cls)}
    kept = {}
    for name, value in values.items():
        if name not in kinds:
            continue  # settings nothing reads
        kind = kinds[name]
        if kind.startswith("int") and (isinstance(value, bool) or not isinstance(value, int)) and not (value is None and "None" in kind):
            raise ValueError(f"{name} must be a whole number, not {value!r}")
        if kind.startswith("float"):
            value = float(value)
        kept[name] = value
    return cls(**kept)


@dataclass(frozen=True)
class PairConfig:
    """Settings of the search for similar pairs and their verification."""

    vocab_size: int = 1_000_000
    hash_num: int = 512
    sketch_num: int = 512
    sketch_size: int = 3
    seed: int = 0
    weighted: bool = True
    min_similarity: float = 0.045
    max_similarity: float = 0.35
    matcher: str = "ratio"
    ransac_model: str = "homography"
    ransac_threshold: float = 5.0
    ransac_max_trials: int = 1000
    threshold_min_inlier: int | None = None

    def __post_init__(self) -> None:
        if self.matcher not in ("brute_force", "ratio"):
            raise ValueError(f"unknown matcher {self.matcher!r}")
        if self.ransac_model not in ("homography", "affine"):
            raise ValueError(f"unknown model {self.ransac_model!r}")


@dataclass(frozen=True)
class VocabularyConfig:
    """Settings of vocabulary learning."""

    vocab_size: int = 131_072
    clustering_lib: str = "pqkmeans"
    pq_subspaces: int = 8
    pq_codes: int = 256
    pq_train_size: int = 100_000
    pq_train_iters: int = 10
    iterations: int = 5
    seed: int = 0

    def __post_init__(self) -> None:
        if self.clustering_lib not in ("pqkmeans", "kmeans"):
            raise ValueError(f"clustering_lib {self.clustering_lib!r} is not supported; pqkmeans or kmeans")


#: The section names of such files.
SECTIONS = {PairConfig: "mhic_config", VocabularyConfig: "visual_word_gen_config"}


def read_config(path: str, cls: type[T]) -> T:
    """``cls`` from the sections ``general`` and its own, later keys winning; missing keys keep their defaults."""
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return _typed(cls, (data.get("general") or {}) | (data.get(SECTIONS[cls]) or {}))


def config_hash(config) -> str:
    """A short name of the settings, so that stages of other settings are never reused."""
    return hashlib.blake2b(json.dumps(asdict(config), sort_keys=True).encode(), digest_size=6).hexdigest()


def arguments(description: str, steps: tuple[str, ...]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--step", choices=steps, default=steps[0])
    parser.add_argument("--config", required=True)
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    return parser.parse_args()
