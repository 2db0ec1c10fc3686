"""Settings of the engine as plain dataclasses: files, presets, environment."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from typing import Any


@dataclass
class ChunkingConfig:
    window_lines: int = 50
    overlap_ratio: float = 0.2
    context_lines: int = 0
    least_tokens: int = 50
    most_tokens: int = 2000


@dataclass
class VectorConfig:
    provider: str = "parquet"
    path: str = ""
    dimension: int = 256
    metric: str = "cosine"

    def check(self) -> None:
        if self.metric not in ("cosine", "euclidean", "dot_product"):
            raise ValueError(f"unknown metric {self.metric}")
        if self.dimension <= 0:
            raise ValueError("the dimension must be positive")


@dataclass
class RetrievalConfig:
    top_k: int = 10
    max_tokens: int = 8000
    score_threshold: float = 0.3
    expansion_level: str | None = None


@dataclass
class BoostConfig:
    least: float = 0.5
    most: float = 3.0
    edit_hours: int = 24
    open_hours: int = 2
    recent_files: int = 10


@dataclass
class Config:
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    vectors: VectorConfig = field(default_factory=VectorConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    boost: BoostConfig = field(default_factory=BoostConfig)
    ignore: list[str] = field(default_factory=lambda: ["/.git/", "/node_modules/", "/__pycache__/"])

    @classmethod
    def of(cls, values: dict[str, Any]) -> Config:
        """From nested values; unknown sections and keys are errors, missing ones keep their defaults."""
        out = cls()
        for section, value in values.items():
            held = getattr(out, section)
            if dataclasses.is_dataclass(held):
                setattr(out, section, dataclasses.replace(held, **value))
            else:
                setattr(out, section, value)
        out.vectors.check()
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as file:
            return cls.of(json.load(file))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(dataclasses.asdict(self), file, indent=2)

    @classmethod
    def from_environment(cls, prefix: str = "QUARRY_") -> Config:
        """``QUARRY_RETRIEVAL_TOP_K=20`` and the like over the defaults."""
        values: dict[str, dict] = {}
        for f in dataclasses.fields(cls):
            kind = f.default_factory() if f.default_factory is not dataclasses.MISSING else None
            if not dataclasses.is_dataclass(kind):
                continue
            for g in dataclasses.fields(kind):
                raw = os.environ.get(f"{prefix}{f.name}_{g.name}".upper())
                if raw is not None:
                    held = getattr(kind, g.name)
                    values.setdefault(f.name, {})[g.name] = type(held)(raw) if held is not None else raw
        return cls.of(values)

    @classmethod
    def preset(cls, name: str) -> Config:
        return cls.of(PRESETS[name])


#: Named settings.
PRESETS: dict[str, dict] = {
    "default": {},
    "fast": {"retrieval": {"top_k": 5, "max_tokens": 4000}},
    "thorough": {"retrieval": {"top_k": 20, "max_tokens": 16000, "expansion_level": "aggressive"}},
}
