"""Engine configuration as JSON, and a registry of model files with their checksums."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class ModelConfig:
    """Where a model comes from, and what its file must hash to."""

    source: str
    revision: str = "main"
    sha256: str | None = None
    cache_path: str | None = None
    backend: str = "onnx"
    lazy: bool = True


@dataclass
class EngineConfig:
    """Settings of a run; unknown keys in a file are an error."""

    cache_dir: str = "models"
    target_latency_ms: int = 200
    max_memory_mb: int = 2048
    pass_threshold: float = 0.7
    hallucination_threshold: float = 0.5
    schema_max_depth: int = 10
    models: dict[str, ModelConfig] = field(default_factory=dict)

    def validate(self) -> EngineConfig:
        for name in ("pass_threshold", "hallucination_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name in ("target_latency_ms", "max_memory_mb", "schema_max_depth"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        for name, m in self.models.items():
            if not m.source:
                raise ValueError(f"model {name} has no source")
        return self

    def save(self, path: str | os.PathLike) -> None:
        Path(path).write_text(json.dumps(dataclasses.asdict(self), indent=2, sort_keys=True) + "\n")


def load(path: str | os.PathLike) -> EngineConfig:
    """The validated configuration of a JSON file."""
    raw = json.loads(Path(path).read_text())
    models = {k: ModelConfig(**v) for k, v in raw.pop("models", {}).items()}
    return EngineConfig(**raw, models=models).validate()


def file_sha256(path: str | os.PathLike) -> str:
    """The SHA-256 of a file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


class ModelRegistry:
    """Model files by name; a file is used only if its checksum is the configured one."""

    def __init__(self, config: EngineConfig):
        self.models, self.root, self.hashes = config.models, Path(config.cache_dir), {}

    def names(self) -> list[str]:
        return sorted(self.models)

    def path(self, name: str) -> Path:
        m = self.models[name]
        return Path(m.cache_path) if m.cache_path else self.root / name

    def available(self, name: str) -> bool:
        return name in self.models and self.path(name).exists()

    def verify(self, name: str) -> str:
        """The file's checksum; an error if it is not the configured one."""
        found, want = file_sha256(self.path(name)), self.models[name].sha256
        if want and found != want:
            raise ValueError(f"{name}: checksum {found} is not {want}")
        self.hashes[name] = found
        return found
