"""Settings of a service from a TOML file and the environment, as settings of a check and limits of requests."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, replace

from .operators import grounding
from .sources import evaluations

#: Sections, their settings and the types of these. Sections of serving alone are let through unread.
SETTINGS = {
    "models": {"nli_model_path": str, "embedding_model_path": str},
    "faithfulness": {
        "default_top_k": int, "default_threshold": float, "contradiction_threshold": float, "min_similarity_threshold": float, "adaptive_top_k": bool, "partial_threshold": float,
        "partial_neutral_ceiling": float, "partial_similarity_floor": float, "max_context_chars": int, "max_output_chars": int, "available_granularities": list,
    },
    "workers": {"batch_size": int},
}
SERVING = ("server", "auth", "rate_limit", "logging")


@dataclass(frozen=True)
class Service:
    """What a batch of requests is checked with. The limits are in bytes, whatever their settings are called."""

    check: grounding.Config = grounding.SERVICE
    limits: tuple[int, int] = (evaluations.MAX_CONTEXT_BYTES, evaluations.MAX_OUTPUT_BYTES)
    nli_model: str | None = None
    embedding_model: str | None = None
    batch_size: int = 16
    granularities: tuple[str, ...] = ("sentence",)


def _read(text: str, kind: type):
    """A variable's text as a setting."""
    if kind is bool:
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.lower() == "true"
    return [x.strip() for x in text.strip("[]").split(",") if x.strip()] if kind is list else kind(text)


def load(path: str | os.PathLike | None = None, environ: Mapping[str, str] = os.environ, prefix: str = "CLAIMWEAVE_") -> Service:
    """The settings of a TOML file, if there is one, with those of variables such as CLAIMWEAVE_FAITHFULNESS__DEFAULT_TOP_K over them.

    A section or setting that is not known is an error, and so is a share that is not between 0 and 1.
    """
    found: dict[str, dict] = {}
    if path is not None:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    for name, text in environ.items():
        section, split, key = name.removeprefix(prefix).lower().partition("__")
        if name.startswith(prefix) and split and section not in SERVING:
            kind = SETTINGS.get(section, {}).get(key)
            if kind is None:
                raise ValueError(f"{name}: not a setting")
            found.setdefault(section, {})[key] = _read(text, kind)
    for section, values in found.items():
        if section not in SETTINGS and section not in SERVING:
            raise ValueError(f"[{section}]: not a section")
        for key, value in values.items() if section in SETTINGS else ():
            kind = SETTINGS[section].get(key)
            if kind is None and section != "workers":
                raise ValueError(f"{section}.{key}: not a setting")
            if kind and (isinstance(value, bool) != (kind is bool) or not isinstance(value, (int, float) if kind is float else kind)):
                raise ValueError(f"{section}.{key}: {value!r} is not of type {kind.__name__}")
    f, models, base = found.get("faithfulness", {}), found.get("models", {}), grounding.SERVICE
    check = replace(
        base, top_k=f.get("default_top_k", base.top_k), pass_threshold=f.get("default_threshold", base.pass_threshold), contradiction=f.get("contradiction_threshold", base.contradiction),
        min_similarity=f.get("min_similarity_threshold", base.min_similarity), adaptive=f.get("adaptive_top_k", base.adaptive),
        partial=(f.get("partial_threshold", base.partial[0]), f.get("partial_neutral_ceiling", base.partial[1]), f.get("partial_similarity_floor", base.partial[2])),
    )
    if not all(0 <= x <= 1 for x in (check.pass_threshold, check.contradiction, check.min_similarity, *check.partial)) or check.top_k < 0:
        raise ValueError("thresholds are between 0 and 1, top_k at least 0")
    own = Service()
    return Service(
        check, (f.get("max_context_chars", own.limits[0]), f.get("max_output_chars", own.limits[1])), models.get("nli_model_path"), models.get("embedding_model_path"),
        found.get("workers", {}).get("batch_size", own.batch_size), tuple(f.get("available_granularities", own.granularities)),
    )
