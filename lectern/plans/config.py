"""Settings of a model and templates of prompts, checked where they are read."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from lectern.plans import pipelines
from lectern.sources.files import redacted


@dataclass(frozen=True)
class ModelConfig:
    """How a model is called. ``api_key`` never leaves through :meth:`public`."""

    model: str = ""
    base_url: str = ""
    api_key: str = ""
    temperature: float = 0.7
    top_p: float = 1.0
    top_k: int = 0
    max_tokens: int = 2000
    timeout: int = 300
    concurrency: int = 5

    def __post_init__(self) -> None:
        checks = (
            (0 <= self.temperature <= 2, "temperature must lie between 0 and 2"),
            (0 <= self.top_p <= 1, "top_p must lie between 0 and 1"),
            (self.top_k >= 0, "top_k must not be negative"),
            (self.max_tokens > 0, "max_tokens must be positive"),
            (self.timeout > 0, "timeout must be positive"),
            (self.concurrency > 0, "concurrency must be positive"),
        )
        for ok, said in checks:
            if not ok:
                raise ValueError(said)

    def public(self) -> dict:
        return redacted(asdict(self))


def read_config(path: str | None = None, prefix: str = "LECTERN_") -> ModelConfig:
    """Settings from NAME=value lines of a file (comments and blank lines aside), over those of the environment."""
    found = {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    if path:
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.partition("=")
            if eq and not name.lstrip().startswith("#"):
                found[name.strip().removeprefix(prefix).lower()] = value.strip().strip("'\"")
    kinds = {k: type(v) for k, v in asdict(ModelConfig()).items()}
    return ModelConfig(**{k: kinds[k](v) for k, v in found.items() if k in kinds})


DEFAULTS = {"testing": pipelines.ASK, "testing_without_text": pipelines.ASK_WITHOUT_TEXT, "validation": pipelines.VALIDATE, "generation": pipelines.GENERATE, "summary": pipelines.SUMMARIZE}


def check_template(t: object) -> dict:
    """A template with texts ``system`` and ``user`` and, if given, a list of texts ``constraints``."""
    if not isinstance(t, dict):
        raise ValueError("a template must be an object")
    for name in ("system", "user"):
        if not isinstance(t.get(name), str):
            raise ValueError(f"a template needs a text {name!r}")
    if not isinstance(t.get("constraints", []), list) or not all(isinstance(c, str) for c in t.get("constraints", [])):
        raise ValueError("constraints must be a list of texts")
    return t


def load_templates(folder: str | None = None) -> dict[str, dict]:
    """The template of each kind, from <kind>.json in ``folder``; a missing or faulty file leaves the default. ``is_default``
    tells which it is."""
    out = {}
    for kind, user in DEFAULTS.items():
        t = {"system": "", "user": user, "is_default": True}
        at = Path(folder or "", f"{kind}.json")
        if folder and at.is_file():
            try:
                t = {**check_template(json.loads(at.read_text(encoding="utf-8"))), "is_default": False}
            except ValueError:
                pass
        out[kind] = t
    return out


def load_template(kind: str, path: str) -> dict:
    """One template of a known kind; faults are errors."""
    if kind not in DEFAULTS:
        raise ValueError(f"unknown kind of template {kind!r}")
    return {**check_template(json.loads(Path(path).read_text(encoding="utf-8"))), "is_default": False}


def check_arguments(mode: str, lengths: list[int] | None, depth: float | None = None, length: int | None = None, padding: int = 500, most: int | None = None) -> None:
    """Which arguments a run's mode takes: 'legacy' one length, 'uniform' several, 'fixed' several and a depth, 'no_reference'
    none."""
    if mode not in ("legacy", "uniform", "fixed", "no_reference"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "legacy" and (not length or length <= 0):
        raise ValueError("a legacy run needs a positive context length")
    if mode in ("uniform", "fixed") and (not lengths or min(lengths) <= 0):
        raise ValueError("context lengths must be given and positive")
    if (mode == "fixed") != (depth is not None) or depth is not None and not 0 <= depth <= 1:
        raise ValueError("a depth between 0 and 1 belongs to a fixed run, and only to it")
    if mode == "no_reference" and (lengths or length):
        raise ValueError("a run without text takes no context length")
    if padding < 0 or most is not None and most <= 0:
        raise ValueError("padding must not be negative, and a number of questions must be positive")
