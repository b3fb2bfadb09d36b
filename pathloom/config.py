"""Configuration: a TOML file whose missing keys have defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.predicates import QUIET

# Names and places a walk leaves out by default.
EXCLUDES = """.git node_modules target .bun .cache .cargo .npm .Trash .DS_Store .venv .venvs venv .tox .mypy_cache .pytest_cache .ruff_cache
__pycache__ Library/Caches Library/Containers Library/Logs""".split() + ["Library/Application Support/MobileSync", "Library/Mobile Documents", "Library/CloudStorage"]

# Folders of application bundles.
APP_FOLDERS = ["/Applications", "/System/Applications", "~/Applications"]


@dataclass(frozen=True)
class EngineConfig:
    roots: list[str] = field(default_factory=lambda: ["~"])
    excludes: list[str] = field(default_factory=lambda: list(EXCLUDES))
    max_content_filesize: int = 2 << 20
    quiet: list[str] = field(default_factory=lambda: list(QUIET))
    index_apps: bool = True
    index_dir: str = "~/.local/share/pathloom"

    def expanded_roots(self) -> list[str]:
        return [expand(r) for r in self.roots]


def expand(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def load_or_create(path: str) -> EngineConfig:
    """The configuration; a first use writes the defaults, a wrong key type is an error, unknown keys are ignored."""
    file = Path(expand(path))
    if not file.exists():
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text('roots = ["~"]\n')
    data = tomllib.loads(file.read_text())
    known = {f.name: f for f in fields(EngineConfig)}
    defaults = EngineConfig()
    for name in data.keys() & known.keys():
        if type(data[name]) is not type(getattr(defaults, name)):
            raise ValueError(f"{name} must be {type(getattr(defaults, name)).__name__}")
    return EngineConfig(**{k: v for k, v in data.items() if k in known})
