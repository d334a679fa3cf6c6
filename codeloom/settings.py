"""A project's settings: a TOML file beside its sources."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

# fixed values: what holds without a file
DEFAULT_MODEL, DEFAULT_DEVICE = "sentence-transformers/all-MiniLM-L6-v2", "cpu"


@dataclass(frozen=True)
class Settings:
    name: str | None = None
    model: str = DEFAULT_MODEL
    device: str = DEFAULT_DEVICE
    reranker: str | None = None
    exclude_patterns: tuple[str, ...] = field(default_factory=tuple)

    @property
    def pooling(self) -> str:
        """Models of one family take their first token, all others the mean."""
        return "cls" if "bge-" in self.model else "mean"


def read_settings(path: str | Path) -> Settings:
    """The settings in a file with the tables project, embedding and index; the defaults if there is none, an error if it is malformed.

    An embedding table names its model and device.
    """
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        return Settings()
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    embedding, project, index = (found.get(k, {}) for k in ("embedding", "project", "index"))
    if missing := [k for k in ("model", "device") if embedding and k not in embedding] + (["name"] if project and "name" not in project else []):
        raise ValueError(f"{path}: {', '.join(missing)} missing")
    patterns = index.get("exclude_patterns") or ()
    if isinstance(patterns, str) or not all(isinstance(p, str) for p in patterns):
        raise ValueError(f"{path}: exclude_patterns is a list of globs")
    return Settings(project.get("name"), embedding.get("model", DEFAULT_MODEL), embedding.get("device", DEFAULT_DEVICE), embedding.get("reranker"), tuple(patterns))
