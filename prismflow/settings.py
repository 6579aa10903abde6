"""Settings of a workspace from a TOML file: strict keys, variables in paths, an optional local override."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Ways to write a name in a path: what opens it and what closes it.
_MARKS = (("${", "}"), ("%", "%"), ("{", "}"))


@dataclass(frozen=True)
class MetadataSettings:
    """Where metadata lies and what its columns hold."""

    path: Path | None = None
    key: str = "file_name"
    columns: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    """root of the data, glob of its files, folders of catalog and runs, metadata, memory that a fit may take."""

    root: Path
    glob: str = "**/*.parquet"
    catalog: Path = Path("catalog")
    runs: Path = Path("runs")
    memory_warn_gb: float = 16.0
    metadata: MetadataSettings = MetadataSettings()


def expand(text: str, base: Path, root: Path | None = None) -> Path:
    """A path with ${NAME}, %NAME%, {root} and ~ filled in, relative to the file's folder; unknown names are a ValueError.

    The text is read once from left to right; a mark that names nothing by its form stands for itself.
    """
    out, at = [], 0
    while at < len(text):
        for opening, closing in _MARKS:
            stop = text.find(closing, at + len(opening)) if text.startswith(opening, at) else -1
            name = text[at + len(opening) : stop]
            if stop > 0 and name.isidentifier() and (opening != "{" or name == "root"):
                out.append(_named(name, root if opening == "{" else os.environ.get(name)))
                at = stop + len(closing)
                break
        else:
            out.append(text[at])
            at += 1
    return base.joinpath(Path("".join(out)).expanduser()).resolve()


def _named(name: str, value: object) -> str:
    if value is None:
        raise ValueError(f"nothing is known by the name {name} here")
    return str(value)


def _merged(a: dict, b: dict) -> dict:
    return a | {k: _merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def load_settings(path: str | Path) -> Settings:
    """Settings of a file, overridden by name.local.toml beside it; unknown keys are a ValueError."""
    path = Path(path)
    data = tomllib.loads(path.read_text())
    local = path.with_name(f"{path.stem}.local{path.suffix}")
    if local.exists():
        data = _merged(data, tomllib.loads(local.read_text()))
    meta = data.pop("metadata", {})
    for given, kind in ((data, Settings), (meta, MetadataSettings)):
        unknown = set(given) - {f.name for f in fields(kind)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "root" not in data:
        raise ValueError("root is missing")
    base = path.resolve().parent
    root = expand(data["root"], base)
    for name in ("catalog", "runs"):
        if name in data:
            data[name] = expand(data[name], base, root)
    if meta.get("path"):
        meta["path"] = expand(meta["path"], base, root)
    return Settings(**(data | {"root": root, "metadata": MetadataSettings(**meta)}))
