"""Configuration from TOML. A missing file gives the defaults, bad TOML an error, unknown keys an error that names them."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Encoding:
    mode: str = "auto"
    sample_bytes: int = 8192
    fallback_encoding: str = "utf-8"


@dataclass(frozen=True)
class Lines:
    skip_prefixes: tuple[str, ...] = ("#", "//", "--")
    max_line_bytes: int = 4096
    unquote: bool = True
    unicode_normalize: bool = True
    guard_cells: bool = False


@dataclass(frozen=True)
class Urls:
    max_bytes: int = 2048
    clean: bool = True
    strip_default_ports: bool = True
    strip_paths: bool = False
    reject_unknown_schemes: bool = False
    url_pattern: str | None = None
    email_pattern: str | None = None


@dataclass(frozen=True)
class Output:
    #: Of the hashes in the quarantine; a run demands one, since a known key makes short lines guessable.
    quarantine_key: str | None = None
    export_stats: bool = True


@dataclass(frozen=True)
class Config:
    encoding: Encoding = field(default_factory=Encoding)
    lines: Lines = field(default_factory=Lines)
    urls: Urls = field(default_factory=Urls)
    output: Output = field(default_factory=Output)

    def flat(self) -> dict[str, str]:
        return {f"{section}.{k}": str(v) for section, values in asdict(self).items() for k, v in values.items()}


def _build(cls: type, values: dict, where: str):
    known = {f.name: f for f in fields(cls)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown keys in {where or 'configuration'}: {', '.join(sorted(unknown))}")
    out = {}
    for k, v in values.items():
        default = getattr(cls(), k)
        if is_dataclass(default):
            out[k] = _build(type(default), v, k)
        else:
            out[k] = tuple(v) if isinstance(default, tuple) else v
    return cls(**out)


def load(path: str | Path) -> Config:
    file = Path(path)
    if not file.exists():
        return Config()
    return _build(Config, tomllib.loads(file.read_text(encoding="utf-8")), "")
