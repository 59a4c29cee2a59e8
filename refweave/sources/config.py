"""Settings of a run: defaults, then a TOML file, then the environment, then what the caller says."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

FILES = ("refweave.toml", ".refweave.toml")
SECTION = "refweave"
ENVIRONMENT = "REFWEAVE_"


@dataclass(frozen=True)
class Settings:
    contact_email: str | None = None
    concurrency: int = 8
    cache_dir: str | None = None
    ttl_days: int = 30
    timeout: float = 20.0
    retries: int = 4
    offline: bool = False

    def __post_init__(self):
        if self.concurrency < 1:
            raise ValueError("concurrency must be positive")


def _as(kind: str, value):
    """``value`` in a field's type, or None if it cannot be that."""
    base = kind.split(" |")[0]
    try:
        if base == "bool":
            if isinstance(value, bool):
                return value
            word = str(value).strip().lower()
            return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else None
        return {"int": int, "float": float, "str": str}[base](value)
    except (TypeError, ValueError):
        return None


def _known(raw: dict) -> dict:
    kinds = {f.name: f.type for f in fields(Settings)}
    return {k: v for k, x in raw.items() if k in kinds and (v := _as(kinds[k], x)) is not None}


def load(start: str | Path = ".", environment: dict | None = None, **said) -> Settings:
    """The first file with a section counts, upwards from ``start``; unknown names and unusable values are passed over."""
    here = Path(start).resolve()
    found: dict = {}
    for folder in (here, *here.parents):
        for name in FILES:
            path = folder / name
            if not found and path.is_file():
                try:
                    part = tomllib.loads(path.read_text(encoding="utf-8")).get(SECTION)
                except (tomllib.TOMLDecodeError, OSError, UnicodeDecodeError):
                    part = None
                found = part if isinstance(part, dict) else {}
    env = {k[len(ENVIRONMENT) :].lower(): v for k, v in (os.environ if environment is None else environment).items() if k.startswith(ENVIRONMENT)}
    merged = _known(found) | _known(env) | _known({k: v for k, v in said.items() if v is not None})
    return replace(Settings(), **merged)
