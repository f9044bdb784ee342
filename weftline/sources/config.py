"""Configuration for the driver: KEY=value files, the project's root, allowed environment variables."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$")


def parse_value(raw: str) -> str:
    """A value without its quotes, or without the comment after it."""
    raw = raw.strip()
    if raw[:1] in ("'", '"'):
        end = raw.find(raw[0], 1)
        return raw[1:end] if end > 0 else raw[1:]
    return re.sub(r"(^|\s)#.*$", "", raw).strip()


def load(text: str, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Keys and values, ${X} taken from the lines before, then from the environment, else empty."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        if line.lstrip().startswith("#") or not (m := _LINE.match(line)):
            continue
        literal = m[2].strip().startswith("'")
        value = parse_value(m[2])
        out[m[1]] = value if literal else re.sub(r"\$\{([A-Za-z_]\w*)\}", lambda r: out.get(r[1], env.get(r[1], "")), value)
    return out


class Config:
    """Typed reads; the environment stands in for keys that the file lacks."""

    def __init__(self, values: Mapping[str, str], env: Mapping[str, str] = os.environ):
        self.values, self.env = values, env

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key) or self.env.get(key) or default

    def csv(self, key: str, default: tuple[str, ...] = ()) -> list[str]:
        own = self.get(key)
        return [p.strip() for p in own.split(",") if p.strip()] if own is not None else list(default)

    def integer(self, key: str, default: int) -> int:
        own = (self.get(key) or "").strip()
        return int(own) if re.fullmatch(r"-?\d+", own) else default

    def boolean(self, key: str, default: bool = False) -> bool:
        own = (self.get(key) or "").strip().lower()
        return own in ("1", "true", "yes", "on") if own else default


def find_root(start: str | Path, marker: str, most: int = 64) -> Path | None:
    """The nearest folder from start upwards that holds the marker, within so many levels."""
    at = Path(start).resolve()
    for _ in range(most):
        if (at / marker).exists():
            return at
        if at.parent == at:
            return None
        at = at.parent
    return None


def allowed_environment(env: Mapping[str, str], names: tuple[str, ...]) -> dict[str, str]:
    """The variables on a list, and no others."""
    return {k: env[k] for k in names if k in env}
