"""Settings JSON of the viewer: every key optional, unknown keys ignored on read and kept on write."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    layout: str = "gpu"
    speed: float = 100.0
    area: float = 1000.0
    gravity: float = 1.0
    three_d: bool = True
    background: tuple[int, int, int] = (0, 0, 0)


KEYS = {"layout": "layout", "speed": "speed", "area": "area", "gravity": "gravity", "three_d": "threeD", "background": "background"}
SAVED = ("speed", "area", "gravity", "three_d")


def parse(text: str) -> Settings:
    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("settings must be a JSON object")
    base = Settings()
    found = {field: raw[key] for field, key in KEYS.items() if key in raw}
    for field, value in found.items():
        kind = type(getattr(base, field))
        if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
            found[field] = float(value)
        elif kind is tuple and isinstance(value, list):
            found[field] = tuple(value)
        elif not isinstance(value, kind):
            raise ValueError(f"settings key {KEYS[field]} has the wrong type")
    return Settings(**found)


def load(path: str | None, default: str = "settings.json") -> Settings:
    """A named file must be there; the default one may be missing."""
    p = Path(path or default)
    if path is None and not p.exists():
        return Settings()
    return parse(p.read_text(encoding="utf-8"))


def save(path: str, settings: Settings) -> None:
    """Put the graph's four keys in; all other keys stay."""
    p = Path(path)
    raw = json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
    raw |= {KEYS[f]: getattr(settings, f) for f in SAVED}
    p.write_text(json.dumps(raw, indent=2) + "\n", encoding="utf-8")
