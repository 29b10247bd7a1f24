"""Configurations: JSON files and nested overrides. They are small and live on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any


def load(path: str) -> dict[str, Any]:
    """The object in a JSON file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def merged(base: Mapping[str, Any], more: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with ``more`` over it: objects merge at every depth, all else is replaced; neither is changed."""
    out = dict(base)
    for k, v in more.items():
        both = isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
        out[k] = merged(out[k], v) if both else v
    return out


def overridden(base: Mapping[str, Any], settings: Sequence[str]) -> dict[str, Any]:
    """``base`` with settings of the form ``a.b.c=value``; values are JSON where they can be read as such, else text."""
    out = dict(base)
    for setting in settings:
        name, mark, text = setting.partition("=")
        if not mark:
            raise ValueError(f"a setting is given as name=value, not {setting!r}")
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            value = text
        for part in reversed(name.strip().split(".")):
            value = {part: value}
        out = merged(out, value)
    return out


def config_hash(config: Mapping[str, Any], length: int = 40) -> str:
    """SHA-1 of the configuration's JSON with sorted keys: equal configurations have equal hashes."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:length]
