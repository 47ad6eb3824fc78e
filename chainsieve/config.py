"""Settings: nested mappings from YAML or JSON text, dotted overrides, ``.env`` files."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping


def parse(text: str) -> dict:
    """Settings from YAML text where a YAML reader is installed, else from JSON, which is YAML too."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def merged(base: Mapping, over: Mapping) -> dict:
    """``over`` laid over ``base``: mappings are merged, lists and all else replaced."""
    out = dict(base)
    for key, value in over.items():
        known = out.get(key)
        out[key] = merged(known, value) if isinstance(known, Mapping) and isinstance(value, Mapping) else value
    return out


def overridden(settings: Mapping, pairs: list[str]) -> dict:
    """Settings with ``a.b.c=value`` pairs applied; values are read like settings text."""
    out = dict(settings)
    for pair in pairs:
        path, mark, value = pair.partition("=")
        if not mark or not path:
            raise ValueError(f"an override is written key.path=value, not {pair!r}")
        nested: object = parse(value)
        for key in reversed(path.split(".")):
            nested = {key: nested}
        out = merged(out, nested)
    return out


def flat(settings: Mapping, prefix: str = "") -> dict[str, object]:
    """Settings by dotted name."""
    out: dict[str, object] = {}
    for key, value in settings.items():
        name = f"{prefix}{key}"
        if isinstance(value, Mapping):
            out |= flat(value, name + ".")
        else:
            out[name] = value
    return out


def read_env(text: str) -> dict[str, str]:
    """``KEY=value`` lines; blank lines and comments are skipped, quotation marks around values dropped."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip().strip("'\"")
    return out


def resolved(path: str, root: str) -> str:
    """A path of the settings: absolute ones and addresses as they are, others below ``root``."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(root, path)
