"""Configuration: nested dataclasses from a mapping or a file, with dotted overrides. A key that no field has is an error."""

from __future__ import annotations

import dataclasses
import json
import typing
from collections.abc import Iterable, Mapping
from pathlib import Path

try:
    import yaml
except ImportError:  # files are JSON then
    yaml = None


def built(kind: type, values: Mapping[str, object], path: str = "") -> object:
    """An instance of the dataclass `kind`; mappings build its nested dataclasses."""
    hints = typing.get_type_hints(kind)
    if unknown := {*values} - {*hints}:
        raise KeyError(f"unknown keys: {', '.join(sorted(path + k for k in unknown))}")
    return kind(**{k: built(hints[k], v, f"{path}{k}.") if dataclasses.is_dataclass(hints[k]) and isinstance(v, Mapping) else v for k, v in values.items()})


def overridden(values: Mapping[str, object], overrides: Iterable[str]) -> dict[str, object]:
    """values with each "a.b=c" applied; c is JSON, else a text."""
    out = json.loads(json.dumps(values))
    for text in overrides:
        path, given, value = text.partition("=")
        if not given:
            raise ValueError(f"not a.b=c: {text}")
        *parents, last = path.strip().split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise KeyError(f"unknown keys: {path}")
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def read_config(kind: type, path: str, overrides: Iterable[str] = ()) -> object:
    """The configuration in a JSON file, or a YAML file where yaml is there; `model: other.json` takes the model's mapping from a file beside it."""
    file = Path(path)

    def parsed(f: Path) -> dict:
        return (yaml.safe_load if yaml and f.suffix in (".yaml", ".yml") else json.loads)(f.read_text()) or {}

    values = parsed(file)
    if isinstance(values.get("model"), str):
        values["model"] = parsed(file.parent / values["model"])
    return built(kind, overridden(values, overrides))
