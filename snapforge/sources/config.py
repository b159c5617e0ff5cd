"""Configuration files, with one kind of error for all that can be wrong with them."""

from __future__ import annotations

import json
from pathlib import Path


class ConfigError(ValueError):
    pass


def _text(path: str | Path) -> str:
    try:
        return Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e


def _mapping(value: object, path: str | Path) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{path} holds no mapping")
    return value


def load_json(path: str | Path) -> dict:
    try:
        return _mapping(json.loads(_text(path)), path)
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path} is no JSON: {e}") from e


def load_yaml(path: str | Path) -> dict:
    text = _text(path)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML files need the package yaml") from e
    try:
        return _mapping(yaml.safe_load(text), path)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e


def write_status(path: str | Path, **what: object) -> None:
    """A run's status as JSON, whole or not at all."""
    to = Path(path)
    beside = to.with_suffix(to.suffix + ".next")
    beside.write_text(json.dumps(what, default=str, indent=1), encoding="utf-8")
    beside.replace(to)
