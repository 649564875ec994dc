"""Settings from a file, the environment and defaults; the environment wins over the file, the file over defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

DEFAULTS = {"host": "localhost", "port": 5432, "log_queries": False}
REQUIRED = ("host", "database", "user", "password")
#: Environment variables of each setting, the first set one counts, and how it is read. Fixed values.
VARIABLES: dict[str, tuple[tuple[str, ...], Any]] = {
    "host": (("DB_HOST",), str),
    "port": (("DB_PORT",), int),
    "database": (("DB_NAME", "DB_DATABASE"), str),
    "user": (("DB_USER",), str),
    "password": (("DB_PASSWORD",), str),
    "log_queries": (("DB_LOG_QUERIES",), lambda x: x.lower() == "true"),
}


def from_environment(env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The settings that are set in the environment; empty variables do not count."""
    env = os.environ if env is None else env
    found = {k: next((env[v] for v in names if env.get(v)), None) for k, (names, _) in VARIABLES.items()}
    return {k: VARIABLES[k][1](v) for k, v in found.items() if v is not None}


def from_file(path: str) -> dict[str, Any]:
    """The settings of a .yaml, .yml or .json file; an empty file has none."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no configuration file {path}")
    kind = os.path.splitext(path)[1]
    if kind not in (".yaml", ".yml", ".json"):
        raise ValueError(f"configuration files are YAML or JSON, not {kind or path!r}")
    with open(path) as f:
        if kind == ".json":
            return json.load(f) or {}
        import yaml

        return yaml.safe_load(f) or {}


def load_config(config_path: str | None = None) -> dict[str, Any]:
    config = from_file(config_path) if config_path else {}
    return {**config, "database": {**DEFAULTS, **(config.get("database") or {}), **from_environment()}}


def from_dict(config_dict: dict[str, Any]) -> dict[str, Any]:
    """The same settings, once it is clear that none of the required ones is missing."""
    if missing := [k for k in REQUIRED if k not in config_dict]:
        raise ValueError(f"missing settings: {missing}")
    return config_dict


def create_example_config(output_path: str = "config.example.yaml") -> str:
    """Writes an example; without a YAML library as JSON, with that suffix. The path written."""
    example = {"database": {"host": "localhost", "port": 5432, "database": "observations", "user": "reader", "password": "change-me", "log_queries": True}}
    try:
        import yaml

        text = yaml.safe_dump(example, sort_keys=False)
    except ImportError:
        output_path, text = os.path.splitext(output_path)[0] + ".json", json.dumps(example, indent=2)
    with open(output_path, "w") as f:
        f.write(text)
    return output_path
