"""Configuration of a run: reading, hiding keys, and skipping what is there."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Iterable


#: Fixed value: what stands for a key.
HIDDEN = "***REDACTED***"


def load(path: str) -> dict:
    """A JSON or, where its library is installed, YAML file with the sections ``app`` and ``steps``."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs the yaml library; JSON does not") from e
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text or "{}")
    if not {"app", "steps"} <= data.keys():
        raise ValueError("a configuration has the sections 'app' and 'steps'")
    return data


def _told(value, path: tuple[str, ...]):
    """``value`` built anew, with what must not be told hidden by its path."""
    if isinstance(value, dict):
        return {k: _told(v, (*path, k)) for k, v in value.items()}
    secret = len(path) == 3 and path[0] == "llm_providers" and path[-1] == "api_key"
    return HIDDEN if secret and value else copy.deepcopy(value)


def snapshot(config: dict) -> dict:
    """The configuration as it may be stored."""
    return _told(config, ())


def there(outputs: Iterable[str], overwrite: bool = False) -> bool:
    """Whether a step may be left out because all it makes exists."""
    paths = list(outputs)
    return bool(paths) and not overwrite and all(os.path.exists(p) for p in paths)


def unchanged(path: str, size: int, modified: float) -> bool:
    """Whether a file still has the size and time a report noted."""
    try:
        s = os.stat(path)
    except OSError:
        return False
    return s.st_size == size and s.st_mtime == modified
