"""Settings by mode: a file ``config-<mode>.json`` in a folder or one above it."""

from __future__ import annotations

import json
import os
from datetime import datetime
from pathlib import Path

MODES = ("dev", "prod", "test")
#: The environment variable that names the mode.
VARIABLE = "HERONRY_MODE"


def mode(environment: dict[str, str] | None = None) -> str:
    """The mode that is set; ``dev`` if none is; an unknown one is an error."""
    found = (environment if environment is not None else os.environ).get(VARIABLE) or "dev"
    if found not in MODES:
        raise ValueError(f"{found} is none of {', '.join(MODES)}")
    return found


def is_testing(environment: dict[str, str] | None = None) -> bool:
    return mode(environment) == "test"


def find_above(name: str, folder: str | Path = ".") -> Path | None:
    """The file of that name in the folder or the nearest one above it."""
    at = Path(folder).resolve()
    return next((p / name for p in (at, *at.parents) if (p / name).is_file()), None)


def settings(folder: str | Path = ".", environment: dict[str, str] | None = None) -> dict:
    """The settings of the mode, empty without a file."""
    found = find_above(f"config-{mode(environment)}.json", folder)
    return json.loads(found.read_text()) if found else {}


def required(values: dict, key: str) -> object:
    if values.get(key) is None:
        raise KeyError(f"{key} is not set")
    return values[key]


def text_or_none(path: str | Path) -> str | None:
    return Path(path).read_text() if Path(path).is_file() else None


def time_of_day(at: datetime | None = None) -> str:
    return (at or datetime.now()).strftime("%H.%M.%S")
