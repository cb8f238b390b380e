"""Settings of a library, from defaults, a TOML file and the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """SRC23: what can be set; anything else in a file is passed over."""

    root: str = "~/.listenlab"
    shuffle_partitions: int = 8
    session_gap_s: int = 1800
    mmr_lambda: float = 0.72
    epsilon: float = 0.08
    weight_one: float = 0.6
    weight_two: float = 0.4
    debias_popularity: bool = True


def _fitting(value: object, kind: type) -> object | None:
    """The value as its kind, or None if it is none."""
    if kind is bool:
        return value if isinstance(value, bool) else {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}.get(str(value).strip().lower())
    try:
        return None if isinstance(value, (bool, dict, list)) else kind(value)
    except (TypeError, ValueError):
        return None


def load(path: str | None = None, environ: Mapping[str, str] = os.environ, prefix: str = "LISTENLAB_") -> Config:
    """SRC23, AX21: defaults, then the file (whole or by sections), then the environment; what is missing, unreadable or of a wrong kind changes nothing."""
    said: dict[str, object] = {}
    try:
        with open(path or environ.get(f"{prefix}CONFIG", ""), "rb") as f:
            for k, v in tomllib.load(f).items():
                said |= v if isinstance(v, dict) else {k: v}
    except (OSError, tomllib.TOMLDecodeError):
        pass
    said |= {k[len(prefix) :].lower(): v for k, v in environ.items() if k.startswith(prefix)}
    kinds = {f.name: type(f.default) for f in fields(Config)}
    good = {k: x for k, v in said.items() if k in kinds and (x := _fitting(v, kinds[k])) is not None}
    out = replace(Config(), **good)
    return replace(out, root=os.path.expanduser(out.root))
