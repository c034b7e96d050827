"""Plug-ins: expression operators, transforms and enrich steps by name."""

from __future__ import annotations

import logging
from collections.abc import Callable
from importlib.metadata import entry_points

log = logging.getLogger(__name__)

GROUPS = {"expressions": "tallyframe.expr_ops", "transforms": "tallyframe.transforms", "enrich": "tallyframe.enrich"}
_given: dict[str, dict[str, Callable]] = {kind: {} for kind in GROUPS}
_found: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """Make ``function`` known as ``name``. Expressions get (df, *columns), transforms (column, params), enrich (df, params, frames=)."""
    _given[kind][name] = function


def plugins(kind: str) -> dict[str, Callable]:
    """Installed entry points, then what ``register`` was told; an entry point that can't be loaded is left out."""
    if kind not in _found:
        _found[kind] = {}
        for point in entry_points(group=GROUPS[kind]):
            try:
                _found[kind][point.name] = point.load()
            except Exception as e:  # a broken plug-in must not stop the rest
                log.warning("plug-in %s can't be loaded: %s", point.name, e)
    return _found[kind] | _given[kind]
