"""Configuration: includes, profiles, references, interpolation, checks."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..errors import ConfigError

#: The sections whose lists are added to rather than replaced, and the types a column may have.
APPENDED = {("sources",), ("compile", "targets"), ("compare", "pairs"), ("export", "workbooks")}
TYPES = ["string", "integer", "number", "date", "boolean"]


@dataclass
class Config:
    raw: dict[str, Any]

    def _at(self, *path: str, default: Any) -> Any:
        node: Any = self.raw
        for p in path:
            node = node.get(p, {}) if isinstance(node, dict) else {}
        return node or default

    @property
    def version(self) -> str:
        return str(self.raw.get("version", "1"))

    @property
    def timezone(self) -> str | None:
        return self.raw.get("timezone")

    @property
    def output(self) -> str | None:
        return self.raw.get("output")

    @property
    def schema_aliases(self) -> dict[str, dict]:
        return self._at("schema", "aliases", default={})

    @property
    def sources(self) -> list[dict]:
        return self._at("sources", default=[])

    @property
    def compile_targets(self) -> list[dict]:
        return self._at("compile", "targets", default=[])

    @property
    def compare_pairs(self) -> list[dict]:
        return self._at("compare", "pairs", default=[])

    @property
    def export_workbooks(self) -> list[dict]:
        return self._at("export", "workbooks", default=[])


def deep_merge(base: Any, over: Any, path: tuple[str, ...] = ()) -> Any:
    """``over`` on ``base``: objects key by key, some lists end to end, else ``over`` - unless it is null."""
    if over is None:
        return base
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: deep_merge(base.get(k), v, (*path, k)) for k, v in over.items()}
    if isinstance(base, list) and isinstance(over, list) and path in APPENDED:
        return base + over
    return over


def _read(path: Path, seen: set[Path]) -> dict:
    path = path.resolve()
    if path in seen:
        return {}
    seen.add(path)
    if not path.is_file():
        raise ConfigError(f"no configuration at {path}")
    own = json.loads(path.read_text(encoding="utf-8"))
    globs = own.pop("include", None) or []
    out: dict = {}
    for pattern in [globs] if isinstance(globs, str) else globs:
        for found in sorted(path.parent.glob(pattern)):
            out = deep_merge(out, _read(found, seen))
    return deep_merge(out, own)


def _dotted(root: dict, path: str) -> Any:
    node: Any = root
    for p in path.split("."):
        node = node[p]
    return node


def resolve_refs(node: Any, root: dict, above: tuple[str, ...] = ()) -> Any:
    """{"$ref": "a.b"} becomes what is there; a reference to itself is an error."""
    if isinstance(node, dict):
        if set(node) == {"$ref"}:
            ref = node["$ref"]
            if ref in above:
                raise ConfigError(f"$ref leads back to itself: {ref}")
            return resolve_refs(_dotted(root, ref), root, (*above, ref))
        return {k: resolve_refs(v, root, above) for k, v in node.items()}
    if isinstance(node, list):
        return [resolve_refs(v, root, above) for v in node]
    return node


def interpolate(node: Any, root: dict) -> Any:
    """${x} in texts: a place in the configuration, else an environment variable, else left as it is."""

    def value(m: re.Match) -> str:
        try:
            found = _dotted(root, m[1])
            if not isinstance(found, dict | list):
                return str(found)
        except (KeyError, TypeError):
            pass
        return os.environ.get(m[1], m[0])

    if isinstance(node, str):
        return re.sub(r"\$\{([^}]+)\}", value, node)
    if isinstance(node, dict):
        return {k: interpolate(v, root) for k, v in node.items()}
    if isinstance(node, list):
        return [interpolate(v, root) for v in node]
    return node


def _type_is(v: Any, kinds: list[str]) -> bool:
    of = {"object": dict, "array": list, "string": str, "boolean": bool}
    return any((k == "null" and v is None) or (k == "number" and isinstance(v, int | float) and not isinstance(v, bool)) or (k in of and isinstance(v, of[k])) for k in kinds)


def check(config: dict) -> None:
    """Raise ConfigError with the place of the first thing that is wrong."""

    def fail(where: str, what: str) -> None:
        raise ConfigError(f"{where or '<root>'}: {what}")

    def typed(node: dict, where: str, **kinds: list[str]) -> None:
        for name, allowed in kinds.items():
            if name in node and not _type_is(node[name], allowed):
                fail(f"{where}{name}", f"{node[name]!r} is not of type {', '.join(repr(k) for k in allowed)}")

    for name in ("schema", "sources", "compile"):
        if name not in config:
            fail("", f"{name!r} is a required property")
    typed(config, "", version=["string", "number"], timezone=["string", "null"], output=["string", "null"], schema=["object"], sources=["array"], compile=["object"], compare=["object"], export=["object"])
    if "aliases" not in config["schema"]:
        fail("schema", "'aliases' is a required property")
    typed(config["schema"], "schema.", aliases=["object"])
    for name, spec in config["schema"]["aliases"].items():
        where = f"schema.aliases.{name}"
        if not isinstance(spec, dict):
            fail(where, f"{spec!r} is not of type 'object'")
        if "type" not in spec:
            fail(where, "'type' is a required property")
        if spec["type"] not in TYPES:
            fail(f"{where}.type", f"{spec['type']!r} is not one of {TYPES}")
        typed(spec, f"{where}.", identifier=["boolean"], not_null=["boolean"], enum=["array"], date=["object"])
        for v in spec.get("enum", []):
            if not isinstance(v, str):
                fail(f"{where}.enum", f"{v!r} is not of type 'string'")
        if "date" in spec:
            if "format" not in spec["date"]:
                fail(f"{where}.date", "'format' is a required property")
            typed(spec["date"], f"{where}.date.", format=["string"], granularity=["string"], abs_tol=["string"])


def load_config(path: str | Path, profile: str | None = None) -> Config:
    """Includes, then the profile, references, interpolation and the check."""
    path = Path(path)
    raw = _read(path, set())
    if profile:
        over = path.parent / "profiles" / f"{profile}.json"
        if over.is_file():
            raw = deep_merge(raw, _read(over, set()))
    raw = resolve_refs(raw, raw)
    raw = interpolate(raw, raw)
    check(raw)
    return Config(raw)
