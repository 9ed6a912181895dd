"""Project configuration and path-alias configuration, read on the driver into policies and rules."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, replace

from ..policy import HealthPolicy, HistoryPolicy

FILE = ".tidemark.toml"
_LIMITS = {"cognitive": "cognitive", "cyclomatic": "cyclomatic", "function_lines": "logical_lines", "nesting": "max_nesting",
           "parameters": "parameter_count"}
_ROLES = ("primary", "test", "example", "benchmark", "fixture", "generated", "vendored")
_KEYS = {"exclude": None, "history": None, "workers": None, "thresholds": {*_LIMITS, "file_lines", "container_lines"},
         "source_roles": {*_ROLES}, "hotspots": {"minimum_touches"}}


@dataclass(frozen=True)
class Config:
    health: HealthPolicy = HealthPolicy()
    history: HistoryPolicy = HistoryPolicy()
    excludes: tuple[str, ...] = ()
    #: Glob pattern to role, in the order of the roles.
    roles: dict = field(default_factory=dict)


def parse(text: str) -> Config:
    """A configuration; ValueError for unknown keys, limits that do not rise, days that are none and conflicting roles."""
    t = tomllib.loads(text)
    for key, value in t.items():
        if key not in _KEYS or (_KEYS[key] is not None and not (isinstance(value, dict) and value.keys() <= _KEYS[key])):
            raise ValueError(f"unknown setting in {key}")
    limits, sizes = dict(HealthPolicy().limits), {}
    for name, pair in t.get("thresholds", {}).items():
        if set(pair) != {"watch", "high"} or not 0 < pair["watch"] < pair["high"]:
            raise ValueError(f"thresholds.{name}: high must be above watch, watch above zero")
        if name in _LIMITS:
            limits[_LIMITS[name]] = (pair["watch"], pair["high"])
        else:
            sizes["file_lines" if name == "file_lines" else "container_statements"] = (pair["watch"], pair["high"])
    history = HistoryPolicy()
    if "history" in t:
        m = re.fullmatch(r"([1-9]\d*)d", str(t["history"]))
        if not m:
            raise ValueError("history: a number of days such as 90d")
        history = replace(history, window_days=int(m[1]))
    touches = t.get("hotspots", {}).get("minimum_touches")
    if touches is not None:
        if touches < 1:
            raise ValueError("hotspots.minimum_touches: at least one")
        history = replace(history, hotspot_touches=touches)
    roles: dict[str, str] = {}
    for role in _ROLES:
        for pattern in t.get("source_roles", {}).get(role, []):
            if not pattern.strip():
                raise ValueError("source_roles: an empty pattern")
            if roles.setdefault(pattern, role) != role:
                raise ValueError(f"source_roles: {pattern!r} is both {roles[pattern]} and {role}")
    return Config(HealthPolicy(limits=limits, **sizes), history, tuple(t.get("exclude", ())), roles)


def load(start: str) -> Config:
    """The configuration of the nearest folder above start that has one."""
    at = os.path.abspath(start if os.path.isdir(start) else os.path.dirname(start))
    while True:
        if os.path.isfile(os.path.join(at, FILE)):
            with open(os.path.join(at, FILE)) as f:
                return parse(f.read())
        up = os.path.dirname(at)
        if up == at:
            return Config()
        at = up


def without_comments(text: str) -> str:
    """JSON with its comments and trailing commas taken out; strings stay as they are."""
    part = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = part.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare)


def alias_rules(root: str, config: str) -> list[tuple[str, str, str, str]]:
    """(package, prefix, suffix, replacement) of a script configuration and of those it extends, nearest first.

    ValueError for a chain that runs in a circle, leaves the root, or cannot be read.
    """
    seen: list[str] = []
    base, found, at = None, None, os.path.normpath(config)
    while at:
        if at in seen:
            raise ValueError(f"{at} extends itself")
        if at.startswith(".."):
            raise ValueError(f"{at} is outside")
        seen.append(at)
        try:
            with open(os.path.join(root, at)) as f:
                t = json.loads(without_comments(f.read()))
        except OSError as e:
            raise ValueError(f"{at} cannot be read") from e
        o, here = t.get("compilerOptions", {}), os.path.dirname(at)
        if base is None and "baseUrl" in o:
            base = os.path.normpath(os.path.join(here, o["baseUrl"]))
        if found is None and "paths" in o:
            found = (os.path.normpath(os.path.join(here, o.get("baseUrl", "."))), o["paths"])
        up = t.get("extends")
        if up is not None and not up.startswith("."):
            break  # a package's configuration is no part of the tree
        at = os.path.normpath(os.path.join(here, up if up.endswith(".json") else f"{up}.json")) if up else ""
    package, rules = os.path.dirname(os.path.normpath(config)) or ".", []
    for pattern, targets in (found[1] if found else {}).items():
        prefix, star, suffix = pattern.partition("*")
        for target in targets:
            rules.append((package, prefix, suffix if star else "", os.path.normpath(os.path.join(found[0], target))))
    if base is not None:
        rules.append((package, "", "", os.path.normpath(os.path.join(base, "*"))))
    return rules
