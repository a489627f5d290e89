"""The registry of axes: which exist, which are active under a configuration, and why others are skipped."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Any

from plumbline.context import Problems, has_config_key, is_object

KINDS = ("script", "judgment", "hybrid")
CAPS = ("block", "warn", "info")
AXIS_KEYS = ("name", "title", "kind", "run", "when", "severity_cap")
NAME = re.compile(r"[a-z][0-9a-z]*(?:-[0-9a-z]+)*\Z")


class ManifestError(Problems):
    pass


@dataclass(frozen=True)
class Axis:
    name: str
    title: str
    kind: str
    requires: tuple[str, ...] = ()
    severity_cap: str = "block"
    source: str = "core"
    script: str | None = None
    contract: str | None = None
    run: Callable | None = field(default=None, compare=False)
    state: str = "active"
    reason: str | None = None


def validate_manifest(raw: Any) -> list[str]:
    if not is_object(raw):
        return ["manifest: must be an object"]
    if not isinstance(raw.get("axes"), list):
        return ["axes: must be an array (required)"]
    problems: list[str] = []
    seen: set[str] = set()
    for i, axis in enumerate(raw["axes"]):
        path = f"axes[{i}]"
        if not is_object(axis):
            problems.append(f"{path}: must be an object")
            continue
        name, kind, run, when = axis.get("name"), axis.get("kind"), axis.get("run"), axis.get("when")
        if not isinstance(name, str) or not NAME.match(name):
            problems.append(f"{path}.name: must be kebab-case")
        elif name in seen:
            problems.append(f"{path}.name: {name} occurs twice in one manifest")
        else:
            seen.add(name)
        if "title" in axis and not isinstance(axis["title"], str):
            problems.append(f"{path}.title: must be a string")
        if kind not in KINDS:
            problems.append(f"{path}.kind: one of {', '.join(KINDS)}")
        if not is_object(run):
            problems.append(f"{path}.run: must be an object (required)")
        else:
            problems += [f"{path}.run.{k}: unknown key" for k in run if k not in ("script", "contract")]
            for key, kinds in (("script", ("script", "hybrid")), ("contract", ("judgment", "hybrid"))):
                if kind in kinds and not isinstance(run.get(key), str):
                    problems.append(f"{path}.run.{key}: required for kind {kind}")
                if kind not in kinds and key in run:
                    problems.append(f"{path}.run.{key}: not allowed for kind {kind}")
        if when is not None:
            if not is_object(when):
                problems.append(f"{path}.when: must be an object")
            else:
                problems += [f"{path}.when.{k}: unknown key" for k in when if k != "requires"]
                needs = when.get("requires")
                if needs is not None and not (isinstance(needs, list) and all(isinstance(x, str) and x for x in needs)):
                    problems.append(f"{path}.when.requires: must be an array of strings")
        if "severity_cap" in axis and axis["severity_cap"] not in CAPS:
            problems.append(f"{path}.severity_cap: one of {', '.join(CAPS)}")
        problems += [f"{path}.{k}: unknown key" for k in axis if k not in AXIS_KEYS]
    return problems


def axes_of(raw: Any, source: str) -> list[Axis]:
    if problems := validate_manifest(raw):
        raise ManifestError(f"invalid manifest ({source})", problems)
    base = os.path.dirname(source)
    at = lambda p: os.path.normpath(os.path.join(base, p)) if p else None
    return [Axis(x["name"], x.get("title", x["name"]), x["kind"], tuple((x.get("when") or {}).get("requires") or ()), x.get("severity_cap", "block"), source, at(x["run"].get("script")), at(x["run"].get("contract"))) for x in raw["axes"]]


def load_manifest(path: str, check_exists: bool = False) -> list[Axis]:
    path = os.path.abspath(path)
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except OSError as e:
        raise ManifestError(f"can't read the manifest {path} ({e.strerror})") from e
    except ValueError as e:
        raise ManifestError(f"the manifest is not JSON: {path} ({e})") from e
    axes = axes_of(raw, path)
    if check_exists:
        missing = [f"{a.name}: {p}" for a in axes for p in (a.script, a.contract) if p and not os.path.exists(p)]
        if missing:
            raise ManifestError(f"registered files are missing ({path})", missing)
    return axes


def merge_manifests(manifests: list[list[Axis]]) -> list[Axis]:
    """All axes; a name that two manifests register is an error."""
    by_name: dict[str, Axis] = {}
    for axis in (a for axes in manifests for a in axes):
        if axis.name in by_name:
            raise ManifestError(f"axis {axis.name} is registered twice ({by_name[axis.name].source}, {axis.source})")
        by_name[axis.name] = axis
    return list(by_name.values())


def resolve_axes(axes: list[Axis], config: dict, only: list[str] | None = None) -> list[Axis]:
    """Each axis active, or skipped with its reason; none is left out."""
    if only is not None and (unknown := [n for n in only if n not in {a.name for a in axes}]):
        raise ManifestError(f"unknown axes: {', '.join(unknown)}", [f"registered: {', '.join(a.name for a in axes)}"])
    out = []
    for axis in axes:
        missing = [k for k in axis.requires if not has_config_key(config, k)]
        if only is not None and axis.name not in only:
            out.append(replace(axis, state="skipped", reason="not selected by --axes"))
        elif missing:
            out.append(replace(axis, state="skipped", reason="the configuration has no " + ", ".join(missing)))
        else:
            out.append(replace(axis, state="active", reason=None))
    return out


def parse_axis_selection(value: str | None) -> list[str] | None:
    if value is None:
        return None
    names = list(dict.fromkeys(x.strip() for x in value.split(",") if x.strip()))
    if not names:
        raise ManifestError("--axes names no axis")
    return names


def core_axes(commands: bool = False) -> list[Axis]:
    """commands: whether measurements that the configuration declares are run in a shell."""
    from plumbline.operators import concepts, links, numbers, ownership

    return [
        Axis("numbers", "Numbers", "script", run=partial(numbers.run_axis, run=numbers.run_command if commands else None), script="numbers"),
        Axis("ownership", "Restated facts", "hybrid", ("ownership",), run=ownership.run_axis, script="ownership", contract="ownership"),
        Axis("concepts", "Names and terms", "hybrid", run=concepts.run_axis, script="concepts", contract="concepts"),
        Axis("links", "Links and anchors", "script", run=links.run_axis, script="links"),
    ]


def _adr() -> list[Axis]:
    from plumbline.operators import decisions

    return [Axis("decisions", "Decisions carried through", "hybrid", ("adr",), source="plugin adr", run=decisions.run_axis, script="decisions", contract="decisions")]


#: Plugins by name: each gives its axes.
PLUGINS: dict[str, Callable[[], list[Axis]]] = {"adr": _adr}


def load_axes(config: dict, only: list[str] | None = None, core: list[Axis] | None = None) -> list[Axis]:
    """Core and declared plugins, merged and resolved against config."""
    manifests = [core_axes() if core is None else core]
    for name in config.get("plugins") or []:
        if not NAME.match(name):
            raise ManifestError(f"plugin name {name!r} is not kebab-case")
        if name not in PLUGINS:
            raise ManifestError(f"plugin {name} is not installed")
        manifests.append(PLUGINS[name]())
    return resolve_axes(merge_manifests(manifests), config, only)
