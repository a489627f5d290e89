"""Configuration of a run: loading, validation with all problems collected, defaults, CLI arguments."""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass
from typing import Any

DEFAULTS = dict(out=".plumbline", include=["**/*.md"], exclude=[], frozen=[], routes=[], total_row_labels="total Total 합계 총계 계".split())
DOCS_KEYS = ("root", "manifest", "include", "exclude", "frozen", "routes")
KNOWN_KEYS = ("$schema", "docs", "out", "ownership", "numbers", "measurements", "concepts", "schemas", "schemas_complete", "reuse_gates", "plugins")
_KEY = re.compile(r"[a-z][0-9a-z]*(?:_[0-9a-z]+)*\Z")


class Problems(ValueError):
    """An input that breaks its contract, with every violation found."""

    def __init__(self, message: str, problems: list[str] | None = None):
        self.problems = list(problems or [])
        super().__init__("\n- ".join([message, *self.problems]))


class ConfigError(Problems):
    pass


@dataclass(frozen=True)
class RunContext:
    config: dict
    config_path: str
    repo_root: str
    docs_root: str
    out_dir: str


def is_object(x: Any) -> bool:
    return isinstance(x, dict)


def _filled(x: Any) -> bool:
    return isinstance(x, str) and len(x) > 0


def check_string(x: Any, path: str, problems: list[str], required: bool = False) -> None:
    if x is None:
        if required:
            problems.append(f"{path}: required")
    elif not _filled(x):
        problems.append(f"{path}: must be a non-empty string")


def check_strings(x: Any, path: str, problems: list[str]) -> None:
    if x is not None and not (isinstance(x, list) and all(map(_filled, x))):
        problems.append(f"{path}: must be an array of non-empty strings")


def check_pattern(x: Any, path: str, problems: list[str]) -> None:
    check_string(x, path, problems)
    if isinstance(x, str):
        try:
            re.compile(x)
        except re.error as e:
            problems.append(f"{path}: not a regular expression ({e})")


def check_keys(x: dict, allowed: tuple[str, ...], path: str, problems: list[str]) -> None:
    problems += [f"{path}.{k}: unknown key" for k in x if k not in allowed]


def validate_config(raw: Any) -> list[str]:
    """All violations; none for a valid configuration."""
    if not is_object(raw):
        return ["config: must be an object"]
    problems: list[str] = []
    docs = raw.get("docs")
    if not is_object(docs):
        problems.append("docs: must be an object (required)")
    else:
        check_string(docs.get("root"), "docs.root", problems, required=True)
        check_string(docs.get("manifest"), "docs.manifest", problems)
        for key in DOCS_KEYS[2:]:
            check_strings(docs.get(key), f"docs.{key}", problems)
        check_keys(docs, DOCS_KEYS, "docs", problems)
    check_string(raw.get("out"), "out", problems)
    for name, fields in (("ownership", {"what": True, "owner": True, "hint": False}), ("measurements", {"label": True, "cmd": True, "expect_in": None})):
        entries = raw.get(name)
        if entries is None:
            continue
        if not isinstance(entries, list):
            problems.append(f"{name}: must be an array")
            continue
        for i, entry in enumerate(entries):
            path = f"{name}[{i}]"
            if not is_object(entry):
                problems.append(f"{path}: must be an object")
                continue
            for key, required in fields.items():
                if required is None:
                    check_strings(entry.get(key), f"{path}.{key}", problems)
                else:
                    check_string(entry.get(key), f"{path}.{key}", problems, required)
            check_keys(entry, tuple(fields), path, problems)
    numbers = raw.get("numbers")
    if numbers is not None:
        if not is_object(numbers):
            problems.append("numbers: must be an object")
        else:
            check_pattern(numbers.get("marker_pattern"), "numbers.marker_pattern", problems)
            check_strings(numbers.get("labels"), "numbers.labels", problems)
            check_strings(numbers.get("total_row_labels"), "numbers.total_row_labels", problems)
            check_keys(numbers, ("marker_pattern", "labels", "total_row_labels"), "numbers", problems)
    for key in ("concepts", "schemas", "reuse_gates", "plugins"):
        check_strings(raw.get(key), key, problems)
    if raw.get("schemas_complete") is not None and not isinstance(raw["schemas_complete"], bool):
        problems.append("schemas_complete: must be a boolean")
    problems += [f"{k}: top-level keys are lower snake_case" for k in raw if k not in KNOWN_KEYS and not _KEY.match(k)]
    return problems


def normalize_config(raw: Any, source: str = "<memory>") -> dict:
    if problems := validate_config(raw):
        raise ConfigError(f"invalid configuration ({source})", problems)
    config = copy.deepcopy(raw)
    config.setdefault("out", DEFAULTS["out"])
    for key in ("include", "exclude", "frozen", "routes"):
        config["docs"].setdefault(key, list(DEFAULTS[key]))
    if config.get("numbers"):
        config["numbers"].setdefault("total_row_labels", list(DEFAULTS["total_row_labels"]))
    config.setdefault("plugins", [])
    return config


def context_of(config: dict, repo_root: str, config_path: str = "plumbline.json") -> RunContext:
    """A context from a configuration at hand."""
    config = normalize_config(config)
    root = os.path.abspath(repo_root)
    return RunContext(config, os.path.join(root, config_path), root, os.path.normpath(os.path.join(root, config["docs"]["root"])), os.path.normpath(os.path.join(root, config["out"])))


def load_config(path: str, repo_root: str | None = None) -> RunContext:
    path = os.path.abspath(path)
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except OSError as e:
        raise ConfigError(f"can't read the configuration {path} ({e.strerror})") from e
    except ValueError as e:
        raise ConfigError(f"the configuration is not JSON: {path} ({e})") from e
    config = normalize_config(raw, path)
    root = os.path.abspath(repo_root) if repo_root else os.path.dirname(path)
    return RunContext(config, path, root, os.path.normpath(os.path.join(root, config["docs"]["root"])), os.path.normpath(os.path.join(root, config["out"])))


def has_config_key(config: dict, key: str) -> bool:
    """Whether a key is really filled: empty lists, objects and strings count as absent, False and 0 as present."""
    x = (config or {}).get(key)
    if x is None:
        return False
    return len(x) > 0 if isinstance(x, (list, dict, str)) else True


def config_reference(context: RunContext) -> str:
    return os.path.relpath(context.config_path, context.repo_root).replace(os.sep, "/")


def parse_cli_args(argv: list[str], flags: tuple[str, ...] = ("config", "repo"), repeatable: tuple[str, ...] = (), required: tuple[str, ...] = ("config",)) -> dict:
    """--flag value and --flag=value; repeatable flags collect a list. Keys have _ for -."""
    key = lambda flag: flag.replace("-", "_")
    args: dict[str, Any] = {key(f): None for f in flags} | {key(f): [] for f in repeatable}
    at = 0
    while at < len(argv):
        flag, eq, value = argv[at].partition("=")
        if not flag.startswith("--") or flag[2:] not in (*flags, *repeatable):
            raise ConfigError(f"unknown argument: {argv[at]}")
        if not eq:
            at += 1
            if at >= len(argv) or argv[at].startswith("--"):
                raise ConfigError(f"{flag} has no value")
            value = argv[at]
        if flag[2:] in repeatable:
            args[key(flag[2:])].append(value)
        else:
            args[key(flag[2:])] = value
        at += 1
    for flag in required:
        if not args[key(flag)]:
            raise ConfigError(f"--{flag} is required")
    return args
