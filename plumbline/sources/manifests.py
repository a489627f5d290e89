"""Declared JSON sources: document ids, in the two readings that links and decisions have, and decision cards."""

from __future__ import annotations

import json
import os
import posixpath
import re

from plumbline.context import Problems, RunContext

_LIST_KEYS = ("docs", "documents", "entries", "items")


class SourceError(Problems):
    pass


def _first_string(entry: dict, keys: tuple[str, ...]) -> str | None:
    x = next((entry[k] for k in keys if entry.get(k) is not None), None)
    return x if isinstance(x, str) and x else None


def manifest_entries(raw) -> list[dict] | None:
    """id, path and title of each entry of a manifest of any shape; the first of an id wins. None: no manifest."""
    if isinstance(raw, dict):
        listed = next((raw[k] for k in _LIST_KEYS if isinstance(raw.get(k), list)), None)
        if listed is None:
            listed = [{"id": k, **(v if isinstance(v, dict) else {})} for k, v in raw.items()]
    elif isinstance(raw, list):
        listed = raw
    else:
        return None
    out: dict[str, dict] = {}
    for entry in listed:
        if isinstance(entry, str):
            entry = {"id": entry}
        if not isinstance(entry, dict):
            continue
        id_ = _first_string(entry, ("id", "docId", "slug", "anchor", "key", "name"))
        if not id_:
            continue
        ns = _first_string(entry, ("ns", "namespace", "group"))
        full = f"{ns}/{id_}" if ns and "/" not in id_ else id_
        text = lambda *keys: next((entry[k] for k in keys if isinstance(entry.get(k), str)), None)
        out.setdefault(full, {"id": full, "path": text("path", "file"), "title": text("title", "name")})
    return list(out.values())


def load_links_manifest(context: RunContext) -> tuple[bool, list[dict], str | None]:
    """declared, entries, and why they can't be read."""
    path = context.config["docs"].get("manifest")
    if not path:
        return False, [], None
    try:
        with open(os.path.join(context.repo_root, path), encoding="utf-8") as f:
            entries = manifest_entries(json.load(f))
    except (OSError, ValueError) as e:
        return True, [], getattr(e, "strerror", None) or str(e)
    return (True, [], "neither an array nor an object") if entries is None else (True, entries, None)


def candidate_paths(entry: dict, docs_root: str) -> list[str]:
    """Where a manifest's document may be, the likeliest first."""
    prefix = posixpath.normpath(docs_root).rstrip("/") + "/"
    out = []
    for x in (entry.get("path"), f"{entry['id']}.md", f"{entry['id']}.markdown"):
        if x:
            n = posixpath.normpath(re.sub(r"^\.?/", "", x))
            out += [n, n[len(prefix) :]] if n.startswith(prefix) else [n]
    return out


def load_decision_manifest(context: RunContext) -> dict[str, str]:
    """id to path under docs.root; paths are relative to the manifest. Whatever is wrong with it, an empty one; the last of an id wins."""
    path = context.config["docs"].get("manifest")
    if not path:
        return {}
    at = os.path.join(context.repo_root, path)
    try:
        with open(at, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError):
        return {}
    listed = raw if isinstance(raw, list) else raw.get("docs") if isinstance(raw, dict) and isinstance(raw.get("docs"), list) else []
    out = {}
    for x in listed:
        if isinstance(x, dict) and isinstance(x.get("id"), str):
            file = x.get("file") if x.get("file") is not None else x.get("path")
            if isinstance(file, str):
                out[x["id"]] = os.path.relpath(os.path.join(os.path.dirname(at), file), context.docs_root).replace(os.sep, "/")
    return out


def card_list(raw, exact: re.Pattern) -> list[dict] | None:
    """The root, or the first property, that is a list of objects with ids, one of which is a decision's."""

    def good(x) -> bool:
        return isinstance(x, list) and bool(x) and all(isinstance(i, dict) and isinstance(i.get("id"), str) for i in x) and any(exact.match(i["id"]) for i in x)

    if good(raw):
        return raw
    return next((v for v in raw.values() if good(v)), None) if isinstance(raw, dict) else None


def load_cards(path: str, id_pattern: str) -> list[tuple[str, str | None, int | None]]:
    """(id, status, line) of each card; line is the first that has the id in quotes."""
    exact = re.compile(rf"(?:{id_pattern})\Z")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        found = card_list(json.loads(text), exact)
    except ValueError as e:
        raise SourceError(f"adr.cards is not JSON: {path} ({e})") from e
    if found is None:
        raise SourceError(f"adr.cards has no list of decision cards: {path}")
    lines = re.split(r"\r\n|\r|\n", text)
    out = {}
    for x in found:
        if exact.match(x["id"]):
            line = next((n for n, t in enumerate(lines, 1) if f'"{x["id"]}"' in t), None)
            out[x["id"]] = (x["id"], x["status"] if isinstance(x.get("status"), str) else None, line)
    return list(out.values())
