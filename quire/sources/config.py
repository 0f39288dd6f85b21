"""Settings of a run: layers over defaults, closed schema, rules between fields. Control plane: plain dictionaries."""

from __future__ import annotations

import glob
import json
import os

from quire.sources.files import deep_merge

#: name: (type, default, least, most)
SCHEMA = {
    "concurrency": (int, 5, 1, 10),
    "pageTimeout": (int, 30000, 1000, None),
    "maxPaginationPages": (int, 10, 1, None),
    "logLevel": (str, "info", None, None),
    "rootURL": (str, "", None, None),
    "baseUrl": (str, "", None, None),
    "contentSelector": (str, "article", None, None),
    "ignoreURLs": (list, [], None, None),
    "allowedDomains": (list, [], None, None),
    "targetUrls": (list, [], None, None),
    "markdown.enabled": (bool, True, None, None),
    "markdownPdf.enabled": (bool, True, None, None),
    "markdownPdf.batchMode": (bool, False, None, None),
    "markdownPdf.maxCodeLineLength": (int, 80, 1, None),
    "markdownSource.enabled": (bool, False, None, None),
    "translation.enabled": (bool, False, None, None),
    "translation.bilingual": (bool, False, None, None),
    "annotations.enabled": (bool, False, None, None),
}


def flat(value: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in value.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def validated(*layers: dict) -> tuple[dict, list[str]]:
    """(settings by dotted name with defaults, all errors): unknown names, types, ranges, and rules between fields."""
    given = flat(deep_merge({}, *layers))
    errors = [f"unknown setting: {k}" for k in given if k not in SCHEMA]
    out = {}
    for name, (kind, default, least, most) in SCHEMA.items():
        v = out[name] = given.get(name, default)
        if not isinstance(v, kind) or kind is int and isinstance(v, bool):
            errors.append(f"{name}: not {kind.__name__}")
        elif kind is int and (least is not None and v < least or most is not None and v > most):
            errors.append(f"{name}: out of range")
    on = lambda k: out[k] is True
    book = on("markdown.enabled") and on("markdownPdf.enabled")
    rules = {
        "markdownPdf needs markdown": on("markdownPdf.enabled") and not on("markdown.enabled"),
        "native sources and batch mode need Markdown books": (on("markdownSource.enabled") or on("markdownPdf.batchMode")) and not book,
        "annotations need Markdown books": on("annotations.enabled") and not book,
        "annotations and translation exclude each other": on("annotations.enabled") and on("translation.enabled"),
    }
    return out, errors + [text for text, broken in rules.items() if broken]


def targets(folder: str) -> list[str]:
    """Names of the targets in a folder, sorted."""
    return sorted(os.path.basename(p)[:-5] for p in glob.glob(f"{folder}/*.json"))


def load(*paths: str) -> tuple[dict, list[str]]:
    """Base, target and profile files, later ones over earlier ones."""
    layers = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            layers.append(json.load(f))
    return validated(*layers)
