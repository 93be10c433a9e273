"""Small configuration files, read and checked on the driver."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from pathlib import PurePosixPath


def label_map(path: str, expected: Sequence[str] | None = None) -> list[str]:
    """Labels in the order of their ids, which must run from 0; the order may be required."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    labels = sorted(given, key=given.__getitem__)
    if [given[x] for x in labels] != list(range(len(labels))):
        raise ValueError(f"ids aren't 0 to {len(labels) - 1}")
    if expected is not None and labels != list(expected):
        raise ValueError(f"labels in order {labels}, expected {list(expected)}")
    return labels


def safe_relative(path: str) -> str:
    """``path`` if it is relative and stays below its folder."""
    p = PurePosixPath(path.replace("\\", "/"))
    if not path or p.is_absolute() or ".." in p.parts or re.match(r"[A-Za-z]:", path):
        raise ValueError(f"unsafe path {path!r}")
    return str(p)


def check_ensemble(config: dict, folds: int) -> list[dict]:
    """The members of an ensemble in fold order: folds 0 to n - 1 once each, weights that aren't
    negative and sum to 1, safe relative paths, digests of 64 hex digits."""
    members = sorted(config["members"], key=lambda m: m["fold"])
    if [m["fold"] for m in members] != list(range(folds)):
        raise ValueError(f"folds {[m['fold'] for m in members]}, expected 0 to {folds - 1}")
    weights = [float(m["weight"]) for m in members]
    if any(not math.isfinite(w) or w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-8:
        raise ValueError(f"weights {weights}")
    for m in members:
        safe_relative(m["path"])
        if not re.fullmatch(r"[0-9a-fA-F]{64}", m["sha256"]):
            raise ValueError(f"digest {m['sha256']!r}")
    return members


def check_manifest(config: dict, labels: Sequence[str], model: dict, methods: Sequence[str]) -> list[dict]:
    """The ensemble's members, in fold order, of a model manifest that is right in every part:
    labels in their order; each field of ``model`` with its expected value (numbers and lists of
    numbers by value, texts without case); a known ensemble method; as many checkpoints as folds and
    weights, listed in fold order, each of them right by ``check_ensemble``."""
    if not isinstance(config, dict):
        raise ValueError("a manifest is an object")
    if list(config.get("labels") or ()) != list(labels):
        raise ValueError(f"labels {config.get('labels')}, expected {list(labels)}")
    given, checkpoints, ensemble = config.get("model"), config.get("checkpoints"), config.get("ensemble")
    if not isinstance(given, dict) or not isinstance(ensemble, dict):
        raise ValueError("model and ensemble are objects")
    for field, want in model.items():
        if not _equal(given.get(field), want):
            raise ValueError(f"model {field} {given.get(field)!r}, expected {want!r}")
    if ensemble.get("method") not in methods:
        raise ValueError(f"unknown method {ensemble.get('method')!r}, known: {sorted(methods)}")
    if not isinstance(checkpoints, list) or not checkpoints or not all(isinstance(x, dict) for x in checkpoints):
        raise ValueError("checkpoints are a list of objects, one at least")
    weights = ensemble.get("weights")
    if not isinstance(weights, list) or not len(weights) == len(checkpoints) == ensemble.get("fold_count"):
        raise ValueError("fold count, weights and checkpoints differ in number")
    if [x.get("fold") for x in checkpoints] != list(range(len(checkpoints))):
        raise ValueError("checkpoints aren't in fold order")
    return check_ensemble({"members": [x | {"weight": w, "path": str(x.get("path", "")), "sha256": str(x.get("sha256", ""))} for x, w in zip(checkpoints, weights, strict=True)]}, len(checkpoints))


def _equal(given: object, want: object) -> bool:
    if isinstance(want, str):
        return isinstance(given, str) and given.lower() == want.lower()
    if isinstance(want, (list, tuple)):
        return isinstance(given, (list, tuple)) and len(given) == len(want) and all(_equal(a, b) for a, b in zip(given, want, strict=True))
    return isinstance(given, (int, float)) and not isinstance(given, bool) and float(given) == float(want)


def label_version_file(version: str, files: dict[str, str]) -> str:
    """The file of a label version."""
    if version not in files:
        raise ValueError(f"unknown label version {version!r}, known: {sorted(files)}")
    return files[version]


def resolve_alias(name: str, aliases: dict[str, str]) -> str:
    """A model's full name from a short one; full names stay."""
    return aliases.get(name.strip().lower(), name)
