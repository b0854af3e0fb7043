"""Settings of the photo pipeline: defaults, limits, and which source wins."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from types import SimpleNamespace


def _within(low: float, high: float = float("inf")) -> Callable[[object], bool]:
    return lambda v: isinstance(v, (int, float)) and low <= v <= high


def _one_of(*names: str) -> Callable[[object], bool]:
    return lambda v: v in names


def _flag(v: object) -> bool:
    return isinstance(v, bool)


#: Name: default value and what is allowed.
SETTINGS: dict[str, tuple[object, Callable[[object], bool]]] = {
    "detection_confidence": (0.5, _within(0, 1)),
    "min_face_size": (40, _within(1)),
    "min_face_quality": (0.15, _within(0, 1)),
    "cluster_method": ("dbscan", _one_of("dbscan", "hdbscan")),
    "min_cluster_size": (2, _within(2)),
    "cluster_selection_epsilon": (0.0, _within(0)),
    "cluster_selection_method": ("eom", _one_of("eom", "leaf")),
    "eps": (0.5, _within(1e-9)),
    "min_samples": (2, _within(1)),
    "auto_eps": (False, _flag),
    "merge_threshold": (0.80, _within(0, 1)),
    "small_merge_threshold": (0.75, _within(0, 1)),
    "min_reliable_size": (10, _within(2)),
    "folder_prefix": ("person_", lambda v: isinstance(v, str)),
    "include_unclustered": (False, _flag),
    "include_no_faces": (False, _flag),
    "multi_face_strategy": ("primary", _one_of("primary", "all")),
}


def settings(*sources: dict[str, object]) -> SimpleNamespace:
    """Defaults under the given sources, later ones over earlier ones; a None in a source says nothing.

    Unknown names and values outside their limits are errors.
    """
    merged = {name: default for name, (default, _) in SETTINGS.items()}
    for source in sources:
        for name, value in source.items():
            if name not in SETTINGS:
                raise ValueError(f"unknown setting {name}")
            if value is not None:
                merged[name] = value
    for name, value in merged.items():
        if not SETTINGS[name][1](value):
            raise ValueError(f"{name} must not be {value!r}")
    return SimpleNamespace(**merged)


def from_toml(text: str) -> dict[str, object]:
    """Settings of a TOML text; its sections only group them."""
    flat: dict[str, object] = {}
    for name, value in tomllib.loads(text).items():
        flat |= value if isinstance(value, dict) else {name: value}
    return flat
