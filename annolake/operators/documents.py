"""Documents of a project: scene templates, profiles, project manifests, configurations (R9, S17, K25, P9,
P10, X8, X11). Plain Python, before any job runs.
"""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field, fields

from annolake.functions import recipes
from annolake.functions.masks import REGION_MODES
from annolake.operators.planning import hard_case
from annolake.sources import store

VERSIONS = {"scene-template": 2, "distribution-profile": 1, "scene-recipe": 1, "object-recipe": 1, "project": 1}
#: The parameters of a template that varies nothing.
EXACT = {
    "position_jitter_x": 0.0, "position_jitter_y": 0.0, "scale_jitter": 0.0, "angle_jitter": 0.0, "instance_probability": 1.0, "flip_probability": None,
    "same_class_random": False, "allow_overlap": True,
}
OUTPUT_FORMATS = ("detect", "seg", "both", "coco", "semantic", "obb", "all")
BLEND_MODES = ("alpha", "hard", "gaussian")
MASK_MODES = ("grabcut", "reject", "legacy")
SAMPLING = ("balanced", "random")


def load(path: str, kind: str) -> dict:
    """A document of a kind, of this version or an older one."""
    doc = store.read_json(path)
    if not isinstance(doc, dict) or doc.get("schema") != kind:
        raise ValueError(f"{path} is no {kind}")
    if int(doc.get("version", 1)) > VERSIONS[kind]:
        raise ValueError(f"{path} has version {doc['version']}, newer than {VERSIONS[kind]}")
    return doc


def load_checked(kind: str, doc: dict) -> dict:
    """A document that was just made, with its kind and version."""
    return doc | {"schema": kind, "version": VERSIONS[kind]}


def save(path: str, kind: str, doc: dict) -> dict:
    """Writes a document with its kind and version."""
    out = doc | {"schema": kind, "version": VERSIONS[kind]}
    store.write_json(path, out)
    return out


def portable_source(source: str) -> str:
    """The file name of a source, its shape number kept."""
    path, mark, shape = str(source).rpartition("#")
    return os.path.basename((path if mark else source).replace("\\", "/")) + (f"#{shape}" if mark else "")


def upgraded(template: dict) -> dict:
    """A template of any version as one of this: ids, source names and defaults filled in."""
    if int(template.get("version", 1)) > VERSIONS["scene-template"]:
        raise ValueError(f"template version {template['version']} is newer than {VERSIONS['scene-template']}")
    out = copy.deepcopy(template)
    rows = out.setdefault("instances", [])
    if not isinstance(rows, list):
        raise ValueError("instances must be a list")
    for k, row in enumerate(r for r in rows if isinstance(r, dict)):
        for name, value in (("id", f"slot_{k + 1:03d}"), ("source_name", portable_source(row.get("source", ""))), ("flip", False), ("angle", 0.0)):
            row.setdefault(name, value)
    out.setdefault("canvas", {"width": 1, "height": 1})
    out.setdefault("constraints", [])
    out.setdefault("parameters", dict(EXACT))
    return out | {"version": VERSIONS["scene-template"]}


def _about(x: float, by: float, lo: float, hi: float) -> list[float]:
    return [min(hi, max(lo, x - by)), min(hi, max(lo, x + by))]


def parameterized(template: dict, position_x: float = 0.03, position_y: float = 0.02, scale: float = 0.10, angle: float = 5.0, probability: float = 1.0, flip: float | None = None, same_class_random: bool = False, allow_overlap: bool = True) -> dict:
    """A template whose instances vary about their places."""
    out = upgraded(template)
    unit = lambda v: None if v is None else min(1.0, max(0.0, float(v)))
    every = {"flip_probability": unit(flip), "same_class_random": bool(same_class_random), "allow_overlap": bool(allow_overlap)}
    jitter = {"position_jitter_x": position_x, "position_jitter_y": position_y, "scale_jitter": scale, "angle_jitter": angle}
    out["parameters"] = {k: max(0.0, float(v)) for k, v in jitter.items()} | {"instance_probability": unit(probability)} | every
    for row in (r for r in out["instances"] if isinstance(r, dict)):
        h, turn = float(row.get("h_ratio", 0.2)), float(row.get("angle", 0.0))
        row["variation"] = {
            "cx_range": _about(float(row.get("cx_ratio", 0.5)), position_x, 0.0, 1.0), "cy_range": _about(float(row.get("cy_ratio", 0.5)), position_y, 0.0, 1.0),
            "h_range": _about(h, h * scale, 0.01, 1.5), "angle_range": [turn - angle, turn + angle], "enabled_probability": unit(probability), **every,
        }
    return out


def from_layout(width: int, height: int, rows: list[dict]) -> dict:
    """An exact template of a layout."""
    return upgraded({"schema": "scene-template", "canvas": {"width": int(width), "height": int(height)}, "instances": [dict(r) for r in rows]})


@dataclass
class Config:
    """What a generation run is told; ``checked`` refuses what cannot be meant."""

    objects_dir: str
    backgrounds_dir: str
    output_dir: str
    class_map: dict[str, int]
    count: int = 100
    min_objects: int = 1
    max_objects: int = 3
    y_min: float = 0.35
    y_max: float = 0.95
    far_height: float = 0.08
    near_height: float = 0.32
    max_iou: float = 0.15
    preview_ratio: float = 1.0
    background_cache_size: int = 16
    coco_checkpoint_interval: int = 1000
    asset_sampling: str = "balanced"
    background_sampling: str = "balanced"
    rectangle_mask_mode: str = "grabcut"
    output_format: str = "detect"
    workers: int = 1
    queue_depth: int = 0
    profile_strength: float = 1.0
    empty_scene_probability: float = 0.0
    blend_mode: str = "alpha"
    blend_sigma: float = 1.5
    scene_region_mode: str = "auto"
    hardcase_recipe: str | None = None
    augmentation_recipe: str | None = None
    object_appearance_recipe: str | None = None
    distribution_profile: str | None = None
    scene_template: str | None = None

    def checked(self) -> Config:
        unit = lambda x: 0.0 <= x <= 1.0
        rules = [
            (store.is_dir(self.objects_dir), "objects_dir must be a folder"), (store.is_dir(self.backgrounds_dir), "backgrounds_dir must be a folder"), (self.count > 0, "count must be above 0"),
            (0 <= self.min_objects <= self.max_objects, "object counts must satisfy 0 <= min <= max"), (0 <= self.y_min < self.y_max <= 1, "the ground must satisfy 0 <= y_min < y_max <= 1"),
            (0 < self.far_height <= self.near_height < 1, "heights must satisfy 0 < far <= near < 1"), (unit(self.max_iou), "max_iou must lie in [0, 1]"), (unit(self.preview_ratio), "preview_ratio must lie in [0, 1]"),
            (self.background_cache_size >= 0, "background_cache_size must not be negative"), (self.coco_checkpoint_interval >= 0, "coco_checkpoint_interval must not be negative"),
            (self.asset_sampling in SAMPLING, f"asset_sampling must be one of {SAMPLING}"), (self.background_sampling in SAMPLING, f"background_sampling must be one of {SAMPLING}"),
            (self.rectangle_mask_mode in MASK_MODES, f"rectangle_mask_mode must be one of {MASK_MODES}"), (self.output_format in OUTPUT_FORMATS, f"output_format must be one of {OUTPUT_FORMATS}"),
            (self.workers >= 0, "workers must not be negative"), (self.queue_depth >= 0, "queue_depth must not be negative"), (unit(self.profile_strength), "profile_strength must lie in [0, 1]"),
            (unit(self.empty_scene_probability), "empty_scene_probability must lie in [0, 1]"), (self.blend_mode in BLEND_MODES, f"blend_mode must be one of {BLEND_MODES}"), (self.blend_sigma >= 0, "blend_sigma must not be negative"),
            (self.scene_region_mode in REGION_MODES, f"scene_region_mode must be one of {REGION_MODES}"),
            (not self.distribution_profile or store.is_file(self.distribution_profile), "distribution_profile must be a file"), (not self.scene_template or store.is_file(self.scene_template), "scene_template must be a file"),
        ]
        for holds, text in rules:
            if not holds:
                raise ValueError(text)
        hard_case(self.hardcase_recipe)
        recipes.scene_recipe(self.augmentation_recipe)
        recipes.object_recipe(self.object_appearance_recipe)
        return self

    def hash_payload(self) -> dict:
        """What a resumed run must have in common with the one that began: all but what only changes its speed."""
        aside = {"workers", "queue_depth", "preview_ratio", "background_cache_size", "coco_checkpoint_interval", "output_dir"}
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in aside}


PATHS = {
    "objects": "dir", "backgrounds": "dir", "output": "out", "real_dataset": "dir", "validation_dataset": "dir", "predictions": "dir", "distribution_profile": "file", "scene_template": "file",
}


@dataclass
class Project:
    """A project manifest: paths relative to it, a class map and defaults (P10, X11)."""

    path: str
    name: str = "project"
    paths: dict[str, str | None] = field(default_factory=dict)
    class_map: dict[str, int] = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)

    @property
    def base(self) -> str:
        return self.path.rsplit("/", 1)[0] if "/" in self.path else "."

    def resolved(self, name: str) -> str | None:
        p = self.paths.get(name)
        return None if not p else p if p.startswith("/") or "://" in p else os.path.normpath(f"{self.base}/{p}") if "://" not in self.base else f"{self.base}/{p}"

    def relative(self, path: str) -> str:
        return path[len(self.base) + 1 :] if path.startswith(self.base + "/") else path

    @classmethod
    def read(cls, path: str) -> Project:
        d = load(path, "project")
        return cls(path, str(d.get("name") or "project"), {k: (d.get("paths") or {}).get(k) for k in PATHS}, {str(k): int(v) for k, v in (d.get("class_map") or {}).items()}, dict(d.get("defaults") or {}))

    def write(self) -> dict:
        own = {k: self.relative(v) if v else None for k, v in ((k, self.paths.get(k)) for k in PATHS)}
        return save(self.path, "project", {"name": self.name, "paths": own, "class_map": dict(sorted(self.class_map.items(), key=lambda x: x[1])), "defaults": self.defaults})

    def problems(self, for_generation: bool = False) -> list[str]:
        """What is wrong with the manifest, in words; nothing where it can be used."""
        out = [f"missing path: {k}" for k in ("objects", "backgrounds", "output") if for_generation and not self.paths.get(k)]
        for name, kind in PATHS.items():
            p = self.resolved(name)
            if not p:
                continue
            if kind == "out":
                out += [f"{name} is no folder: {p}"] if store.exists(p) and not store.is_dir(p) else []
            elif not store.exists(p):
                out.append(f"{name} not found: {p}")
            elif not (store.is_dir if kind == "dir" else store.is_file)(p):
                out.append(f"{name} must be a {'folder' if kind == 'dir' else 'file'}: {p}")
        if self.class_map and sorted(self.class_map.values()) != list(range(len(self.class_map))):
            out.append("class ids must run from 0 without gaps")
        d = self.defaults
        if "workers" in d and (isinstance(d["workers"], bool) or not isinstance(d["workers"], int) or d["workers"] < 0):
            out.append("defaults.workers must be a whole number from 0 on")
        for key, known in (("output_format", OUTPUT_FORMATS), ("blend_mode", BLEND_MODES), ("rectangle_mask_mode", MASK_MODES), ("scene_region_mode", REGION_MODES)):
            if key in d and d[key] not in known:
                out.append(f"defaults.{key} must be one of {known}")
        for key in ("preview_ratio", "profile_strength", "empty_scene_prob"):
            if key in d:
                try:
                    good = not isinstance(d[key], bool) and 0.0 <= float(d[key]) <= 1.0
                except (TypeError, ValueError):
                    good = False
                out += [] if good else [f"defaults.{key} must be a number in [0, 1]"]
        for key, check in (("hardcase_recipe", hard_case), ("augmentation_recipe", recipes.scene_recipe), ("object_appearance_recipe", recipes.object_recipe)):
            v = d.get(key)
            if v:
                beside = f"{self.base}/{v}" if isinstance(v, str) and not v.startswith("/") else None
                try:
                    check(beside if beside and store.is_file(beside) else v)
                except (ValueError, OSError) as e:
                    out.append(f"defaults.{key}: {e}")
        return out


def normalized_prompt(text: str) -> str:
    """A detector's prompt: lower case, ended by a period."""
    t = text.strip().lower()
    return t if not t or t.endswith(".") else f"{t}."
