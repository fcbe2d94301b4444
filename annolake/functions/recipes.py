"""Recipes of image effects: the built-in ones, their checks, effects on cut-out objects.

A recipe is a document ``{"version", "name", "effects": {effect: settings}}``; a setting that is a pair
is a range to draw from, ``p`` the effect's probability. Scene recipes are lenient, object recipes
refuse effects and settings they do not know and may override effects by class. Effects on objects
change colours only, weighted by the object's alpha, and never pull colours in from outside of it.
"""

from __future__ import annotations

import json
import random

import numpy as np

from annolake.functions import pixels as px

# The built-in scene recipes.
SCENE_RECIPES = {
    "clean": {},
    "camera-mild": {
        "brightness_contrast": {"p": 0.45, "brightness": [-0.06, 0.06], "contrast": [0.92, 1.08]},
        "gamma": {"p": 0.20, "range": [0.90, 1.10]},
        "gaussian_noise": {"p": 0.20, "sigma": [1.5, 5.0]},
        "motion_blur": {"p": 0.10, "ksize": [3, 5]},
        "jpeg": {"p": 0.25, "quality": [82, 96]},
        "downscale": {"p": 0.12, "scale": [0.82, 0.97]},
    },
    "surveillance": {
        "brightness_contrast": {"p": 0.65, "brightness": [-0.12, 0.05], "contrast": [0.85, 1.15]},
        "gamma": {"p": 0.35, "range": [0.78, 1.22]},
        "gaussian_noise": {"p": 0.40, "sigma": [2.0, 9.0]},
        "motion_blur": {"p": 0.25, "ksize": [3, 9]},
        "jpeg": {"p": 0.55, "quality": [55, 90]},
        "downscale": {"p": 0.35, "scale": [0.55, 0.90]},
        "vignette": {"p": 0.18, "strength": [0.05, 0.25]},
    },
    "low-light": {
        "brightness_contrast": {"p": 0.90, "brightness": [-0.28, -0.08], "contrast": [0.82, 1.08]},
        "gamma": {"p": 0.70, "range": [1.05, 1.45]},
        "gaussian_noise": {"p": 0.65, "sigma": [3.0, 12.0]},
        "motion_blur": {"p": 0.18, "ksize": [3, 7]},
        "jpeg": {"p": 0.35, "quality": [65, 92]},
        "vignette": {"p": 0.40, "strength": [0.10, 0.35]},
    },
}
# The built-in object recipes.
OBJECT_RECIPES = {
    "off": {},
    "legacy": {
        "hsv_jitter": {"p": 1.0, "hue": [-2.0, 2.0], "saturation": [0.90, 1.10], "value": [0.88, 1.12]},
        "gaussian_blur": {"p": None, "sigma": [0.25, 0.75]},
    },
    "mild": {
        "brightness_contrast": {"p": 0.85, "brightness": [-0.12, 0.12], "contrast": [0.88, 1.12]},
        "saturation": {"p": 0.70, "range": [0.82, 1.18]},
        "hue": {"p": 0.45, "range": [-5.0, 5.0]},
        "gamma": {"p": 0.35, "range": [0.88, 1.18]},
        "color_temperature": {"p": 0.35, "strength": [-12.0, 12.0]},
        "gaussian_blur": {"p": 0.25, "sigma": [0.20, 1.00]},
        "gaussian_noise": {"p": 0.20, "sigma": [1.0, 5.0]},
        "resolution_degrade": {"p": 0.35, "scale": [0.40, 0.90]},
        "sharpness": {"p": 0.18, "amount": [0.85, 1.18]},
    },
    "surveillance-object": {
        "brightness_contrast": {"p": 0.90, "brightness": [-0.18, 0.08], "contrast": [0.82, 1.15]},
        "saturation": {"p": 0.75, "range": [0.75, 1.20]},
        "hue": {"p": 0.40, "range": [-6.0, 6.0]},
        "gamma": {"p": 0.50, "range": [0.82, 1.25]},
        "color_temperature": {"p": 0.45, "strength": [-18.0, 18.0]},
        "gaussian_blur": {"p": 0.40, "sigma": [0.30, 1.40]},
        "motion_blur": {"p": 0.18, "ksize": [3, 7]},
        "gaussian_noise": {"p": 0.35, "sigma": [1.5, 8.0]},
        "resolution_degrade": {"p": 0.50, "scale": [0.30, 0.85]},
        "jpeg": {"p": 0.35, "quality": [55, 92]},
        "sharpness": {"p": 0.12, "amount": [0.75, 1.12]},
    },
}
# The settings of the object effects with their bounds and what is drawn without them, in order of use.
OBJECT_EFFECTS = {
    "brightness_contrast": {"brightness": (-1.0, 1.0, -0.08, 0.08), "contrast": (0.05, 4.0, 0.9, 1.1)},
    "hsv_jitter": {"hue": (-90.0, 90.0, -2.0, 2.0), "saturation": (0.0, 4.0, 0.9, 1.1), "value": (0.0, 4.0, 0.88, 1.12)},
    "saturation": {"range": (0.0, 4.0, 0.85, 1.15)},
    "hue": {"range": (-180.0, 180.0, -5.0, 5.0)},
    "gamma": {"range": (0.05, 5.0, 0.9, 1.1)},
    "color_temperature": {"strength": (-100.0, 100.0, -10.0, 10.0)},
    "resolution_degrade": {"scale": (0.05, 1.0, 0.4, 0.9)},
    "gaussian_noise": {"sigma": (0.0, 100.0, 1.0, 5.0)},
    "motion_blur": {"ksize": (1.0, 31.0, 3.0, 7.0)},
    "jpeg": {"quality": (5.0, 100.0, 60.0, 92.0)},
    "gaussian_blur": {"sigma": (0.01, 20.0, 0.25, 0.75)},
    "sharpness": {"amount": (0.0, 3.0, 0.85, 1.15)},
}
_OLD_NAMES = {"color_temperature": {"kelvin_shift": "strength"}}


def _document(source: str | dict | None, built_in: dict[str, dict]) -> dict | None:
    """A recipe by name, as a document or from a JSON file; None for nothing."""
    if source is None or isinstance(source, str) and not source.strip():
        return None
    if isinstance(source, dict):
        return dict(source)
    name = source.strip().lower()
    if name in built_in:
        return {"version": 1, "name": name, "effects": built_in[name]}
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def _checked(doc: dict) -> dict:
    if int(doc.get("version", 1)) > 1:
        raise ValueError(f"recipe version {doc['version']} is newer than 1")
    if not isinstance(doc.get("effects", {}), dict):
        raise ValueError("effects must be an object")
    return {"name": "custom", "effects": {}} | doc | {"version": 1}


def scene_recipe(source: str | dict | None) -> dict | None:
    """A scene recipe, leniently checked."""
    doc = _document(source, SCENE_RECIPES)
    return None if doc is None else _checked(doc)


def _check_effect(name: str, settings: object, where: str) -> None:
    if name not in OBJECT_EFFECTS:
        raise ValueError(f"{where}: unknown effect {name!r}")
    if not isinstance(settings, dict):
        raise ValueError(f"{where}.{name} must be an object")
    old, known = _OLD_NAMES.get(name, {}), OBJECT_EFFECTS[name]
    if unknown := set(settings) - {"p"} - set(known) - set(old):
        raise ValueError(f"{where}.{name}: unknown settings {sorted(unknown)}")
    p = settings.get("p", 0.0)
    if p is None and name != "gaussian_blur" or p is not None and not (isinstance(p, int | float) and 0.0 <= p <= 1.0):
        raise ValueError(f"{where}.{name}.p must lie in [0, 1]")
    for key, value in settings.items():
        if key != "p":
            lo, hi, *_ = known[old.get(key, key)]
            pair = isinstance(value, list | tuple) and len(value) == 2 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in value)
            if not pair or not lo <= min(value) <= max(value) <= hi:
                raise ValueError(f"{where}.{name}.{key} must be [least, most] within [{lo}, {hi}]")


def object_recipe(source: str | dict | None) -> dict | None:
    """An object recipe, strictly checked."""
    doc = _document(source, OBJECT_RECIPES)
    if doc is None:
        return None
    doc = _checked(doc)
    for name, settings in doc["effects"].items():
        _check_effect(name, settings, "effects")
    doc["by_class"] = doc.get("by_class") or {}
    if not isinstance(doc["by_class"], dict):
        raise ValueError("by_class must be an object")
    for label, own in doc["by_class"].items():
        inner = own.get("effects", own) if isinstance(own, dict) else None
        if not isinstance(inner, dict):
            raise ValueError(f"by_class.{label} must be an object")
        for name, settings in inner.items():
            _check_effect(name, settings, f"by_class.{label}")
    return doc


def effects_for(recipe: dict | None, label: str | None = None) -> dict:
    """The recipe's effects with those of a class over them; class names match in any case."""
    doc = object_recipe(recipe) or {"effects": {}, "by_class": {}}
    own = doc["by_class"].get(label) if label else None
    if own is None and label:
        own = next((v for k, v in doc["by_class"].items() if k.casefold() == label.casefold()), None)
    return doc["effects"] | ((own.get("effects", own)) if own else {})


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in half degrees, saturation and value to 255."""
    c = bgr.astype(np.float64)
    v, lo = c.max(-1), c.min(-1)
    d = np.where(v > lo, v - lo, 1.0)
    b, g, r = np.moveaxis(c, -1, 0)
    h = np.where(v == r, (g - b) / d, np.where(v == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 30 % 180
    return np.stack([np.where(v > lo, h, 0.0), np.where(v > 0, (v - lo) / np.maximum(v, 1e-9) * 255, 0.0), v], -1)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv[..., 0] % 180 / 30, np.clip(hsv[..., 1], 0, 255) / 255, np.clip(hsv[..., 2], 0, 255)
    shade = lambda n: v - v * s * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1)
    return np.stack([shade(1), shade(3), shade(5)], -1)


def _gauss(a: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
        a = sum(w * np.take(p, np.arange(j, j + a.shape[axis]), axis) for j, w in enumerate(k / k.sum()))
    return a


def _line(a: np.ndarray, size: int, angle: float) -> np.ndarray:
    steps = [(round(np.sin(angle) * i), round(np.cos(angle) * i)) for i in range(-(size // 2), size // 2 + 1)]
    p = np.pad(a, [(size, size), (size, size)] + [(0, 0)] * (a.ndim - 2), mode="edge")
    return sum(p[size + y : size + y + a.shape[0], size + x : size + x + a.shape[1]] for y, x in steps) / len(steps)


def _inside(a: np.ndarray, alpha: np.ndarray, change) -> np.ndarray:
    """A filter over the object's own colours only: both the weighted colours and the weights pass it."""
    return change(a * alpha[..., None]) / np.maximum(change(alpha), 1e-4)[..., None]


def _shifted(a: np.ndarray, hue: float = 0.0, saturation: float = 1.0, value: float = 1.0) -> np.ndarray:
    return from_hsv(to_hsv(a) * [1.0, saturation, value] + [hue, 0.0, 0.0])


def _degraded(a: np.ndarray, alpha: np.ndarray, scale: float) -> np.ndarray:
    h, w = alpha.shape
    return _inside(a, alpha, lambda x: px.resize(px.resize(x, max(2, round(w * scale)), max(2, round(h * scale))), w, h))


def _odd(rng: random.Random, lo: float, hi: float) -> int:
    return rng.choice([k for k in range(max(1, round(lo)), max(1, round(hi)) + 1) if k % 2] or [3])


def apply_object_recipe(image: np.ndarray, alpha: np.ndarray, recipe: dict | str | None, seed: int, label: str | None = None, blur_probability: float = 0.0) -> tuple[np.ndarray, list[dict]]:
    """The object's colours after its recipe, and what was applied (I2). ``alpha`` runs from 0 to 1; a
    blur whose ``p`` is null takes ``blur_probability``."""
    rng, effects = random.Random(seed), effects_for(object_recipe(recipe), label)
    a, alpha, applied = image.astype(np.float64), np.clip(alpha.astype(np.float64), 0, 1), []
    if not effects or not (alpha > 0.1).any():
        return image, applied
    for name, known in OBJECT_EFFECTS.items():
        s = effects.get(name)
        if s is None:
            continue
        p = s.get("p", 1.0 if name == "hsv_jitter" else 0.0)
        if rng.random() >= (blur_probability if p is None else p):
            continue
        s = {_OLD_NAMES.get(name, {}).get(k, k): v for k, v in s.items()}
        drawn = {k: rng.uniform(*sorted(s.get(k, v[2:]))) for k, v in known.items() if k != "ksize"}
        x = next(iter(drawn.values()), 0.0)
        if name == "brightness_contrast":
            new = a * drawn["contrast"] + drawn["brightness"] * 255
        elif name == "hsv_jitter":
            new = _shifted(a, **drawn)
        elif name == "saturation":
            new = _shifted(a, saturation=x)
        elif name == "hue":
            new = _shifted(a, hue=x / 2)
        elif name == "gamma":
            new = (a / 255) ** max(0.05, x) * 255
        elif name == "color_temperature":
            new = a + np.array([-x, 0.0, 1.2 * x])
        elif name == "resolution_degrade":
            new = _degraded(a, alpha, min(1.0, max(0.05, x)))
        elif name == "gaussian_noise":
            new = a + np.random.default_rng(rng.getrandbits(32)).normal(0, max(0.0, x), a.shape)
        elif name == "motion_blur":
            drawn = {"ksize": _odd(rng, *sorted(s.get("ksize", (3, 7)))), "angle": rng.uniform(0.0, np.pi)}
            new = _inside(a, alpha, lambda v, d=drawn: _line(v, d["ksize"], d["angle"]))
        elif name == "gaussian_blur":
            new = _inside(a, alpha, lambda v, d=max(0.05, x): _gauss(v, d))
        elif name == "sharpness":
            new = a + (x - 1.0) * (a - _inside(a, alpha, lambda v: _gauss(v, 0.8)))
        else:
            raise px.Unavailable("the jpeg effect needs an imaging library")
        w = alpha[..., None]
        a = np.floor(a * (1 - w) + np.clip(new, 0, 255) * w)
        applied.append({"effect": name, **drawn})
    return np.clip(a, 0, 255).astype(np.uint8), applied


def match_colours(image: np.ndarray, alpha: np.ndarray, background: np.ndarray, strength: float) -> tuple[np.ndarray, dict | None]:
    """The object's mean colour drawn towards that of the background it covers, both weighted by its
    alpha (I3)."""
    w = np.clip(alpha.astype(np.float64), 0, 1)[..., None]
    if strength <= 0 or w.sum() <= 1e-6 or background.shape[:2] != image.shape[:2]:
        return image, None
    mean = lambda v: (v * w).sum((0, 1)) / w.sum()
    shift = (mean(background.astype(np.float64)) - mean(image.astype(np.float64))) * strength
    return np.clip(image + shift, 0, 255).astype(np.uint8), {"effect": "color_match", "strength": strength, "shift_bgr": shift.tolist()}


def prepared_foreground(image: np.ndarray, alpha: np.ndarray, background: np.ndarray, seed: int, recipe: dict | str | None = None, label: str | None = None, match: float = 0.0, blur_probability: float = 0.0):
    """(image, applied): the object's recipe, or the light colour jitter and blur where it has none,
    then colour matching (I3)."""
    out, applied = apply_object_recipe(image, alpha, "legacy" if recipe is None else recipe, seed, label, blur_probability)
    out, fact = match_colours(out, alpha, background, match)
    return out, applied + ([fact] if fact else [])
