"""Backends by name: embeddings and cut-outs.

An embedding backend is a function of a decoded picture, loaded once a worker by ``worker_state``. The
cut-out models and the refinement of rectangles need weights or an imaging library; asking for one
raises, so that nothing is ever silently empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from annolake.functions.pixels import BACKENDS, Unavailable, backend  # noqa: F401

#: Cut-out models by name and what they need; callers may register functions of a picture that give alpha.
CUTOUTS: dict[str, str | Callable[[np.ndarray], np.ndarray]] = {
    "matting": "trained weights", "portrait": "trained weights", "general": "trained weights", "detector+segmenter": "trained weights", "prompted": "trained weights", "fast": "trained weights", "grabcut": "an imaging library",
}


def register_embedding(name: str, fn: Callable[[np.ndarray], np.ndarray]) -> None:
    BACKENDS[name] = fn


def register_cutout(name: str, fn: Callable[[np.ndarray], np.ndarray]) -> None:
    CUTOUTS[name] = fn


def cutout(name: str) -> Callable[[np.ndarray], np.ndarray]:
    if name not in CUTOUTS:
        raise ValueError(f"no cut-out model {name!r}; known: {sorted(CUTOUTS)}")
    if isinstance(CUTOUTS[name], str):
        raise Unavailable(f"the cut-out model {name!r} needs {CUTOUTS[name]}, which is not installed")
    return CUTOUTS[name]


@lru_cache(8)
def worker_state(name: str) -> Callable[[np.ndarray], np.ndarray]:
    """A backend, looked up once in the life of a worker."""
    return backend(name)


def plausible_mask(mask: np.ndarray, fill: tuple[float, float] = (0.04, 0.90), most_rectangular: float = 0.94) -> bool:
    """Whether a refined mask may be an object: it fills its picture neither too little nor too much
    and is no plain rectangle."""
    from annolake.functions.pixels import mask_bbox

    box = mask_bbox(mask)
    if box is None:
        return False
    area = (box[2] - box[0]) * (box[3] - box[1])
    return bool(fill[0] <= mask.mean() <= fill[1] and mask.sum() / area < most_rectangular)
