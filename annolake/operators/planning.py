"""Deterministic scene plans.

A plan row is a pure function of (seed, index): each sample draws from its own generator, so plans
can be made in any order, on any executor, and resumed. Precedence for a sample: an intentional empty
scene, a template, the learned profile (with its strength as probability), the default ranges. The
random numbers are this library's own; only their distributions follow the configuration.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.geometry import task_seed

SCHEMA = (
    "idx bigint, slot int, seed bigint, label string, class_id int, center_x double, bottom_y double, height double, flip boolean, angle double, allow_overlap boolean, "
    "origin string, intentional_empty boolean"
)
_ARROW = pa.schema([
    ("idx", pa.int64()), ("slot", pa.int32()), ("seed", pa.int64()), ("label", pa.string()), ("class_id", pa.int32()), ("center_x", pa.float64()), ("bottom_y", pa.float64()),
    ("height", pa.float64()), ("flip", pa.bool_()), ("angle", pa.float64()), ("allow_overlap", pa.bool_()), ("origin", pa.string()), ("intentional_empty", pa.bool_()),
])
#: The built-in hard cases.
HARD_CASES = {
    "small-object": {"height_scale": [0.35, 0.65], "bottom_y_bias": "far", "overlap_probability": 0.05, "cluster_probability": 0.0, "count_bias": "normal"},
    "far-occluded": {"height_scale": [0.35, 0.70], "bottom_y_bias": "far", "overlap_probability": 0.65, "cluster_probability": 0.70, "count_bias": "max"},
    "crowded": {"height_scale": [0.75, 1.10], "bottom_y_bias": "normal", "overlap_probability": 0.45, "cluster_probability": 0.55, "count_bias": "max"},
}
#: The share of the ground a bias keeps to, the spread of a cluster and of heights, and their ends.
FAR_PART, NEAR_PART, CLUSTER_SPREAD, HEIGHT_SPREAD = 0.48, 0.52, 0.08, (0.82, 1.18)
PLACE_X, CLUSTER_X, PLACE_H = (0.06, 0.94), (0.04, 0.96), (0.01, 0.85)


def hard_case(source: str | dict | None) -> dict | None:
    """A hard case by name, as a document or from a JSON file (R8); none for nothing, ``off`` and ``none``."""
    if not source or str(source).lower() in ("off", "none"):
        return None
    if isinstance(source, dict):
        case = dict(source)
    elif source in HARD_CASES:
        case = HARD_CASES[source] | {"name": source}
    else:
        try:
            with open(source, encoding="utf-8") as f:
                case = json.load(f)
        except OSError as e:
            raise ValueError(f"no hard case and no file: {source!r}") from e
    scale = case.get("height_scale", [1.0, 1.0])
    if not isinstance(scale, list | tuple) or len(scale) != 2 or not 0 < float(scale[0]) <= float(scale[1]):
        raise ValueError("height_scale must be [least, most], both above 0")
    case["height_scale"] = [float(x) for x in scale]
    for name in ("overlap_probability", "cluster_probability"):
        case[name] = float(case.get(name, 0.0))
        if not 0.0 <= case[name] <= 1.0:
            raise ValueError(f"{name} must lie in [0, 1]")
    return case


def background_cycle(samples: DataFrame, backgrounds: DataFrame, name: str, seed: int) -> DataFrame:
    """Adds cycle, slot and a background to samples numbered by ``idx`` (W9): every background once a
    cycle, in the order of a hash of seed, cycle and background; a null is no background. The order of a
    cycle is made from counts by the hash's first byte, the table of orders has one row a sample. It is a
    cross join, not an explode, whose rows Spark takes for as few and as small as the backgrounds."""
    from annolake.operators.ranking import running

    own = backgrounds.select(name).dropna().distinct()
    n = own.count()
    s = samples.withColumn("cycle", F.floor(F.col("idx") / max(1, n)).cast("bigint")).withColumn("slot", F.pmod("idx", F.lit(max(1, n))).cast("bigint"))
    cores = samples.sparkSession.sparkContext.defaultParallelism
    each = s.select(F.coalesce("cycle", F.lit(0)).alias("cycle")).distinct().repartition(cores).crossJoin(own.repartition(cores))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("cycle").cast("string"), F.lit(":"), F.col(name).cast("string")), 256)
    byte = F.coalesce(F.conv(F.substring(h, 1, 2), 16, 10).cast("int"), F.lit(0))
    order = running(each, [h, F.col(name)], [byte], keys=["cycle"], name="_slot", late=True).select((F.col("cycle") * n + F.col("_slot")).alias("idx"), name)
    return s.join(order, "idx").select("cycle", "slot", *(c for c in samples.columns if c not in ("cycle", "slot")), name)


@dataclass(frozen=True)
class PlanConfig:
    class_map: dict[str, int]
    min_objects: int = 1
    max_objects: int = 3
    empty_probability: float = 0.0
    profile_strength: float = 1.0
    flip_probability: float = 0.5
    y_range: tuple[float, float] = (0.45, 0.95)
    height_range: tuple[float, float] = (0.10, 0.35)
    hard_case: dict = field(default_factory=dict)
    constraint_tries: int = 50

    def __post_init__(self) -> None:
        if not self.class_map or sorted(self.class_map.values()) != list(range(len(self.class_map))):
            raise ValueError("class ids must run from 0 without gaps")
        if not 0 <= self.min_objects <= self.max_objects:
            raise ValueError("object counts must satisfy 0 <= min <= max")
        for name in ("empty_probability", "profile_strength", "flip_probability"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")


def parse_class_map(text: str) -> dict[str, int]:
    """``person=0,truck=1``; ids contiguous from 0."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, number = part.partition("=")
        if not eq or not number.strip().isdigit() or not name.strip() or name.strip() in out:
            raise ValueError(f"not a class: {part!r}")
        out[name.strip()] = int(number)
    if sorted(out.values()) != list(range(len(out))):
        raise ValueError("class ids must run from 0 without gaps")
    return out


def draw(rng: random.Random, weights: list[float]) -> int:
    """A place by weight; uniform where no weight is positive."""
    w = [max(0.0, x) for x in weights]
    return rng.choices(range(len(w)), w)[0] if sum(w) > 0 else rng.randrange(len(w))


def draw_histogram(rng: random.Random, counts: list[int], lo: float, hi: float, otherwise: float) -> float:
    """A bin by count, uniform inside it (R2)."""
    if not counts or sum(counts) <= 0:
        return otherwise
    return lo + (draw(rng, counts) + rng.random()) * (hi - lo) / len(counts)


def _default(rng: random.Random, c: PlanConfig, before: list[dict]) -> tuple[float, float, float]:
    """Position on the ground, nearer means larger; hard cases keep to the far or near part of the
    ground, put objects by the one before and scale them (R7, M16)."""
    lo, hi = c.y_range
    part = {"far": (lo, lo + (hi - lo) * FAR_PART), "near": (lo + (hi - lo) * NEAR_PART, hi)}.get(c.hard_case.get("bottom_y_bias", "normal"), (lo, hi))
    y = rng.uniform(*part)
    if before and rng.random() < c.hard_case.get("cluster_probability", 0.0):
        x = min(CLUSTER_X[1], max(CLUSTER_X[0], before[-1]["center_x"] + rng.uniform(-CLUSTER_SPREAD, CLUSTER_SPREAD)))
    else:
        x = rng.uniform(*PLACE_X)
    t = min(1.0, max(0.0, (y - lo) / max(1e-6, hi - lo)))
    h = (c.height_range[0] + t * (c.height_range[1] - c.height_range[0])) * rng.uniform(*HEIGHT_SPREAD) * rng.uniform(*c.hard_case.get("height_scale", (1.0, 1.0)))
    return x, y, min(PLACE_H[1], max(PLACE_H[0], h))


def relation_holds(kind: str, a: dict, b: dict, margin: float = 0.0, value: float | None = None) -> bool:
    """left_of, right_of, above, below by the objects' middles, min_distance, max_distance."""
    (ax, ay), (bx, by) = ((o["center_x"], o["bottom_y"] - o["height"] / 2) for o in (a, b))
    d, m = ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5, max(0.0, margin)
    tests = {"left_of": ax + m < bx, "right_of": ax - m > bx, "above": ay + m < by, "below": ay - m > by, "min_distance": d >= (value or 0.0), "max_distance": d <= (1.0 if value is None else value)}
    return tests.get(str(kind).strip().lower(), True)


def from_template(rng: random.Random, c: PlanConfig, template: dict) -> list[dict] | None:
    """Slots drawn from their ranges, or the template's jitter about their place, until the constraints
    hold; None if they never did (R10). Slots of unknown classes stay out, and constraints on absent
    slots do not count (J16)."""
    params = template.get("parameters") or {}
    for _ in range(max(1, int(params.get("constraint_tries") or c.constraint_tries))):
        rows: dict[str, dict] = {}
        for k, s in enumerate(template.get("instances", [])):
            v = s.get("variation") or {}
            if s.get("label") not in c.class_map or rng.random() > v.get("enabled_probability", params.get("instance_probability", 1.0)):
                continue
            at = {"cx_range": s.get("cx_ratio", 0.5), "cy_range": s.get("cy_ratio", 0.5), "h_range": s.get("h_ratio", 0.2), "angle_range": s.get("angle", 0.0)}
            spread = {
                "cx_range": params.get("position_jitter_x", 0.0), "cy_range": params.get("position_jitter_y", 0.0), "h_range": at["h_range"] * params.get("scale_jitter", 0.0),
                "angle_range": params.get("angle_jitter", 0.0),
            }
            ends = {"cx_range": (0.0, 1.0), "cy_range": (0.0, 1.0), "h_range": (0.01, 1.5), "angle_range": (-1e9, 1e9)}
            drawn = {n: min(ends[n][1], max(ends[n][0], rng.uniform(*v.get(n, (x - spread[n], x + spread[n]))))) for n, x in at.items()}
            flip = v.get("flip_probability", params.get("flip_probability"))
            rows[s.get("id", f"slot_{k + 1:03d}")] = {
                "label": s["label"], "center_x": drawn["cx_range"], "bottom_y": drawn["cy_range"] + drawn["h_range"] / 2, "height": drawn["h_range"], "angle": drawn["angle_range"],
                "flip": bool(s.get("flip", False)) if flip is None else rng.random() < flip, "allow_overlap": bool(v.get("allow_overlap", params.get("allow_overlap", True))),
            }
        active = [k for k in template.get("constraints") or [] if k.get("a") in rows and k.get("b") in rows]
        if all(relation_holds(k.get("type", ""), rows[k["a"]], rows[k["b"]], k.get("margin") or 0.0, k.get("value")) for k in active):
            return list(rows.values())
    return None


def plan_one(seed: int, c: PlanConfig, profile: dict | None = None, template: dict | None = None) -> tuple[list[dict], str]:
    """(objects, origin) of one sample; ``empty`` is an intended, ``unsatisfied`` an unintended void."""
    rng = random.Random(seed)
    if rng.random() < c.empty_probability:
        return [], "empty"
    if template is not None:
        rows = from_template(rng, c, template)
        return (rows, "template") if rows is not None else ([], "unsatisfied")
    learned = profile is not None and rng.random() < c.profile_strength
    labels = [k for k in sorted(c.class_map) if not learned or k in profile["classes"]] or sorted(c.class_map)
    if learned and profile.get("object_count"):
        counts = {int(k): v for k, v in profile["object_count"].items() if c.min_objects <= int(k) <= c.max_objects}
        n = list(counts)[draw(rng, list(counts.values()))] if counts else rng.randint(c.min_objects, c.max_objects)
    else:
        n = c.max_objects if c.hard_case.get("count_bias") == "max" else rng.randint(c.min_objects, c.max_objects)
    rows: list[dict] = []
    for _ in range(n):
        x, y, h = _default(rng, c, rows)
        label = labels[draw(rng, [profile["classes"].get(k, {}).get("count", 0) for k in labels])] if learned else rng.choice(labels)
        own = profile["classes"].get(label, {}) if learned else {}
        x, y, h = (min(b, max(a, draw_histogram(rng, own.get(m, []), 0.0, 1.0, at))) for m, at, a, b in (("center_x", x, 0.01, 0.99), ("bottom_y", y, 0.01, 0.995), ("height", h, 0.01, 0.9)))
        rows.append({
            "label": label, "center_x": x, "bottom_y": y, "height": h, "flip": rng.random() < c.flip_probability, "angle": 0.0,
            "allow_overlap": rng.random() < c.hard_case.get("overlap_probability", 0.0),
        })
    return rows, "profile" if learned else "default"


def plan(spark: SparkSession, count: int, seed: int, config: PlanConfig, profile: dict | None = None, template: dict | None = None, done: DataFrame | None = None) -> DataFrame:
    """The plan of ``count`` samples, less those ``done`` (idx); an empty sample keeps one row with
    null slot."""
    idx = spark.range(count).withColumnRenamed("id", "idx")
    if done is not None:
        idx = idx.join(done.select("idx"), "idx", "left_anti")
    payload = json.dumps([asdict(config), profile, template])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, prof, temp = json.loads(payload)
        c = PlanConfig(**c)
        for b in batches:
            out: list[dict] = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                objects, origin = plan_one(s, c, prof, temp)
                base = {"idx": i, "seed": s, "origin": origin, "intentional_empty": origin == "empty" or (origin != "unsatisfied" and not objects)}
                out += [base | o | {"slot": k, "class_id": c.class_map[o["label"]]} for k, o in enumerate(objects)] or [base]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return idx.select("idx", task_seed(seed, F.col("idx")).alias("seed")).mapInArrow(rows, SCHEMA)


def choose_assets(planned: DataFrame, assets: DataFrame) -> DataFrame:
    """An asset (asset_id, class_id) for every planned object: of its class by seeded choice, else of
    any class, flagged (J17). Assets are numbered within their class; the choice is arithmetic on
    the seed, so the join has one row on the asset side for each object."""
    from annolake.operators.ranking import running

    per = running(assets, [F.col("asset_id")], [F.shiftright("asset_id", 52)], keys=["class_id"], name="n")
    sizes = per.groupBy("class_id").agg(F.count(F.lit(1)).alias("k"))
    any_ = running(assets, [F.col("asset_id")], [F.shiftright("asset_id", 52)], name="n").select("n", F.col("asset_id").alias("any_id"))
    total = assets.count()
    p = planned.join(sizes, "class_id", "left").withColumn("h", F.pmod(F.xxhash64("seed", "slot"), F.lit(2**31)))
    p = p.withColumn("n", F.when(F.col("k") > 0, F.pmod("h", F.col("k")))).join(per.select("class_id", "n", "asset_id"), ["class_id", "n"], "left").drop("n", "k")
    p = p.withColumn("n", F.when(F.col("asset_id").isNull() & F.lit(total > 0), F.pmod("h", F.lit(max(1, total))))).join(any_, "n", "left")
    return p.withColumn("fallback", F.col("asset_id").isNull()).withColumn("asset_id", F.coalesce("asset_id", "any_id")).drop("n", "h", "any_id")
