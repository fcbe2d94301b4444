"""Recipes, regions, polygons and cut-outs on small arrays."""

import random

import numpy as np
import pytest

from annolake.functions import masks as mk
from annolake.functions import pixels as px
from annolake.functions import recipes as rc


def test_scene_recipes():
    assert [rc.scene_recipe(n)["name"] for n in rc.SCENE_RECIPES] == list(rc.SCENE_RECIPES) and rc.scene_recipe("") is None
    img = np.full((20, 30, 3), 120, np.uint8)
    for name in ("clean", "low-light"):
        doc = rc.scene_recipe(name)
        doc["effects"] = {k: v for k, v in doc["effects"].items() if k != "jpeg"}
        out, applied = px.apply_recipe(img, doc, 5)
        assert out.shape == img.shape and (applied == []) == (name == "clean")
    with pytest.raises(ValueError):
        rc.scene_recipe({"version": 2})
    with pytest.raises(ValueError):
        rc.scene_recipe({"effects": []})


@pytest.mark.parametrize("bad", [{"fog": {"p": 1}}, {"gamma": {"p": 2}}, {"gamma": {"p": None}}, {"gamma": {"rage": [1, 2]}}, {"gamma": {"range": [0, 9]}}, {"gamma": 3}, {"gamma": {"range": "x"}}])
def test_object_recipes_are_strict(bad):
    with pytest.raises(ValueError):
        rc.object_recipe({"effects": bad})
    with pytest.raises(ValueError):
        rc.object_recipe({"effects": {}, "by_class": {"person": {"effects": bad}}})


def test_object_effects_stay_inside():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 255, (24, 30, 3), np.uint8)
    alpha = np.zeros((24, 30))
    alpha[6:18, 8:20] = 1.0
    for name in rc.OBJECT_EFFECTS:
        recipe = {"effects": {name: {"p": 1.0}}}
        if name == "jpeg":
            with pytest.raises(px.Unavailable):
                rc.apply_object_recipe(img, alpha, recipe, 3)
            continue
        out, applied = rc.apply_object_recipe(img, alpha, recipe, 3)
        assert [a["effect"] for a in applied] == [name] and (out[alpha == 0] == img[alpha == 0]).all() and (out != img).any()
        assert (out == rc.apply_object_recipe(img, alpha, recipe, 3)[0]).all()
    assert rc.apply_object_recipe(img, alpha, "off", 3)[1] == [] and rc.apply_object_recipe(img, alpha * 0, "mild", 3)[1] == []
    assert [a["effect"] for a in rc.apply_object_recipe(img, alpha, "legacy", 3, blur_probability=1.0)[1]] == ["hsv_jitter", "gaussian_blur"]
    # colours from outside are not pulled in
    two = np.where(alpha[..., None] > 0, 200, 0).astype(np.uint8).repeat(3, -1)[..., :3]
    assert (rc.apply_object_recipe(two, alpha, {"effects": {"gaussian_blur": {"p": 1, "sigma": [2, 2]}}}, 1)[0][alpha > 0] >= 199).all()
    own = {"effects": {"gamma": {"p": 1}}, "by_class": {"Person": {"gamma": {"p": 0}}}}
    assert rc.effects_for(own, "person")["gamma"]["p"] == 0 and rc.effects_for(own, "car")["gamma"]["p"] == 1


def test_hsv_and_colour_match():
    c = np.random.default_rng(2).integers(0, 256, (9, 9, 3)).astype(np.uint8)
    assert np.abs(rc.from_hsv(rc.to_hsv(c)) - c).max() < 1e-6
    assert rc.to_hsv(np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0]]], np.uint8))[0, :, 0].tolist() == [0, 60, 120]
    out, fact = rc.match_colours(np.full((4, 4, 3), 100, np.uint8), np.ones((4, 4)), np.full((4, 4, 3), 140, np.uint8), 0.5)
    assert (out == 120).all() and fact["shift_bgr"] == [20.0] * 3
    out, applied = rc.prepared_foreground(c, np.ones((9, 9)), c, 1, match=0.5, blur_probability=1.0)
    assert [a["effect"] for a in applied] == ["hsv_jitter", "gaussian_blur", "color_match"]


def test_regions():
    sq = lambda label, x, y, n: {"label": label, "points": [[x, y], [x + n, y], [x + n, y + n], [x, y + n]]}
    shapes = [sq("Ground", 0, 0, 9), sq("zone:Person: tall", 20, 20, 9), sq("禁放区域", 0, 0, 4), {"label": "road", "shape_type": "rectangle", "points": [[12, 2], [10, 0]]}, {"label": "road", "points": []}]
    region, own, facts = mk.placement_regions(shapes, 40, 50)
    assert facts["source"] == "explicit" and list(own) == ["person: tall"] and region[8, 8] and not region[3, 3] and region[1, 11] and facts["forbidden_pixels"] == 25
    region, _, facts = mk.placement_regions([], 40, 50)
    assert facts["source"] == "ground-prior" and not region[13].any() and region[14].all()
    assert mk.placement_regions([], 40, 50, "explicit")[0] is None and mk.placement_regions(shapes, 40, 50, "none")[0] is None
    _, own, facts = mk.placement_regions([sq("zone:a", 0, 0, 5)], 40, 50)
    assert facts["source"] == "ground-prior" and "a" in own
    with pytest.raises(ValueError):
        mk.placement_regions([], 4, 4, "other")
    assert [mk.zone_of(x) for x in ("地面:人", "paste_zone", "zone", "tree", " ROAD ")] == ["人", "", None, None, ""]
    rng = random.Random(1)
    assert all(region[y, x] for x, y in (mk.bottom_point(rng, 50, 40, 0.5, 0.9, region) for _ in range(50)))
    assert all(0.5 * 40 <= mk.bottom_point(rng, 50, 40, 0.5, 0.9)[1] <= 36 for _ in range(50))


def test_polygons_and_clipping():
    p = mk.clip_polygon(np.array([(-5, -5), (5, -5), (5, 5), (-5, 5)]), 10, 10)
    assert mk.shoelace(p) == 25 and mk.clip_polygon(np.array([(20, 20), (30, 20), (30, 30)]), 10, 10) is None and mk.clip_polygon(np.array([(0, 0), (1, 1)]), 9, 9) is None
    m = np.zeros((40, 60), bool)
    m[5:15, 5:35] = True
    m[20:38, 40:58] = True
    m[2, 2] = True
    got = mk.polygons(m)
    assert len(got) == 2 and [len(x) for x in got] == [4, 4] and mk.shoelace(got[0]) == 17 * 17 and mk.shoelace(got[1]) == 29 * 9
    again = np.logical_or.reduce([px.rasterize(x, 40, 60) for x in got])
    m[2, 2] = False
    assert (again == m).all() and mk.polygons(np.zeros((5, 5), bool)) == []
    ring = np.hypot(*np.mgrid[-20:21, -20:21]) <= 18
    circle = mk.polygons(ring)[0]
    assert 8 < len(circle) < 60 and abs(mk.shoelace(circle) - np.pi * 18**2) < 70


def test_cut_outs():
    img = np.zeros((10, 20, 3), np.uint8)
    img[:, :10] = 200
    turned = mk.rotate(img, 90)
    assert turned.shape == (20, 10, 3) and abs(int(turned[15].mean()) - 200) < 60 and turned[3].mean() < 60
    assert mk.rotate(img, 0) is img and mk.rotate(img[..., 0], 45).ndim == 2
    a = np.ones((4, 6))
    assert mk.canvas_mask(a, -2, 8, 12, 10).sum() == 4 * 2 and mk.canvas_mask(a, 30, 30, 12, 10).sum() == 0
    assert mk.fit_scale(100, 50, 20, 20) == 0.2 and mk.thumbnail(np.zeros((50, 100, 3), np.uint8), 20, 20).shape == (10, 20, 3)
    assert mk.foot_shadow(np.full((40, 40, 3), 200, np.uint8), 20, 20, 16)[20, 20, 0] < 140
    canvas, patch = np.zeros((10, 10, 3), np.uint8), np.full((4, 4, 3), 100, np.uint8)
    assert mk.blend_patch(canvas, patch, np.full((4, 4), 0.6), 3, 3, "hard")[4, 4, 0] == 100 and mk.blend_patch(canvas, patch, np.full((4, 4), 0.6), 3, 3)[4, 4, 0] == 60
    m = np.zeros((10, 20), bool)
    m[3:6, 4:9] = True
    assert mk.foreground(img, m, 0, 1).shape == (5, 7, 4) and mk.foreground(img, m, 1).shape == (10, 20, 4)
    got = mk.random_fill(random.Random(2), 100, 100, [(30, 30), (20, 40)])
    assert 1 <= len(got) <= 3 and mk.random_fill(random.Random(2), 9, 9, []) == []
