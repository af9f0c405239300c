import colorsys

import numpy as np
import pytest
from penduline.operators import masks, pictures


def test_hsv_agrees_with_the_standard_library():
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (40, 3))
    got = pictures.hsv(rgb)
    for c, (h, s, v) in zip(rgb, got, strict=True):
        a, b, d = colorsys.rgb_to_hsv(*(c / 255))
        assert (h, s, v) == pytest.approx(((a * 180) % 180, b * 255, d * 255), abs=1e-6)


def _disk():
    y, x = np.mgrid[:80, :80]
    rgb = np.full((80, 80, 3), 40, np.uint8)
    rgb[(y - 40) ** 2 + (x - 40) ** 2 <= 30**2] = (20, 180, 30)
    rgb[(y - 40) ** 2 + (x - 52) ** 2 <= 5**2] = (200, 200, 200)
    return rgb


def test_objects_on_a_disk():
    found = pictures.disk_objects(_disk(), (35, 80, 60), (85, 255, 255))
    ys, xs = np.nonzero(found)
    assert (ys.mean(), xs.mean()) == pytest.approx((40, 52), abs=0.5)
    with pytest.raises(ValueError, match="circular_disk_not_found"):
        pictures.disk_objects(np.zeros((20, 20, 3), np.uint8), (35, 80, 60), (85, 255, 255))


def _rail():
    rgb = np.zeros((100, 200, 3), np.uint8)
    for x, w in ((20, 9), (120, 20), (60, 3)):
        rgb[82:91, x : x + w] = (230, 60, 40)
    rgb[10:19, 30:39] = (230, 60, 40)  # above the band
    rgb[82:91, 170:179] = 240  # pale
    return rgb


def test_balls_on_a_rail():
    config = pictures.RAIL | {"least_area": 6}
    blobs = pictures.track_candidates(_rail(), config)
    assert sorted((round(b.x), b.area) for b in blobs) == [(24, 68), (61, 20), (125, 78), (134, 78)]
    striker, left, right = pictures.rail_roles(blobs, config)
    assert (round(striker.x), round(left.x), round(right.x)) == (24, 125, 134)
    (box, point), *_ = pictures.rail_prompts(_rail())
    assert box == (24 - 9, 85.5 - 9, 24 + 9, 85.5 + 9) and point == pytest.approx((24, 85.5))
    one = _rail()
    one[:, 100:] = 0
    with pytest.raises(ValueError, match="objects_missing"):
        pictures.track_candidates(one, config)
    far = [b._replace(y=b.y + 40 * k) for k, b in enumerate(blobs)]
    with pytest.raises(ValueError, match="target_pair_missing"):
        pictures.rail_roles(far, config)
    with pytest.raises(ValueError, match="striker_missing"):
        pictures.rail_roles([b for b in blobs if b.x > 100] * 2, config | {"most_separation": 11.0})


def test_ellipses():
    assert masks.ellipse(3).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    assert masks.ellipse(5).sum(1).tolist() == [1, 5, 5, 5, 1]
    dot = np.zeros((7, 7), np.uint8)
    dot[3, 3] = 1
    assert masks.dilate(dot, 3).sum() == 5 and masks.erode(masks.dilate(dot, 3), 3).tolist() == dot.tolist()


def test_proposals_keep_off_the_border():
    stack = np.zeros((2, 100, 200), bool)
    stack[0, 40:60, 1:30] = True  # within the margin of two pixels
    stack[1, 40:50, 40:50] = True
    stack[1, 70:74, 40:44] = True
    assert masks.best_proposal(stack) == (1, 1, 150.0)
    assert masks.best_proposal(stack, least_area=101) is None
    assert masks.expanded_box(40, 40, 10, 10, 2.0, 5, 200, 100) == (35, 35, 55, 55)
    assert masks.expanded_box(40, 40, 10, 10, 2.0, 5, 200, 100, of_pixels=True) == (34.5, 34.5, 54.5, 54.5)


def test_motion_and_entry():
    stack = np.full((7, 120, 170), 60.0)
    for k in range(7):
        stack[k, 20:78, 15 + 18 * k : 23 + 18 * k] = 200
    frame, box, points = pictures.bright_motion_prompt(stack, 15.0, 20)
    assert all(inside and stack[frame, round(y), round(x)] == 200 and box[0] < x < box[2] for x, y, inside in points) and len(points) == 6
    bent = stack.copy()
    for k in range(7):
        bent[k, 50:70, 15 + 18 * k : 40 + 18 * k] = 200
    assert [p[2] for p in pictures.bright_motion_prompt(bent, 15.0, 20)[2]].count(False) <= 1
    with pytest.raises(ValueError, match="motion_prompt_failed"):
        pictures.bright_motion_prompt(np.zeros((3, 9, 9)), 15.0, 20)
    with pytest.raises(ValueError, match="motion_prompt_failed"):
        pictures.bright_motion_prompt(stack[:, :70], 15.0, 20)  # it touches the border
    parts = pictures.entry_components(stack[3] + 5, np.full((120, 170), 60.0))
    assert len(parts) == 1 and parts[0][1] == pytest.approx(72.5, abs=0.6)
    k, box, point = masks.motion_prompt(stack, 15.0, 20, 1.1, 10)
    assert stack[k, round(point[1]), round(point[0])] == 200 and box[0] < point[0] < box[2]
    with pytest.raises(ValueError, match="motion_prompt_failed"):
        masks.motion_prompt(np.zeros((3, 9, 9)), 15.0, 20, 1.1, 10)


def test_area_means():
    rgb = np.random.default_rng(1).integers(0, 256, (60, 640, 3))
    small = pictures.gray_small(rgb, 320)
    gray = rgb @ np.array([0.299, 0.587, 0.114])
    assert small.shape == (30, 320) and small[3, 7] == pytest.approx(gray[6:8, 14:16].mean())
