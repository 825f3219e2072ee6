import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.operators import datasets, features, flow

SIZE = 26


def scene(dx=0.0, dy=0.0):
    y, x = np.mgrid[0:SIZE, 0:SIZE].astype(float)
    x, y = x - dx, y - dy
    return 100 + 40 * np.sin(x / 4) + 30 * np.cos(y / 5) + 20 * np.sin((x + y) / 6)


def vectors(spark, before, after, block):
    rows = spark.createDataFrame([(1, before.ravel().tolist(), after.ravel().tolist())], "frame_num long, before array<double>, thumb array<double>")
    return flow.flow_vectors(rows, before.shape[1], block)


@pytest.mark.parametrize(("dx", "dy"), [(0.4, 0.0), (0.0, -0.3), (0.25, 0.35), (-0.5, 0.2), (0.0, 0.0)])
def test_a_shift_is_found(spark, dx, dy):
    rows = vectors(spark, scene(), scene(dx, dy), 24).collect()
    assert len(rows) == 1 and abs(rows[0].x - dx) < 0.03 and abs(rows[0].y - dy) < 0.03
    found = datasets.flow_means(vectors(spark, scene(), scene(dx, dy), 8), "frame_num").first()
    assert abs(found.avg_flow_x - dx) < 0.06 and abs(found.avg_flow_y - dy) < 0.06


def test_flow_by_least_squares(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(11, 9)), rng.normal(size=(11, 9))
    rows = {r.block: r for r in vectors(spark, a, b, 3).collect()}
    assert len(rows) == 2 * 3
    both = (a + b) / 2
    across, down, time = (both[:, 2:] - both[:, :-2])[1:-1] / 2, (both[2:] - both[:-2])[:, 1:-1] / 2, (b - a)[1:-1, 1:-1]
    for n, r in rows.items():
        cut = np.s_[n // 2 * 3 : n // 2 * 3 + 3, n % 2 * 3 : n % 2 * 3 + 3]
        gradients = np.stack([across[cut].ravel(), down[cut].ravel()], axis=1)
        products = gradients.T @ gradients
        want = np.linalg.lstsq(gradients, -time[cut].ravel(), rcond=None)[0] if np.linalg.det(products) > flow.FLAT * np.trace(products) ** 2 else [0, 0]
        assert np.allclose([r.x, r.y], want)


def test_flat_pictures_and_odd_rows(spark):
    flat = np.ones((6, 6))
    assert all((r.x, r.y) == (0, 0) for r in vectors(spark, flat, flat + 1, 2).collect())
    stripes = np.tile(np.arange(8.0), (8, 1))  # varies along one direction only
    assert all((r.x, r.y) == (0, 0) for r in vectors(spark, stripes, stripes - 0.5, 3).collect())
    rows = [(1, None, [1.0] * 36), (2, [1.0] * 36, None), (3, [1.0] * 36, [1.0] * 30), (4, [], []), (5, [1.0] * 6, [1.0] * 6)]
    df = spark.createDataFrame(rows, "frame_num long, before array<double>, thumb array<double>")
    assert flow.flow_vectors(df, 6).count() == 0


def kernel_by_hand(source, target, kind):
    """Weights of one target pixel after the other."""
    out = np.zeros((target, source))
    for i in range(target):
        center = (i + 0.5) * source / target - 0.5
        if kind == "lanczos":
            for k in range(int(np.floor(center)) - 3, int(np.floor(center)) + 5):
                x = center - k
                w = 1.0 if x == 0 else np.sin(np.pi * x) * np.sin(np.pi * x / 4) * 4 / (np.pi * x) ** 2
                out[i, min(max(k, 0), source - 1)] += w
            out[i] /= out[i].sum()
        elif target <= source:
            for k in range(source):
                out[i, k] = max(0.0, min((i + 1) * source / target, k + 1) - max(i * source / target, k)) * target / source
        else:
            center = min(max(center, 0), source - 1)
            k = min(int(center), source - 2) if source > 1 else 0
            out[i, k] = 1 - (center - k)
            if source > 1:
                out[i, k + 1] = center - k
    return out


@given(st.integers(1, 40), st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_kernels(source, target):
    assert np.allclose(features._lanczos(source, target), kernel_by_hand(source, target, "lanczos"))
    assert np.allclose(features._area(source, target), kernel_by_hand(source, target, "area"))
    for weights in (features._lanczos, features._area):
        assert np.allclose(weights(source, target).sum(axis=1), 1)


def test_ranges_of_augmentation():
    p = features.Augmentation()
    assert (p.quality, p.detail_noise, p.macro_noise, p.macro_resize, p.offset) == ((13, 55), (0.0003, 0.01), (0.0001, 0.019), (1.0, 5.0), (-7.0, 7.0))
    assert p.resolutions == ((1280, 720), (1920, 1080)) and p.passthrough == 0.02


def test_colour_through_jpeg():
    rng = np.random.default_rng(1)
    smooth = np.clip(np.cumsum(rng.normal(0, 3, (33, 47, 3)), axis=1) + 128, 0, 255).astype(np.uint8)
    losses = [np.abs(features.jpeg_colour(smooth, q).astype(int) - smooth).mean() for q in (90, 50, 13)]
    assert 0 < losses[0] < losses[1] < losses[2] < 25
    for colour in ([200, 30, 30], [20, 200, 90], [128, 128, 128]):
        flat = np.full((17, 9, 3), colour, np.uint8)
        assert np.abs(features.jpeg_colour(flat, 60).astype(int) - flat).max() <= 12


def test_chrominance_is_kept_at_half_the_size():
    stripes = np.zeros((16, 16, 3), np.uint8)
    stripes[:, ::2], stripes[:, 1::2] = (255, 0, 0), (0, 0, 255)  # red and blue by turns
    out = features.jpeg_colour(stripes, 95).astype(int)
    assert np.abs(out[:, ::2, 0] - out[:, 1::2, 0]).mean() < 100  # from 255


def test_variations_are_drawn_again_alike():
    small = features.Augmentation(resolutions=((96, 54),))
    picture = np.clip(np.cumsum(np.random.default_rng(3).normal(0, 4, (36, 64, 3)), axis=1) + 128, 0, 255).astype(np.uint8)
    made = [features.vary(picture, np.random.default_rng(i), small) for i in range(40)]
    assert all((a == b).all() for a, b in zip(made, (features.vary(picture, np.random.default_rng(i), small) for i in range(40)), strict=True))
    assert {m.shape[2] for m in made} <= {1, 3} and all(m.shape[:2] == (36, 64) for m in made)
    grey = picture @ features.GREY
    assert all(0 < np.abs(m[:, :, 0] - grey).mean() < 15 for m in made if m.shape[2] == 1)
    through = features.Augmentation(resolutions=((96, 54),), passthrough=1.0)
    passed = features.vary(picture, np.random.default_rng(0), through)
    assert passed.shape == (36, 64, 3) and np.abs(passed.astype(int) - picture).mean() < 3
