"""Image kernels on planted images."""

import numpy as np
import pytest

from palimpsest.functions import raster as R
from palimpsest.operators import images


def scan(h=320, w=320, noise=4.0, seed=0, level=200):
    return np.clip(np.random.RandomState(seed).normal(level, noise, (h, w)), 0, 255).astype(np.uint8)


def rgb_of(gray):
    return np.repeat(gray[..., None], 3, 2)


def test_means_and_extremes_of_squares():
    x = np.random.RandomState(1).randint(0, 255, (20, 23)).astype(np.uint8)
    wide = np.pad(x.astype(float), 3, mode="reflect")
    assert np.allclose(R.box_mean(x, 7), [[wide[i : i + 7, j : j + 7].mean() for j in range(23)] for i in range(20)])
    assert (R.spread(x, 7) == [[x[max(0, i - 3) : i + 4, max(0, j - 3) : j + 4].max() for j in range(23)] for i in range(20)]).all()
    assert (R.spread(x, 7, np.minimum) == [[x[max(0, i - 3) : i + 4, max(0, j - 3) : j + 4].min() for j in range(23)] for i in range(20)]).all()


@pytest.mark.parametrize("seed", range(5))
def test_parts_against_a_flood_fill(seed):
    grid = np.random.RandomState(seed).rand(17, 19) < 0.4
    parts, n = R.labels(grid)
    left, number = {tuple(p) for p in np.argwhere(grid)}, 0
    while left:
        number += 1
        todo, part = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                part.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert {parts[p] for p in part} == {number}
    assert n == number and (parts[~grid] == 0).all()


def test_a_pasted_patch_is_flat_and_glare_is_not():
    page = scan()
    page[96:192, 96:208] = 200
    zones, glare = R.flat_zones(page)
    assert len(zones) == 1 and not glare and zones[0]["confidence"] > 0.7
    x, y, w, h = zones[0]["box"]
    assert abs(x - 96) <= 16 and abs(y - 96) <= 16 and abs(w - 112) <= 32 and abs(h - 96) <= 32
    # noise that fades over many pixels towards a bright spot
    far = np.hypot(*np.meshgrid(np.arange(320) - 160, np.arange(320) - 160))
    share = np.clip((far - 60) / 90, 0, 1)
    shine = np.clip(200 + 55 * (1 - share) + np.random.RandomState(2).normal(0, 4, far.shape) * share, 0, 255).astype(np.uint8)
    zones, glare = R.flat_zones(shine)
    assert not zones and glare


def test_renders_without_noise_have_no_flat_zones():
    assert R.flat_zones(np.full((160, 160), 250, np.uint8)) == ([], [])


def blurred(x, times=4):
    for _ in range(times):
        x = R.box_mean(x, 5)
    return x


def test_crisp_text_on_a_soft_photo():
    bars = np.where(np.arange(320)[None] // 8 % 2 == 0, 40, 220) * np.ones((320, 1))
    soft = blurred(bars, 1)
    soft = np.where(np.arange(320)[None] % 64 < 60, soft, soft)
    soft[128:192, 128:224] = bars[128:192, 128:224]
    found, usual = R.sharp_regions(soft.astype(np.uint8))
    assert usual < R.CRISP and len(found) == 1
    x, y, w, h = found[0]["box"]
    assert (x, y) == (128, 128) and w >= 64 and h >= 64
    assert R.sharp_regions(bars.astype(np.uint8))[0] == []  # all of it is crisp


def test_grid_of_compression():
    x = scan(seed=3).astype(float)
    plain = x.copy()
    x += np.kron(np.random.RandomState(4).normal(0, 8, (40, 40)), np.ones((8, 8)))  # blocks of their own brightness
    assert R.was_compressed(np.clip(x, 0, 255).astype(np.uint8), "PNG") and not R.was_compressed(plain.astype(np.uint8), "PNG") and R.was_compressed(plain, "JPEG")


def test_cosines_are_orthonormal():
    x = scan(16, 16, seed=4)
    assert np.isclose((R.cosines(x) ** 2).sum(), ((x.astype(float) - 128) ** 2).sum())


def quantised(gray, step):
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    c = np.rint(R.cosines(gray) / step) * step
    back = basis.T @ c @ basis + 128
    h, w = c.shape[:2]
    return np.clip(np.rint(back.transpose(0, 2, 1, 3).reshape(h * 8, w * 8)), 0, 255).astype(np.uint8)


def test_compression_twice():
    page = scan(512, 512, 25.0, 5, 128)
    once = quantised(page, 2)
    twice = quantised(quantised(page, 9), 2)
    steps = np.full(64, 2)
    assert R.compression_count(twice, steps) == "double" and R.compression_count(once, steps) == "single"
    assert R.compression_count(once, None) == "uncertain" == R.compression_count(once[:40], steps)


def test_stamp_and_signature():
    page = rgb_of(scan(seed=6, level=225))
    page[60:120, 60:140] = (200, 30, 30)
    page[200:204, 40:260] = (30, 30, 200)
    parts = {p["kind"]: p for p in R.ink_parts(page)}
    assert parts["stamp"]["box"] == (60, 60, 80, 60) and parts["signature"]["box"][2] >= 200
    gray = R.gray_of(page)
    assert R.flat_ink(gray, parts["stamp"]["mask"], 4.0) == 1.0
    page[60:120, 60:140] = np.clip(np.array((200, 60, 60)) + np.random.RandomState(1).normal(0, 14, (60, 80, 1)), 0, 255)
    assert all(R.flat_ink(R.gray_of(page), p["mask"], 4.0) is None for p in R.ink_parts(page) if p["kind"] == "stamp")


def test_thickness():
    mask = np.zeros((30, 60), bool)
    mask[10:21, 5:55] = True
    assert 5 <= R.thickness(mask) <= 6.1


def test_paper_of_another_colour():
    rng = np.random.RandomState(7)
    page = np.clip(rng.normal(225, 3, (480, 480, 3)), 0, 255)
    page[160:288, 160:304] += (4, 4, -2)
    found = R.paper_patches(np.clip(np.rint(page), 0, 255).astype(np.uint8))
    assert len(found) == 1
    x, y, w, h = found[0]["box"]
    assert abs(x - 160) <= 16 and abs(y - 160) <= 16 and abs(w - 144) <= 32 and abs(h - 128) <= 32
    slope = np.clip(rng.normal(225, 3, (480, 480, 3)) + np.linspace(-10, 10, 480)[None, :, None], 0, 255).astype(np.uint8)
    assert R.paper_patches(slope) == [] == R.paper_patches(np.full((480, 480, 3), 225, np.uint8))


def test_images_as_rows(spark):
    page = scan()
    page[96:192, 96:208] = 200
    rows = [(1, 320, 320, bytearray(rgb_of(page).tobytes()), "PNG"), (2, 320, 320, bytearray(rgb_of(scan(seed=9)).tobytes()), "PNG"), (3, 0, 0, None, None)]
    table = spark.createDataFrame(rows, "doc int, width int, height int, rgb binary, container string")
    found = images.image_findings(table, ["doc"]).collect()
    assert {(r.doc, r.kind) for r in found} == {(1, "flat_zone")}
    blocks = images.image_blocks(table, ["doc"])
    assert blocks.groupBy("doc").count().collect() and blocks.count() == 800
    assert {r.doc for r in images.page_noise(table, ["doc"]).collect()} == {1, 2}
    lined = table.selectExpr("*", "150 as dpi", "array(named_struct('line', 1, 'x0', 1.0D, 'y0', 1.0D, 'x1', 20.0D, 'y1', 20.0D)) as lines")
    assert [r.line for r in images.line_crops(lined, ["doc"]).collect()] == [1, 1]
