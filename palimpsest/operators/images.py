"""Checks of page images, an image a row, by Arrow batches; statistics over blocks then go through the operators of structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import raster as R

FINDINGS = "kind string, x int, y int, width int, height int, confidence double"
BLOCKS = "br int, bc int, mean double, std double, noise double, energy double"


def rgb_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgb"], np.uint8).reshape(row["height"], row["width"], 3)


def each_image(rasters: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """work(pixels, row) gives rows of the schema for every raster (keys, width, height, rgb); one image is in memory at a time."""
    kinds = dict(rasters.dtypes)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                if row["rgb"] is None or not row["width"] or not row["height"]:
                    continue
                found = list(work(rgb_of(row), row))
                if found:
                    columns = {k: one.column(k).take(pa.array(np.zeros(len(found), np.int64))) for k in keys}
                    yield pa.RecordBatch.from_arrays([*columns.values(), *[pa.array([f[n] for f in found], out.field(n).type) for n in names]], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    out = to_arrow_schema(_parse_datatype_string(whole))
    return rasters.select(*keys, *[c for c in rasters.columns if c not in keys]).mapInArrow(run, whole)


def finding(kind: str, box: tuple, confidence: float) -> dict:
    return dict(zip(("kind", "x", "y", "width", "height", "confidence"), (kind, *box, float(confidence))))


def image_findings(rasters: DataFrame, keys: list[str], container: str = "container") -> DataFrame:
    """keys and FINDINGS: flat patches, crisp overlays, ink that is filled or pasted, paper of another colour. Born-digital images (no noise, no trace of compression) get no check of smoothness. rasters may have a column container."""

    def work(rgb: np.ndarray, row: dict):
        gray = R.gray_of(rgb)
        _, base = R.local_std(gray)
        born = base < R.RENDER_FLOOR and not R.was_compressed(gray, row.get(container) or "")
        if not born:
            yield from (finding("flat_zone", z["box"], z["confidence"]) for z in R.flat_zones(gray)[0])
        regions, usual = R.sharp_regions(gray)
        yield from (finding("sharp_overlay_edge", z["box"], z["confidence"]) for z in regions)
        sharp, _ = R.sharpness(gray)
        for part in R.ink_parts(rgb):
            even = R.flat_ink(gray, part["mask"], base) if not born and part["kind"] == "stamp" else None
            cut = R.cut_ink(sharp, part["mask"], usual) if usual and usual <= R.CRISP else None
            yield from (finding(kind, part["box"], c) for kind, c in (("flat_ink_fill", even), ("pasted_stamp_boundary", cut)) if c is not None)
        yield from (finding("background_color_mismatch", z["box"], z["confidence"]) for z in R.paper_patches(rgb))

    return each_image(rasters, keys, FINDINGS, work)


def image_blocks(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys and BLOCKS: mean, spread, noise and energy of high frequencies (the mean of the four 8 x 8 blocks) of every 16 x 16 block."""

    def work(rgb: np.ndarray, _):
        gray = R.gray_of(rgb)
        mean, std = R.block_stats(gray)
        noise = R.noise_blocks(gray)
        h, w = mean.shape
        energy = R.high_frequencies(gray)[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean((1, 3)) if h and w else mean
        for y in range(h):
            for x in range(w):
                yield {"br": y, "bc": x, "mean": mean[y, x], "std": std[y, x], "noise": noise[y, x], "energy": energy[y, x]}

    return each_image(rasters, keys, BLOCKS, work)


def page_noise(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, noise (median of the blocks' noise), baseline (of the local spread), grid_z (the weaker of the two directions) of every image."""

    def work(rgb: np.ndarray, _):
        gray = R.gray_of(rgb)
        held = R.noise_blocks(gray)
        yield {"noise": float(np.median(held)) if held.size else 0.0, "baseline": R.local_std(gray)[1], "grid_z": min(R.grid_phases(gray))}

    return each_image(rasters, keys, "noise double, baseline double, grid_z double", work)


def line_crops(rasters: DataFrame, keys: list[str], dpi: str = "dpi", lines: str = "lines") -> DataFrame:
    """keys, line, noise, sharpness of the boxes (points) that a raster's column lines lists: line, x0, y0, x1, y1."""

    def work(rgb: np.ndarray, row: dict):
        gray = R.gray_of(rgb)
        for x in row[lines] or []:
            noise, sharp = R.crop_features(gray, (x["x0"], x["y0"], x["x1"], x["y1"]), row[dpi] / 72)
            yield {"line": x["line"], "noise": noise, "sharpness": sharp}

    return each_image(rasters, keys, "line int, noise double, sharpness double", work)
