"""Boxes, images and characters that were laid over a page's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import box, intersects, overlap
from .spatial import grid_join, outside

#: Fixed values.
SIDE, AREA, PAGE_SHARE = 6, 6000, 0.5
FILL, BACKGROUND = 0.85, 0.15
ROW_SIZE, ROW_COUNT, ROW_SPREAD = 2.0, 3, 0.3
COVERED = 0.4
CHARS, WIDTHS, WIDTH_Z, WIDTH_STD = 4, 3, 4.0, 0.01
CHECKS = ("covering_rect", "ghost_text", "coordinate_overwrite", "image_overlay", "char_spacing")
SHOWN = 20


def targeted(page_area: Column) -> Column:
    """Whether a box has the size of one that hides a field: not a hairline, not a panel."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return (w >= SIDE) & (h >= SIDE) & (w * h <= AREA) & ~F.coalesce((page_area > 0) & (w * h / page_area > PAGE_SHARE), F.lit(False))


def covers(fill: Column, background: Column) -> Column:
    """Whether a filled box hides what is under it: nearly white, or of the colour around it (arrays of channels from 0 to 1; the background may be null)."""
    white = F.coalesce((F.size(fill) >= 3) & F.forall(F.slice(fill, 1, 3), lambda c: c > FILL), F.lit(False))
    apart = F.sqrt(F.aggregate(F.zip_with(F.slice(fill, 1, 3), F.slice(background, 1, 3), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return white | F.coalesce((F.size(fill) >= 3) & (apart < BACKGROUND), F.lit(False))


def touching(rows: DataFrame, blocks: DataFrame, on: list[str], order: str = "ord", size: float = 64) -> DataFrame:
    """The rows whose box meets a block's."""
    met = grid_join(rows, blocks, on, size, intersects(box("a_"), box("b_"))).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return rows.join(met, [*on, order], "left_semi")


def row_pattern(rects: DataFrame, on: list[str], order: str = "ord") -> DataFrame:
    """on, order of the boxes of about one size that follow each other at even distances, as rows of a table do."""
    kind = [*on, "__w", "__h"]
    sized = rects.withColumn("__w", F.bround((F.col("x1") - F.col("x0")) / ROW_SIZE)).withColumn("__h", F.bround((F.col("y1") - F.col("y0")) / ROW_SIZE))
    step = F.col("y0") - F.lag("y0").over(Window.partitionBy(*kind).orderBy("y0", order))
    rows = sized.withColumn("__step", step)
    spread = F.coalesce(F.stddev_samp("__step"), F.lit(0.0)) / F.avg("__step")
    even = rows.groupBy(*kind).agg(F.count("*").alias("__n"), F.avg("__step").alias("__mean"), spread.alias("__cv")).where((F.col("__n") >= ROW_COUNT) & (F.col("__mean") > 0) & (F.col("__cv") <= ROW_SPREAD))
    return rows.join(even.select(*kind), kind, "left_semi").select(*on, order)


def painted_over(rects: DataFrame, traces: DataFrame, on: list[str], order: str = "ord", size: float = 64) -> DataFrame:
    """The boxes that were drawn after a text of which they cover COVERED or more; a box without a place in the paint order is taken for one."""
    w, h = overlap(box("a_"), box("b_"))
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    later = rects.where("seqno is not null")
    met = grid_join(later, traces, on, size, (w > 0) & (h > 0) & (area > 0) & (F.col("b_seqno") < F.col("a_seqno")) & (w * h >= COVERED * area)).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return later.join(met, [*on, order], "left_semi").unionByName(rects.where("seqno is null"))


def covering_rects(rects: DataFrame, blocks: DataFrame, traces: DataFrame, on: list[str], page_area: float, zones: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Boxes that hide text: of the size and colour for it, outside codes (zones), over a block, no row of a table, and painted after the text."""
    fit = rects.where(targeted(F.lit(page_area)) & covers(F.col("fill"), F.col("background")))
    fit = outside(fit, zones, on, order) if zones is not None else fit
    over = touching(fit, blocks, on, order)
    single = over.join(row_pattern(over, on, order), [*on, order], "left_anti")
    return painted_over(single, traces, on, order)


def image_overlays(images: DataFrame, blocks: DataFrame, on: list[str], page_area: float, order: str = "ord") -> DataFrame:
    """Images of the size of a patch that meet a block of text."""
    return touching(images.where(targeted(F.lit(page_area))), blocks, on, order)


def without_ghosts(overwrites: DataFrame, ghosts: DataFrame, on: list[str], order: str = "ord", size: float = 64) -> DataFrame:
    """The overwritten spans that no ghost text (box) has reported already."""
    met = grid_join(overwrites, ghosts, on, size, intersects(box("a_"), box("b_"))).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return overwrites.join(met, [*on, order], "left_anti")


def char_advances(chars: DataFrame, span: list[str]) -> DataFrame:
    """span, i, width, mean, z of the characters whose advance is far from their span's; chars: i, x (of the origin).

    Of a span of CHARS or more characters the advances above 0 are numbered as they come, and a finding names the character with that number, as the place of an advance among the positive ones does.
    """
    inside = Window.partitionBy(*span)
    rows = chars.withColumn("__n", F.count("*").over(inside)).withColumn("width", F.lead("x").over(inside.orderBy("i")) - F.col("x")).where((F.col("__n") >= CHARS) & (F.col("width") > 0))
    rows = rows.withColumn("__k", F.count("*").over(inside)).where(F.col("__k") >= WIDTHS).withColumn("mean", F.avg("width").over(inside)).withColumn("__std", F.stddev_samp("width").over(inside)).withColumn("i", F.row_number().over(inside.orderBy("i")) - 1)
    z = F.abs(F.col("width") - F.col("mean")) / F.greatest(F.coalesce("__std", F.lit(0.0)), F.lit(WIDTH_STD))
    return rows.withColumn("z", z).where(F.col("z") >= WIDTH_Z).select(*span, "i", "width", "mean", "z")


def reported(found: DataFrame, key: str, most: int = SHOWN) -> DataFrame:
    """The first findings of each document, by page, check and order, with rank; found: page, kind, ord."""
    place = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("kind"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("page", place, "ord"))).where(F.col("rank") <= most)
