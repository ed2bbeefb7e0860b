"""Boxes: columns x0, y0, x1, y1 with a prefix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def overlap(a, b) -> tuple[Column, Column]:
    """Common width and height; negative if apart."""
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])


def overlap_of_smaller(a, b) -> Column:
    """Common area as a share of the smaller box's."""
    w, h = overlap(a, b)
    smaller = F.least((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return F.when((w > 0) & (h > 0) & (smaller > 0), w * h / smaller).otherwise(0.0)


def intersects(a, b) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def centres_within(a, b, distance: float) -> Column:
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    return F.sqrt(dx * dx + dy * dy) < distance


def same_row(a, b, share: float = 0.5) -> Column:
    """The boxes' heights overlap by that share of the smaller one."""
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    smaller = F.least(a[3] - a[1], b[3] - b[1])
    return (h > 0) & ((smaller <= 0) | (h >= share * smaller))


def pixel_box(pixels, image: tuple[Column, Column], place) -> tuple[Column, Column, Column, Column]:
    """A box of an image's pixels (x, y, width, height) in points, by the place (x0, y0, x1, y1) where the image of that width and height stands."""
    x, y, w, h = pixels
    across, down = (place[2] - place[0]) / image[0], (place[3] - place[1]) / image[1]
    return place[0] + x * across, place[1] + y * down, place[0] + (x + w) * across, place[1] + (y + h) * down


def block_pixels(dpi: Column, points: float, least: int = 8) -> Column:
    """Pixels of a block of so many points at a resolution."""
    return F.greatest(F.lit(least), F.bround(dpi * points / 72, 0).cast("int"))


def code_shaped(a, page_area: Column, low: float = 0.8, high: float = 1.2, most: float = 0.15) -> Column:
    """Whether a box has the shape and size of a printed code: about square, a small part of the page."""
    w, h = a[2] - a[0], a[3] - a[1]
    return (w > 0) & (h > 0) & (w / h).between(low, high) & (w * h < most * page_area)
