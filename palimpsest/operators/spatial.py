"""Joins of boxes on a page, by a grid of cells and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import box, intersects, overlap, overlap_of_smaller
from ..functions.numeric import currency_value


def cells(rows: DataFrame, size: float) -> DataFrame:
    """Each row once for every cell that its box touches."""
    at = lambda c: F.floor(F.col(c) / size)
    return rows.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))


def named(rows: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return rows.select(*[c if c in keep else F.col(c).alias(prefix + c) for c in rows.columns])


def grid_join(left: DataFrame, right: DataFrame, on: list[str], size: float, keep, how: str = "inner") -> DataFrame:
    """Pairs of boxes that touch a common cell and fulfil keep; columns a_* and b_*.

    A pair counts only in the lowest cell that both touch, so no distinct is needed. Giant boxes touch many
    cells; choose the size near that of a usual box.
    """
    a, b = named(cells(left, size), "a_", [*on, "cx", "cy"]), named(cells(right, size), "b_", [*on, "cx", "cy"])
    lowest = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / size)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / size))
    return a.join(b, [*on, "cx", "cy"]).where(lowest).where(keep).drop("cx", "cy")


def stacked_pairs(spans: DataFrame, on: list[str], order: str = "ord", least: float = 0.5, size: float = 64) -> DataFrame:
    """Pairs of different texts of which one covers so much of the other."""
    share = overlap_of_smaller(box("a_"), box("b_"))
    # a span's bare text and amount are made once, not for every pair
    rows = spans.withColumn("bare", F.regexp_replace("text", r"\s+", "")).where("bare <> ''").withColumn("amount", currency_value(F.col("text")))
    differ = (F.col("a_bare") != F.col("b_bare")) & ~F.coalesce(F.col("a_amount") == F.col("b_amount"), F.lit(False))
    met = grid_join(rows, rows, on, size, (F.col(f"a_{order}") < F.col(f"b_{order}")) & (share >= least) & differ)
    return met.drop("a_bare", "b_bare", "a_amount", "b_amount").withColumn("overlap", share)


def ghosts(blocks: DataFrame, on: list[str], page_area: float, order: str = "ord", size: float = 64) -> DataFrame:
    """Pairs of small blocks of different text that overlap by more than 5 points either way and 0.3 of the smaller."""
    small = blocks.withColumn("text", F.trim("text")).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= 0.3 * page_area).where(F.length("text") >= 2)
    w, h = overlap(box("a_"), box("b_"))
    share = overlap_of_smaller(box("a_"), box("b_"))
    return grid_join(small, small, on, size, (F.col(f"a_{order}") < F.col(f"b_{order}")) & (F.col("a_text") != F.col("b_text")) & (w > 5) & (h > 5) & (share > 0.3)).withColumn("overlap", share)


def covered(spans: DataFrame, rects: DataFrame, on: list[str], order: str = "ord", least: float = 0.4, size: float = 64) -> DataFrame:
    """Rectangles drawn after a span of which they cover so much; a span without a place in the paint order passes."""
    w, h = overlap(box("a_"), box("b_"))
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    later = F.col("b_seqno").isNull() | (F.col("b_seqno") < F.col("a_seqno"))
    met = grid_join(rects, spans, on, size, (w > 0) & (h > 0) & later & (w * h >= least * area))
    return met.groupBy(*on, F.col(f"a_{order}").alias(order)).agg(F.count("*").alias("n_covered"), F.min(f"b_{order}").alias("first_covered"))


def outside(rows: DataFrame, zones: DataFrame, on: list[str], order: str = "ord", size: float = 64) -> DataFrame:
    """Rows whose box meets no zone."""
    met = grid_join(rows, zones, on, size, intersects(box("a_"), box("b_"))).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return rows.join(met, [*on, order], "left_anti")


def overwritten(spans: DataFrame, on: list[str], order: str = "ord") -> DataFrame:
    """Spans at the same box, to a tenth of a point, as an earlier span of another text (without blanks around it); each is held against the first. Blank spans take no part."""
    key = [F.bround(c, 1) for c in box()]
    place = Window.partitionBy(*on, *key).orderBy(order)
    digest = F.sha2("text", 256)
    out = spans.withColumn("text", F.trim("text")).where("text <> ''").withColumn("first_text", F.first("text").over(place)).withColumn("first_ord", F.first(order).over(place))
    return out.where(F.sha2("first_text", 256) != digest)


def y_buckets(spans: DataFrame, on: list[str], order: str = "ord", size: float = 64) -> DataFrame:
    """Pairs of different texts on one line (2 points) that overlap by more than 5 points or begin within 5. They meet by cells along the line, so a crowded line is no join of all its spans."""
    at = lambda c: F.floor(c / size)
    line = spans.withColumn("y_key", F.bround((F.col("y0") + F.col("y1")) / 2 / 2) * 2).withColumn("cx", F.explode(F.sequence(at(F.col("x0") - 2.5), at(F.col("x1") + 2.5))))
    cell = [*on, "y_key", "cx"]
    a, b = named(line, "a_", cell), named(line, "b_", cell)
    w, _ = overlap(box("a_"), box("b_"))
    near = (w > 5) | (F.abs(F.col("a_x0") - F.col("b_x0")) < 5)
    lowest = F.col("cx") == at(F.greatest("a_x0", "b_x0") - 2.5)
    return a.join(b, cell).where(lowest & (F.col(f"a_{order}") < F.col(f"b_{order}")) & (F.col("a_text") != F.col("b_text")) & near).drop("cx")
