"""Boxes to draw on pages: where, in which colour, with which words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import box, intersects
from .spatial import grid_join

#: Colours by kind of finding, and the words for a reason by how it begins.
COLOURS = {"content": "255,50,50", "numeric": "255,220,0", "ela": "180,0,255", "covering_rect": "0,200,255", "image_overlay": "255,0,200", "ghost_text": "255,200,0", "text_stacking": "255,0,255", "embedded_image": "0,190,90"}
CONTENT_LABELS = {"font_size": "Font Size Mismatch", "font": "Font Mismatch", "char_spacing": "Char Spacing Anomaly", "word_spacing": "Word Spacing Anomaly", "line_height": "Line Height Anomaly", "noise": "Visual Noise Outlier", "sharpness": "Sharpness Outlier", "uniform": "Uniform Spacing (Retyped?)", "replacement": "Font Encoding Mismatch", "line_gap": "Abnormal Line Gap"}
OVERLAY_LABELS = {"covering_rect": "White-Out Cover-Up", "image_overlay": "Hidden Image Overlay", "ghost_text": "Ghost Text (Layered)"}
#: Days since the edit, below which the colour has these parts of red, green and blue.
AGES = ((1, (1.0, 0.3, 0.3)), (7, (1.0, 0.5, 0.3)), (30, (1.0, 0.7, 0.4)), (180, (0.9, 0.8, 0.5)), (365, (0.8, 0.8, 0.6)))
OLD, UNKNOWN_AGE = (0.6, 0.6, 0.6), (1.0, 1.0, 1.0)
BOX = ("x0", "y0", "x1", "y1")


def label(layer: Column, line: Column, reason: Column, context: Column, z: Column) -> Column:
    """The words on a finding's box."""
    names = F.create_map(*[F.lit(x) for pair in CONTENT_LABELS.items() for x in pair])
    content = F.format_string("Line %d: %s", line + 1, F.coalesce(F.element_at(names, reason), F.substring(F.coalesce(reason, F.lit("Content Anomaly")), 1, 34)))
    numeric = F.when(context.startswith("running_balance"), "Balance Mismatch").when(context.startswith("arithmetic_"), "Arithmetic Inconsistency").otherwise(F.format_string("Statistical Outlier (z=%.1f)", z))
    overlays = F.create_map(*[F.lit(x) for pair in OVERLAY_LABELS.items() for x in pair])
    return F.when(layer == "content", content).when(layer == "numeric", numeric).otherwise(F.coalesce(F.element_at(overlays, reason), reason))


def age_colour(days: Column) -> Column:
    """Array of the parts of red, green and blue for an edit so many days ago."""
    out = F.array(*[F.lit(x) for x in OLD])
    for below, parts in reversed(AGES):
        out = F.when(days < below, F.array(*[F.lit(x) for x in parts])).otherwise(out)
    return F.when(days.isNull(), F.array(*[F.lit(x) for x in UNKNOWN_AGE])).otherwise(out)


def merged_boxes(boxes: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """key, page, grp, kind, texts, box: a page's boxes (kind, texts), in order, each joined to the first group whose box so far it meets; the group's box grows. One replaced box makes its group replaced; texts are kept once, in order."""
    cast = {c: dict(boxes.dtypes)[c] for c in (key, "page")}

    def run(table: pa.Table) -> pa.Table:
        groups: list[dict] = []
        for row in table.sort_by(order).to_pylist():
            at = next((g for g in groups if row["x0"] < g["x1"] and row["x1"] > g["x0"] and row["y0"] < g["y1"] and row["y1"] > g["y0"]), None)
            if at is None:
                at = {**{c: row[c] for c in (key, "page", "kind", *BOX)}, "grp": len(groups), "texts": []}
                groups.append(at)
            for c, pick in zip(BOX, (min, min, max, max)):
                at[c] = pick(at[c], row[c])
            at["kind"] = "replaced" if row["kind"] == "replaced" else at["kind"]
            at["texts"] += [t for t in dict.fromkeys(row["texts"] or []) if t not in at["texts"]]
        return pa.Table.from_pylist(groups, out)

    kind = f"{key} {cast[key]}, page {cast['page']}, grp int, kind string, texts array<string>, x0 double, y0 double, x1 double, y1 double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(kind))
    return boxes.groupBy(key, "page").applyInArrow(run, kind)


def absorbed(findings: DataFrame, boxes: DataFrame, key: str, size: float = 64) -> tuple[DataFrame, DataFrame]:
    """The findings (layer, ord, box) that meet none of their page's merged boxes; and the boxes with also_flagged_by, the layers of those that do, each counted at the first box that it meets."""
    on = [key, "page"]
    rows = findings.withColumn("__id", F.struct("layer", "ord"))
    met = grid_join(rows, boxes.select(*on, "grp", *BOX), on, size, intersects(box("a_"), box("b_")))
    first = met.groupBy(*on, F.col("a_layer").alias("layer"), F.col("a_ord").alias("ord")).agg(F.min("b_grp").alias("grp"))
    also = first.groupBy(*on, "grp").agg(F.array_sort(F.collect_set("layer")).alias("also_flagged_by"))
    left = findings.join(first, [*on, "layer", "ord"], "left_anti")
    return left, boxes.join(also, [*on, "grp"], "left").withColumn("also_flagged_by", F.coalesce("also_flagged_by", F.array().cast("array<string>")))


def boxes_to_draw(findings: DataFrame, key: str, scale: float = 150 / 72, padding: int = 4) -> DataFrame:
    """key, page (from 1), layer, ord, label, colour and the box in pixels; findings: layer, kind, ord, line, reason, context, z, box in points."""
    colour = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    shown = F.coalesce(F.element_at(colour, F.col("kind")), F.element_at(colour, F.col("layer")))
    edges = [(F.floor(F.col(c) * scale) + (padding if c in ("x1", "y1") else -padding)).cast("int").alias(c) for c in BOX]
    return findings.select(key, (F.col("page") + 1).alias("page"), "layer", "ord", label(F.col("layer"), F.col("line"), F.col("reason"), F.col("context"), F.col("z")).alias("label"), shown.alias("colour"), *edges)


def anchors(points: DataFrame, on: list[str], order: str = "ord", distance: float = 30.0) -> DataFrame:
    """on, order, grp: in order, a point (x0, y0) that is in no group yet takes all later ones within the distance of it."""
    import numpy as np

    kinds = dict(points.dtypes)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order)
        at = np.stack([rows[c].to_numpy() for c in ("x0", "y0")], 1)
        out, left, number = np.zeros(len(at), np.int32), np.arange(len(at)), 0
        while len(left):
            near = ((at[left] - at[left[0]]) ** 2).sum(1) < distance**2
            out[left[near]] = number
            left, number = left[~near], number + 1
        return rows.select([*on, order]).append_column("grp", pa.array(out))

    return points.select(*on, order, "x0", "y0").groupBy(*on).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*on, order]) + ", grp int")
