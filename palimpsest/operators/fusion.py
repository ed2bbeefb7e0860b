"""Findings of all layers together: which agree, which are contradicted, and what that does to the score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import same_row
from .spatial import named
from .verdicts import rescored, weight

#: Fixed values.
NEAR, FALLBACK = 50.0, (0.0, 0.0, 100.0, 20.0)
AGREED = {2: ("MEDIUM", 70), 3: ("HIGH", 90)}
WITH_METADATA = ("HIGH", 85)
REPEAT_PAGES, CELL, TEXT_KEY, POINTS, ROW_SHARE = 3, 10, 25, 10, 0.5
#: The order in which layers' findings are taken.
LAYERS = ("content", "numeric", "ela", "pymupdf", "image", "metadata")
COLUMNS = ["layer", "layer_ord", "ord", "page", "line", "text", "score", "x0", "y0", "x1", "y1"]


def findings_union(found: dict[str, DataFrame], key: str) -> DataFrame:
    """key and COLUMNS of the findings of all layers; each: ord, page, score, and line, text, box, where it has them. Metadata come last, without a place."""
    out = None
    for layer in LAYERS:
        if layer in found:
            rows = found[layer]
            kinds = {"layer": F.lit(layer), "layer_ord": F.lit(LAYERS.index(layer))}
            for name, kind in (("ord", "long"), ("page", "long"), ("line", "long"), ("text", "string"), ("score", "double"), ("x0", "double"), ("y0", "double"), ("x1", "double"), ("y1", "double")):
                there = name in rows.columns and not (layer == "metadata" and name in ("line", "x0", "y0", "x1", "y1"))
                kinds[name] = F.col(name).cast(kind) if there else F.lit(None).cast(kind)
            rows = rows.select(key, *[c.alias(n) for n, c in kinds.items()])
            out = rows if out is None else out.unionByName(rows)
    return out


def groups(page: np.ndarray, line: np.ndarray, box: np.ndarray, anywhere: np.ndarray) -> np.ndarray:
    """The group of each finding: in order, a finding that is in no group yet takes all later ones that match it, and only it.

    A finding anywhere matches all. Others match on one page, if their lines are equal, or a box is missing, or the boxes overlap or have centres within NEAR. line and box are nan where missing.
    """
    out = np.full(len(page), -1)
    boxed = ~np.isnan(box[:, 0])
    centre = (box[:, :2] + box[:, 2:]) / 2
    number = 0
    left = np.arange(len(page))
    while len(left):
        i, rest = left[0], left[1:]
        close = (box[rest, 0] < box[i, 2]) & (box[rest, 2] > box[i, 0]) & (box[rest, 1] < box[i, 3]) & (box[rest, 3] > box[i, 1])
        close |= np.sqrt(((centre[rest] - centre[i]) ** 2).sum(1)) < NEAR
        match = anywhere[i] | anywhere[rest] | ((page[rest] == page[i]) & ((line[rest] == line[i]) | ~boxed[i] | ~boxed[rest] | close))
        out[i] = out[rest[match]] = number
        left = rest[~match]
        number += 1
    return out


def grouped(findings: DataFrame, key: str) -> DataFrame:
    """findings with grp (from 0, in the order of anchors) by document. A document's findings are one group of rows, as the result depends on their order."""
    kind = findings.select(key, *COLUMNS).schema.simpleString()[7:-1].replace(":", " ")

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("layer_ord", "ascending"), ("ord", "ascending")])
        number = lambda c: rows[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        box = np.stack([number(c) for c in ("x0", "y0", "x1", "y1")], 1)
        with np.errstate(invalid="ignore"):
            found = groups(number("page"), number("line"), box, np.array([x == "metadata" for x in rows["layer"].to_pylist()], bool))
        return rows.append_column("grp", pa.array(found, pa.int32()))

    return findings.select(key, *COLUMNS).groupBy(key).applyInArrow(run, f"{kind}, grp int")


def fused(placed: DataFrame, key: str) -> DataFrame:
    """key, grp, page (of the anchor), layers (sorted), confidence, score, box (around all that have one) of the groups in which two layers or more agree."""
    layers = F.array_sort(F.collect_set("layer"))
    rows = placed.groupBy(key, "grp").agg(layers.alias("layers"), F.min_by("page", F.struct("layer_ord", "ord")).alias("page"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]).where(F.size("layers") >= 2)
    whole = F.array_contains("layers", "metadata")
    many = F.size("layers") >= 3
    confidence = F.when(whole, WITH_METADATA[0]).when(many, AGREED[3][0]).otherwise(AGREED[2][0])
    score = F.when(whole, WITH_METADATA[1]).when(many, AGREED[3][1]).otherwise(AGREED[2][1])
    return rows.select(key, "grp", "page", "layers", confidence.alias("confidence"), score.alias("score"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), FALLBACK)])


def fusion_stats(placed: DataFrame, key: str) -> DataFrame:
    """key, total, groups, agreed, single of the findings of each document."""
    per = placed.groupBy(key, "grp").agg(F.countDistinct("layer").alias("n"), F.count("*").alias("held"))
    return per.groupBy(key).agg(F.sum("held").alias("total"), F.count("*").alias("groups"), F.count_if(F.col("n") >= 2).alias("agreed"), F.count_if(F.col("n") < 2).alias("single"))


def contradictions(findings: DataFrame, furniture: DataFrame, key: str) -> DataFrame:
    """key, layer, ord, page, rule, n_pages or furniture_line, points of the findings with a text and a box that are page furniture: the same text stands at the same place (cells of CELL points)
    on REPEAT_PAGES pages or more, or the finding shares a row with a structural line (furniture: page, line, box), the first one by line."""
    rows = findings.where("x0 is not null and layer <> 'metadata'").where(F.coalesce(F.trim("text"), F.lit("")) != "")
    rows = rows.withColumn("__cx", F.bround(F.col("x0") / CELL)).withColumn("__cy", F.bround(F.col("y0") / CELL)).withColumn("__t", F.substring("text", 1, TEXT_KEY))
    cell = [key, "layer", "__cx", "__cy", "__t"]
    pages = rows.groupBy(*cell).agg(F.countDistinct("page").alias("n_pages"))
    rows = rows.join(pages, cell)
    often = rows.where(F.col("n_pages") >= REPEAT_PAGES)
    rest = rows.where(F.col("n_pages") < REPEAT_PAGES).select(key, "layer", "ord", "page", *["x0", "y0", "x1", "y1"])
    # rows of a page meet by bands of their height
    band = lambda df: df.withColumn("__band", F.explode(F.sequence(F.floor(F.col("y0") / 50), F.floor(F.col("y1") / 50))))
    on = [key, "page", "__band"]
    met = named(band(rest), "a_", on).join(named(band(furniture.select(key, "page", "line", "x0", "y0", "x1", "y1")), "b_", on), on)
    met = met.where(same_row(*[tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")) for p in ("a_", "b_")], ROW_SHARE))
    beside = met.groupBy(key, F.col("a_layer").alias("layer"), F.col("a_ord").alias("ord"), "page").agg(F.min("b_line").alias("furniture_line"))
    rule = F.when(F.col("layer") == "numeric", "numeric_vs_structural_context").otherwise("cross_page_repetition")
    one = often.select(key, "layer", "ord", "page", "n_pages", F.lit(None).cast("long").alias("furniture_line"))
    two = beside.select(key, "layer", "ord", "page", F.lit(None).cast("long").alias("n_pages"), F.col("furniture_line").cast("long"))
    return one.unionByName(two).withColumn("rule", rule).withColumn("points", F.lit(POINTS))


def layer_points(found: DataFrame, key: str) -> DataFrame:
    """key, layer, points taken by contradictions."""
    return found.groupBy(key, "layer").agg(F.sum("points").alias("points"))


def contradicted(verdicts: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """verdicts (with a column a layer, pdf_type, threshold, combined, verdict, confidence) after layer_points() are taken off, each layer down to 0."""
    layers = [x for x in ("content", "numeric", "ela", "pymupdf") if x in verdicts.columns]
    wide = points.groupBy(key).agg(*[F.sum(F.when(F.col("layer") == x, F.col("points"))).alias(f"__{x}") for x in layers])
    rows = verdicts.join(wide, key, "left")
    after = {x: F.greatest(F.lit(0), F.col(x) - F.coalesce(f"__{x}", F.lit(0))) for x in layers}
    lost = sum(((F.col(x) - after[x]) * weight(F.col("pdf_type"), x) for x in layers), F.lit(0.0))
    rows = rows.withColumn("__lost", lost).withColumns(after)
    return rescored(rows, F.greatest(F.lit(0.0), F.col("combined") - F.col("__lost")), F.col("__lost") > 0).drop("__lost", *[f"__{x}" for x in layers])


def signals(parts: list[tuple[str, str]]):
    """One array out of arrays of messages, each with its layer's tag ahead: (column, tag) in order; a null array is empty."""
    return F.concat(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s, t=tag: F.concat(F.lit(f"[{t}] "), s)) for c, tag in parts])


def first_span_with(targets: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """targets (page, ord, text) with the y of the first span on their page that holds the text, whatever the case; null if none does."""
    rows = targets.select(key, "page", "ord", F.lower(F.trim("text")).alias("__t"))
    met = rows.join(spans.select(key, "page", F.col("ord").alias("__o"), F.lower("text").alias("__s"), "y0"), [key, "page"]).where(F.contains("__s", F.col("__t")) & (F.col("__t") != ""))
    first = met.groupBy(key, "page", "ord").agg(F.min_by("y0", "__o").alias("y0"))
    return targets.join(first, [key, "page", "ord"], "left")


def layers_per_page(findings: DataFrame, key: str, strong: int = 3) -> DataFrame:
    """key, page, n_layers, strong (that many layers or more) of the pages with findings."""
    return findings.where("layer <> 'metadata'").groupBy(key, "page").agg(F.countDistinct("layer").alias("n_layers")).withColumn("strong", F.col("n_layers") >= strong)
