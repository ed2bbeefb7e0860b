"""Scores of one layer out of its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Points a finding and the most that findings of a kind give.
OVERLAY_POINTS = {
    "covering_rect": (25, 70),
    "image_overlay": (20, 60),
    "char_spacing": (5, 40),
    "ghost_text": (35, 70),
    "coordinate_overwrite": (25, 50),
}
STACKING_POINTS = (40, 80)
MIXED_EMBEDDING, DIVERSITY, STRONG, MODERATE, COLOUR, GAP = 25, 15, (12, 50), (5, 20), (10, 40), (20, 60)
GAP_WEIGHT, DOMINANT_SHARE, MANY_FONTS = 0.5, 0.60, 3
HIGHEST = 100


def capped(count: Column, points: tuple[int, int]) -> Column:
    return F.least(F.lit(points[1]), count * points[0])


def overlay_score(findings: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys, n_findings, score: overlays up to 100 together, then stacked texts, up to 100 again. Other kinds and null count nothing."""
    of = lambda name, points: capped(F.count_if(F.col(kind) == name), points)
    overlays = F.least(F.lit(HIGHEST), sum((of(name, points) for name, points in OVERLAY_POINTS.items()), F.lit(0)))
    known = F.count_if(F.col(kind).isin(*OVERLAY_POINTS, "text_stacking"))
    return findings.groupBy(*keys).agg(known.alias("n_findings"), F.least(F.lit(HIGHEST), overlays + of("text_stacking", STACKING_POINTS)).alias("score"))


def content_score(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines: font, anomaly, off_colour, gap_before, mixed. Gives keys, n_fonts, n_strong, n_moderate, score.

    Fonts are counted before documents, so that a long document is many small groups first; a line
    of null font is no font but counts as a line.
    """
    anomaly = F.col("anomaly")
    by_font = lines.groupBy(*keys, "font").agg(F.count("*").alias("n"), F.count_if(anomaly > 0.5).alias("strong"), F.count_if((anomaly > 0.3) & (anomaly <= 0.5)).alias("moderate"), F.count_if("off_colour").alias("colour"), F.count_if("gap_before").alias("gap"), F.coalesce(F.bool_or("mixed"), F.lit(False)).alias("mixed"))
    rows = by_font.groupBy(*keys).agg(F.count("font").alias("n_fonts"), F.max(F.when(F.col("font").isNotNull(), F.col("n"))).alias("__most"), F.sum("n").alias("__n"), F.sum("strong").alias("n_strong"), F.sum("moderate").alias("n_moderate"), F.sum("colour").alias("__colour"), F.sum("gap").alias("__gap"), F.bool_or("mixed").alias("__mixed"))
    diverse = (F.col("n_fonts") > MANY_FONTS) & (F.col("__most") / F.col("__n") < DOMINANT_SHARE)
    score = F.when(F.col("__mixed"), MIXED_EMBEDDING).otherwise(0) + F.when(diverse, DIVERSITY).otherwise(0)
    score = score + capped(F.col("n_strong"), STRONG) + capped(F.col("n_moderate"), MODERATE) + capped(F.col("__colour"), COLOUR) + capped(F.col("__gap"), GAP) * GAP_WEIGHT
    return rows.select(*keys, "n_fonts", "n_strong", "n_moderate", F.least(F.lit(float(HIGHEST)), score).alias("score"))
