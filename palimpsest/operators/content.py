"""Lines of text against the statistics of their page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fonts import base_family, colour_distance
from ..functions.lines import CRITICAL, LETTERHEAD, NEVER_FLAG, holds_any, is_form_field, is_gap_field, is_structural, words_of

#: Fixed values.
Z_LEAST, PAGE_LINES, DESIGN_SHARE, TRIM = 2.5, 8, 0.15, 0.10
#: Points of an outlying feature: the most, and per standard deviation.
FEATURES = {"font_size": (0.25, 0.05), "char_spacing": (0.20, 0.04), "word_spacing": (0.20, 0.04), "line_height": (0.15, 0.03), "noise": (0.25, 0.05), "sharpness": (0.20, 0.04)}
TRIMMED = ("font_size", "char_spacing", "word_spacing")
REPLACEMENT, REPLACEMENT_POINTS, GLYPH_SHARE, GLYPHS = "■□▪▫●○�", 0.60, 0.02, ("�", "?", " ")
CID_POINTS, CRITICAL_POINTS, LETTERHEAD_POINTS, FONT_POINTS = 0.90, 0.70, 0.15, 0.40
CV_LEAST, CV_LENGTH, CV_POINTS = 0.05, 8, 0.25
COLOUR_LEAST, COLOUR_SHARE = 15, 0.03
GAP_LINES, GAP_LARGE, GAP_Z, GAP_WORDS, GAP_REPEAT, GAP_STD, GAP_Z_MOST = 5, 3.0, 3.5, 3, 3, 0.5, 100.0
TINY = 1e-9


def word_features(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, char_spacing (mean width of a character, by words of two or more), char_cv (spread of that over its mean, null for fewer than two words), word_spacing (mean of the gaps between 0 and 50) out of words: text, x0, x1."""
    wide = F.when(F.length("text") > 1, (F.col("x1") - F.col("x0")) / F.length("text"))
    gap = F.lead("x0").over(Window.partitionBy(*keys).orderBy("x0", "x1")) - F.col("x1")
    rows = words.withColumn("__w", wide).withColumn("__g", gap)
    cv = F.when((F.count("__w") >= 2) & (F.avg("__w") > 0), F.stddev_samp("__w") / F.avg("__w"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg("__w"), F.lit(0.0)).alias("char_spacing"), cv.alias("char_cv"), F.coalesce(F.avg(F.when((F.col("__g") > 0) & (F.col("__g") < 50), F.col("__g"))), F.lit(0.0)).alias("word_spacing"))


def ordered_stats(values: Column) -> Column:
    """mean and std (null of fewer than two) of an array's numbers, taken one after the other: as numbers of equal sets come in another order their sums differ in the last digits, so the array should be sorted."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "sum", "mean", "squares")])

    def step(held, x):
        n = held["n"] + 1.0
        mean = held["mean"] + (x - held["mean"]) / n
        return F.struct(n.alias("n"), (held["sum"] + x).alias("sum"), mean.alias("mean"), (held["squares"] + (x - mean) * (x - held["mean"])).alias("squares"))

    return F.aggregate(values, start, step, lambda held: F.struct(F.when(held["n"] > 0, held["sum"] / held["n"]).alias("mean"), F.when(held["n"] > 1, F.sqrt(held["squares"] / (held["n"] - 1))).alias("std")))


def positive_stats(rows: DataFrame, keys: list[str], value: str = "value", trimmed: str = "trimmed") -> DataFrame:
    """keys, n, mean, std, median of the values above 0, the same to the last digit however rows are dealt out. Where trimmed holds and there are four or more, a tenth at either end, one at least, is left out, unless fewer than two would stay. One value has no spread, no value is 0."""
    v = F.col(value)
    group = Window.partitionBy(*keys)
    held = rows.where(v > 0).withColumn("__n", F.count("*").over(group)).withColumn("__r", F.row_number().over(group.orderBy(v)))
    k = F.greatest(F.lit(1), F.floor(F.col("__n") * TRIM))
    cut = F.col(trimmed) & (F.col("__n") >= 4) & (F.col("__n") - 2 * k >= 2)
    kept = held.where(~cut | ((F.col("__r") > k) & (F.col("__r") <= F.col("__n") - k)))
    held = kept.groupBy(*keys).agg(F.max("__n").alias("n"), F.sort_array(F.collect_list(v.cast("double"))).alias("__values"), F.percentile(v, F.lit(0.5)).alias("median"))
    held = held.withColumn("__stats", ordered_stats(F.col("__values")))
    return held.select(*keys, "n", F.col("__stats.mean").alias("mean"), F.greatest(F.coalesce(F.col("__stats.std"), F.lit(TINY)), F.lit(TINY)).alias("std"), "median")


def dominant(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, dominant (the most frequent value; of equally frequent ones the first in order), share, n_values, n, design (values of more than DESIGN_SHARE of the rows, sorted)."""
    counts = rows.groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("c"), F.min(F.struct(*order)).alias("first"))
    held = F.collect_list(F.struct("__v", "c", "first")).alias("held")
    best = lambda a, b: F.when(a["c"] != b["c"], b["c"] - a["c"]).when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).otherwise(0).cast("int")
    out = counts.groupBy(*keys).agg(held, F.sum("c").alias("n")).withColumn("held", F.array_sort("held", best))  # a row for each distinct value
    top = F.element_at("held", 1)
    design = F.array_sort(F.transform(F.filter("held", lambda x: x["c"] / F.col("n") > DESIGN_SHARE), lambda x: x["__v"]))
    return out.select(*keys, top["__v"].alias("dominant"), (top["c"] / F.col("n")).alias("share"), F.size("held").alias("n_values"), "n", design.alias("design"))


def profile(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, dominant, share, n_values, n, design (of fonts), stats (feature to mean and std) of lines: font and the columns of FEATURES that there are."""
    names = [f for f in FEATURES if f in lines.columns]
    long = lines.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(f in TRIMMED).alias("trimmed")) for f in names])).alias("x")).select(*keys, "x.*")
    stats = positive_stats(long, [*keys, "feature"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("stats"))
    return dominant(lines, keys, "font", order).join(stats, keys, "left")


def glyph_shares(spans: DataFrame, key: str) -> DataFrame:
    """key, font, total, and the share of each of GLYPHS (replaced, question, blank) in the characters of the fonts that are embedded as subsets (a + in the name)."""
    count = lambda c: F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit(""))))
    rows = spans.where(F.contains("font", F.lit("+")) & (F.length("text") > 0)).groupBy(key, "font").agg(F.sum(F.length("text")).alias("total"), *[count(c).alias(n) for n, c in zip(("replaced", "question", "blank"), GLYPHS)])
    return rows.select(key, "font", "total", *[(F.col(n) / F.col("total")).alias(n) for n in ("replaced", "question", "blank")])


def suspicious_lines(lines: DataFrame, key: str, glyphs: DataFrame | None = None) -> DataFrame:
    """key, page, line, score (0 to 1), reasons of the lines that stand out.

    lines: key, page, line, text, font, char_cv and the columns of FEATURES that there are. A line is held against its page's profile, or its document's, if the page has fewer than PAGE_LINES lines.
    """
    order = ["page", "line"]
    names = [f for f in FEATURES if f in lines.columns]
    whole, paged = profile(lines, [key], order), profile(lines, [key, "page"], order).where(F.col("n") >= PAGE_LINES)
    pick = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"w.{c}")).alias(f"__{c}")
    rows = lines.alias("l").join(paged.alias("p"), [key, "page"], "left").join(whole.alias("w"), key).select("l.*", *[pick(c) for c in ("dominant", "design", "stats")])
    rows = rows.withColumn("__trim", F.trim("text")).withColumn("__again", F.count("*").over(Window.partitionBy(key, "__trim")) > 1)
    rows = rows.withColumn("structural", is_structural(F.col("text"), F.col("page"), F.col("line"), F.col("line_height"), F.col("__again"))).withColumn("form", is_form_field(F.col("text")))
    if glyphs is not None:
        rows = rows.join(glyphs.select(key, "font", F.col("replaced").alias("__share")), [key, "font"], "left")
    consistent = F.coalesce(F.col("__share") > GLYPH_SHARE, F.lit(False)) if glyphs is not None else F.lit(False)
    low = F.lower("text")
    only_known = F.contains("text", F.lit(REPLACEMENT[-1])) & consistent
    other_marks = F.col("text").rlike(f"[{REPLACEMENT[:-1]}]")
    marked = other_marks | (F.contains("text", F.lit(REPLACEMENT[-1])) & ~consistent)
    cid = lambda c: F.contains(F.lower(c), F.lit("cidfont"))
    mismatch = (F.col("font") != F.col("__dominant")) & ~F.col("structural") & (base_family(F.col("font")) != base_family(F.col("__dominant"))) & (cid("font") | ~F.array_contains("__design", F.col("font")))
    second_session = cid("font") & cid("__dominant") & ~(only_known & ~other_marks)
    points = F.when(second_session, CID_POINTS).when(holds_any(low, CRITICAL), CRITICAL_POINTS).when((F.col("line") < LETTERHEAD) & (F.col("page") == 0), LETTERHEAD_POINTS).otherwise(FONT_POINTS)
    checks: list[tuple[str, Column, Column]] = [("replacement", marked, F.lit(REPLACEMENT_POINTS)), ("font", mismatch, points)]
    for name in names:
        stat = F.col("__stats")[name]
        z = F.abs(F.col(name) - F.coalesce(stat["mean"], F.lit(0.0))) / F.coalesce(stat["std"], F.lit(TINY))
        there = F.lit(True) if name in ("font_size", "line_height") else F.col(name) > 0
        loose = ~F.col("form") if name in ("char_spacing", "word_spacing", "line_height") else F.lit(True)
        most, each = FEATURES[name]
        checks.append((name, (z > Z_LEAST) & ~F.col("structural") & there & loose, F.least(F.lit(most), z * each)))
    if "char_cv" in lines.columns:
        checks.append(("uniform", ~F.col("structural") & (F.length("text") > CV_LENGTH) & (F.col("char_cv") < CV_LEAST), F.lit(CV_POINTS)))
    held = lambda when: F.coalesce(when, F.lit(False))
    score = sum((F.when(held(when), p).otherwise(0.0) for _, when, p in checks), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(held(when), F.lit(name)) for name, when, _ in checks]))
    out = rows.where(~holds_any(low, NEVER_FLAG)).withColumn("reasons", reasons).withColumn("score", F.least(F.lit(1.0), score))
    return out.where(F.size("reasons") > 0).select(key, "page", "line", "score", "reasons")


def structural_lines(lines: DataFrame, key: str) -> DataFrame:
    """lines with repeated, structural, form_field and gap_field."""
    rows = lines.withColumn("__trim", F.trim("text"))
    rows = rows.withColumn("repeated", F.count("*").over(Window.partitionBy(key, "__trim")) > 1)
    return rows.withColumn("structural", is_structural(F.col("text"), F.col("page"), F.col("line"), F.col("line_height"), F.col("repeated"))).withColumn("form_field", is_form_field(F.col("text"))).withColumn("gap_field", is_gap_field(F.col("text"))).drop("__trim")


def line_gaps(lines: DataFrame, key: str) -> DataFrame:
    """key, page, line, gap, expected, z of the lines below an unusually large gap; lines: text, y0, y1.

    The page's usual gap is the trimmed mean of its positive gaps up to GAP_LARGE times their median. Pages of few lines, of even spacing or of GAP_REPEAT or more such lines have none.
    """
    page = [key, "page"]
    on_page = Window.partitionBy(*page)
    above = F.lag("y1").over(on_page.orderBy("y0", "line"))
    rows = lines.withColumn("gap", F.col("y0") - above).withColumn("__lines", F.count("*").over(on_page)).where((F.col("__lines") >= GAP_LINES) & (F.col("gap") > 0))
    middle = rows.groupBy(*page).agg(F.percentile("gap", F.lit(0.5)).alias("__median"), F.count("*").alias("__gaps")).where(F.col("__gaps") >= GAP_LINES)
    rows = rows.join(middle, page)
    body = rows.where(F.col("gap") <= GAP_LARGE * F.col("__median")).select(*page, F.col("gap").alias("value"), F.lit(True).alias("trimmed"))
    usual = positive_stats(body, page).where((F.col("n") >= GAP_LINES) & (F.col("std") >= GAP_STD)).select(*page, F.col("mean").alias("expected"), "std")
    same = F.count("*").over(Window.partitionBy(*page, F.bround("gap", 1)))
    rows = rows.withColumn("__same", same).join(usual, page)
    z = F.least(F.abs(F.col("gap") - F.col("expected")) / F.col("std"), F.lit(GAP_Z_MOST))
    found = rows.withColumn("z", z).where((F.col("z") > GAP_Z) & (F.col("gap") > F.col("expected")) & (F.col("__same") < GAP_REPEAT) & (F.size(words_of(F.col("text"))) >= GAP_WORDS) & ~is_gap_field(F.col("text")))
    return found.withColumn("__found", F.count("*").over(on_page)).where(F.col("__found") < GAP_REPEAT).select(*page, "line", F.bround("gap", 1).alias("gap"), F.bround("expected", 1).alias("expected"), F.bround("z", 2).alias("z"))


def colour_mismatches(spans: DataFrame, key: str) -> DataFrame:
    """spans (page, line, ord, text, colour) whose colour differs from their line's most frequent one, is rare in the document, and does not recur with that text on another page; with line_colour and difference."""
    rows = spans.withColumn("text", F.trim("text")).where(F.col("text") != "")
    used = rows.groupBy(key, "colour").agg(F.count("*").alias("n"))
    common = used.withColumn("__all", F.sum("n").over(Window.partitionBy(key))).where(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("__all") * COLOUR_SHARE, 0))).select(key, "colour")
    lines = dominant(rows, [key, "page", "line"], "colour", ["ord"]).where((F.col("n_values") > 1) & (F.col("n") >= 2)).select(key, "page", "line", F.col("dominant").alias("line_colour"))
    odd = rows.join(lines, [key, "page", "line"]).withColumn("difference", colour_distance(F.col("colour"), F.col("line_colour"))).where((F.col("colour") != F.col("line_colour")) & (F.col("difference") >= COLOUR_LEAST)).join(common, [key, "colour"], "left_anti")
    pages = odd.groupBy(key, "text", "colour", "line_colour").agg(F.countDistinct("page").alias("__pages"))
    return odd.join(pages.where("__pages < 2").drop("__pages"), [key, "text", "colour", "line_colour"]).select(key, "page", "line", "ord", "text", "colour", "line_colour", "difference")


def reported_lines(found: DataFrame, key: str, most: int = 15, reasons: int = 3) -> DataFrame:
    """The lines of the highest scores of each document, the first reasons of each, with rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "page", "line"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("reasons", F.slice("reasons", 1, reasons))
