"""Text under other text: below white boxes, below other spans, in earlier revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import box, overlap
from ..functions.numeric import field_type
from .spatial import grid_join, named

#: Fixed values.
WHITE, COVER_WIDTH, COVER_HEIGHT, LEAST_TEXT = 0.85, 10, 5, 2
SIDE, NEAR, BUCKET, SHOWN_COVERS, SHOWN_ADDED = 5, 5, 2.0, 3, 100
#: The methods in the order in which they win a place.
METHODS = ("white_rectangle_cover", "text_overlap", "incremental_update")
FOUND = ["page", "method", "ord", "original", "covering", "x0", "y0", "x1", "y1"]


def is_white(fill: Column, least: float = WHITE) -> Column:
    """Whether a fill (array of channels) is white or nearly so; null or fewer than three channels are not."""
    return F.coalesce((F.size(fill) >= 3) & F.forall(F.slice(fill, 1, 3), lambda c: c >= least), F.lit(False))


def covered_text(rects: DataFrame, spans: DataFrame, key: str, size: float = 64) -> DataFrame:
    """FOUND: white boxes with the texts of the spans that they touch: the darkest are the original, the others were typed over it.

    rects: page, ord, box, fill, stroke; spans: page, ord, text, box, colour.
    """
    on = [key, "page"]
    covers = rects.where((is_white(F.col("fill")) | is_white(F.col("stroke"))) & (F.col("x1") - F.col("x0") >= COVER_WIDTH) & (F.col("y1") - F.col("y0") >= COVER_HEIGHT))
    texts = spans.withColumn("text", F.trim("text")).where("text <> ''")
    w, h = overlap(box("a_"), box("b_"))
    met = grid_join(covers, texts, on, size, (w > 0) & (h > 0))
    held = met.groupBy(*on, F.col("a_ord").alias("ord"), *[F.col(f"a_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]).agg(F.min("b_colour").alias("base"), F.array_sort(F.collect_list(F.struct(F.col("b_ord").alias("o"), F.col("b_text").alias("t"), F.col("b_colour").alias("c")))).alias("held"))
    of = lambda base: F.transform(F.filter("held", lambda x: (x["c"] == F.col("base")) if base else (x["c"] != F.col("base"))), lambda x: x["t"])
    out = held.withColumn("original", F.array_join(of(True), " | ")).withColumn("covering", F.array_join(F.slice(of(False), 1, SHOWN_COVERS), " | "))
    return out.withColumn("method", F.lit(METHODS[0])).select(key, *FOUND)


def overlapping_text(spans: DataFrame, key: str, size: float = 64) -> DataFrame:
    """FOUND: pairs of different texts on one line (BUCKET points) that overlap by more than SIDE points or begin within NEAR; the darker one is the original, the first of equally dark ones. Of equal pairs of a page the first.

    Spans meet by line and by cells along it, so a crowded line is no join of all its spans.
    """
    on = [key, "page", "y_key"]
    texts = spans.withColumn("text", F.trim("text")).where(F.length("text") >= LEAST_TEXT).withColumn("y_key", F.bround((F.col("y0") + F.col("y1")) / 2 / BUCKET) * BUCKET)
    at = lambda c: F.floor(c / size)
    wide = texts.withColumn("cx", F.explode(F.sequence(at(F.col("x0") - NEAR / 2), at(F.col("x1") + NEAR / 2))))
    w, _ = overlap(box("a_"), box("b_"))
    near = (w > SIDE) | (F.abs(F.col("a_x0") - F.col("b_x0")) < NEAR)
    lowest = F.col("cx") == at(F.greatest("a_x0", "b_x0") - NEAR / 2)
    met = named(wide, "a_", [*on, "cx"]).join(named(wide, "b_", [*on, "cx"]), [*on, "cx"]).where(lowest & (F.col("a_ord") < F.col("b_ord")) & (F.col("a_text") != F.col("b_text")) & near)
    first = F.col("a_colour") <= F.col("b_colour")
    pick = lambda c, when: F.when(when, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    rows = met.select(key, "page", F.lit(METHODS[1]).alias("method"), F.col("a_ord").alias("ord"), F.col("b_ord").alias("__b"), pick("text", first).alias("original"), pick("text", ~first).alias("covering"), *[F.least(f"a_{c}", f"b_{c}").alias(c) for c in ("x0", "y0")], *[F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in ("x1", "y1")])
    rank = F.row_number().over(Window.partitionBy(key, "page", F.substring("original", 1, 30), F.substring("covering", 1, 30)).orderBy("ord", "__b"))
    return rows.withColumn("__r", rank).where("__r = 1").select(key, *FOUND)


def revision_changes(revisions: DataFrame, key: str) -> DataFrame:
    """FOUND: texts of LEAST_TEXT characters or more of the first revision that the page lacks in the last one, with the texts that came instead (in order, cut to SHOWN_ADDED); revisions: rev, page, ord, text, box.

    Texts are told apart by joins on the page; a page that one of the two revisions lacks has no changes.
    """
    ends = revisions.groupBy(key).agg(F.min("rev").alias("lo"), F.max("rev").alias("hi")).where("lo < hi")
    rows = revisions.join(ends, key)
    old, new = rows.where("rev = lo").drop("rev", "lo", "hi"), rows.where("rev = hi").drop("rev", "lo", "hi")
    on = [key, "page"]
    pages = new.select(*on).distinct()
    first = F.row_number().over(Window.partitionBy(*on, "text").orderBy("ord"))
    removed = old.join(pages, on, "left_semi").join(new.select(*on, "text").distinct(), [*on, "text"], "left_anti").where(F.length("text") >= LEAST_TEXT).withColumn("__r", first).where("__r = 1")
    added = new.join(old.select(*on, "text").distinct(), [*on, "text"], "left_anti").where(F.length("text") >= LEAST_TEXT).select(*on, "text").distinct()
    joined = added.groupBy(*on).agg(F.substring(F.array_join(F.array_sort(F.collect_list("text")), ", "), 1, SHOWN_ADDED).alias("covering"))
    out = removed.join(joined, on, "left").withColumn("covering", F.coalesce("covering", F.lit(""))).withColumn("method", F.lit(METHODS[2]))
    return out.withColumnRenamed("text", "original").select(key, *FOUND)


def hidden_texts(found: list[DataFrame], key: str) -> DataFrame:
    """The findings of all methods: of those of one page whose originals begin alike (20 characters) the first by method and order; with field_type, replacement_type and explanation."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    first = F.row_number().over(Window.partitionBy(key, "page", F.substring("original", 1, 20)).orderBy(place, "ord", "original", "covering"))
    out = rows.withColumn("__r", first).where("__r = 1").drop("__r")
    out = out.withColumn("field_type", field_type(F.col("original"))).withColumn("replacement_type", replacement_type(F.col("covering")))
    return out.withColumn("explanation", explanation(F.col("method"), F.col("replacement_type")))


def replacement_type(covering: Column) -> Column:
    """missing, where nothing visible was put in place, or replaced."""
    bare = F.regexp_replace(F.coalesce(covering, F.lit("")), r"\s+", "")
    return F.when((bare == "") | (F.lower(bare) == "unknown"), "missing").otherwise("replaced")


def description(original: Column, covering: Column) -> Column:
    old, new = F.substring(original, 1, 60), F.substring(covering, 1, 60)
    return F.when(replacement_type(covering) == "missing", F.format_string("'%s' was hidden, and nothing is shown in its place", old)).otherwise(F.format_string("'%s' was hidden, '%s' is shown in its place", old, new))


def explanation(method: Column, replaced: Column) -> Column:
    how = F.create_map(*[F.lit(x) for x in (METHODS[0], "A white box lies over the original text, which is still in the file.", METHODS[1], "Other text was set over the original; the file holds both.", METHODS[2], "The file keeps an earlier saved version that shows the original.")])
    return F.when(replaced == "missing", "The original was hidden or removed and nothing was put in its place; the file still holds it.").otherwise(F.coalesce(F.element_at(how, method), F.lit("Other content lies below what is shown.")))


def hidden_report(found: DataFrame, key: str) -> DataFrame:
    """key, n_found, pages and methods (both sorted), conclusion of each document with hidden text."""
    out = found.groupBy(key).agg(F.count("*").alias("n_found"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("method")).alias("methods"))
    return out.withColumn("conclusion", F.format_string("%d hidden text(s) on %d page(s), by %s", "n_found", F.size("pages"), F.array_join("methods", ", ")))
