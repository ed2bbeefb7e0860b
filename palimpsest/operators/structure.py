"""Facts of a file's structure: revisions, replaced objects, forms, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Points each and the most.
REVISIONS, GENERATIONS, NOTES, FORMS = (15, 40), (10, 35), (15, 40), (10, 30)
UPDATES, XREF_POINTS, OLD_POINTS = (20, 50), 25, 20
SIGNED_REVISIONS, GAP, AFTER, SIGNATURE_GAP, SIGNATURE_LATER, MOST = 50, 60, 40, 70, 50, 100
TEMPLATE_SHARE, HEADER, FOOTER, FORM_AREA = 0.5, 0.15, 0.15, 0.05
#: Layer score of the raster checks: confirmed blocks, noise, erasure, flat patches; what is left of scans'; and divisors of other checks.
BLOCKS, NOISE, ERASURE, FLAT = (15, 70), (8, 40), (15, 45), (15, 45)
SCANNED, COMPILED, FEW_REGIONS, FEW_WEIGHT = 0.6, 0.35, 5, 0.5
DIVISORS = {"cross_page": 2, "objects": 3, "incremental": 2, "dct": 4, "shadow": 2, "signature": 2}
CROSS_PAGES, CROSS_Z = 3, 2.5


def capped(count: Column, points: tuple[int, int]) -> Column:
    return F.least(F.lit(points[1]), F.greatest(count, F.lit(0)) * points[0])


def placements(forms: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """key, objid, frequency (share of the pages that use it), and box, page_height, page_area of its first use; forms: objid, page, box; pages: page, width, height."""
    total = pages.groupBy(key).agg(F.count("*").alias("__total"))
    sized = forms.join(pages.select(key, "page", F.col("height").alias("page_height"), (F.col("width") * F.col("height")).alias("page_area")), [key, "page"])
    first = F.min(F.struct("page", "x0", "y0", "x1", "y1", "page_height", "page_area")).alias("f")
    return sized.groupBy(key, "objid").agg(F.countDistinct("page").alias("__n"), first).join(total, key).select(key, "objid", (F.col("__n") / F.col("__total")).alias("frequency"), "f.*").drop("page")


def injected(objects: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """objects (objid, has_text: forms) with injected: not on TEMPLATE_SHARE of the pages, not in a header or footer, not small, with text; a form without a placement is taken for one."""
    rows = objects.join(placed, [key, "objid"], "left")
    edge = F.coalesce((F.col("page_height") > 0) & ((F.col("y0") / F.col("page_height") <= HEADER) | ((F.col("page_height") - F.col("y1")) / F.col("page_height") <= FOOTER)), F.lit(False))
    area = F.when(F.col("page_area") > 0, (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.col("page_area")).otherwise(0.0)
    fits = (F.col("frequency") < TEMPLATE_SHARE) & ~edge & (area >= FORM_AREA) & F.coalesce("has_text", F.lit(False))
    return rows.withColumn("injected", F.when(F.col("frequency").isNull(), True).otherwise(fits)).select(*objects.columns, "injected")


def fingerprint_score(eof: Column, high_generation: Column, notes: Column, forms: Column) -> Column:
    """Objects that were edited: revisions, generations above 0, free texts and redactions, injected forms."""
    return F.least(F.lit(MOST), capped(eof - 1, REVISIONS) + capped(high_generation, GENERATIONS) + capped(notes, NOTES) + capped(forms, FORMS))


def incremental_score(eof: Column, xrefs: Column, startxrefs: Column, old_objects: Column) -> Column:
    chained = F.when((xrefs > 1) & (xrefs != startxrefs), XREF_POINTS).otherwise(0)
    return F.least(F.lit(MOST), capped(eof - 1, UPDATES) + chained + F.when(old_objects > 0, OLD_POINTS).otherwise(0))


def signature_scores(signatures: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, n_signatures, shadow, signature of signed files. signatures: start1, length1, start2, length2 (the signed ranges, null if there are none), signed_at; files: size, eof, modified_at.

    A signature covers the file if its second range ends at the file's end and the two ranges with the gap for the signature itself are all of it."""
    rows = signatures.join(files, key)
    end = F.col("start2") + F.col("length2")
    known = end.isNotNull() & F.col("length1").isNotNull()
    whole = F.coalesce(known & (F.col("start1") == 0) & (end == F.col("size")), F.lit(False))
    shadow = F.when(known & ~whole, GAP).otherwise(0) + F.when(known & (F.col("size") > end), AFTER).otherwise(0)
    one = F.when(~whole, SIGNATURE_GAP).when(F.col("modified_at") > F.col("signed_at"), SIGNATURE_LATER).otherwise(0)
    out = rows.groupBy(key).agg(F.count("*").alias("n_signatures"), F.sum(shadow).alias("__s"), F.max("eof").alias("__eof"), F.max(one).alias("signature"))
    return out.select(key, "n_signatures", F.least(F.lit(MOST), F.col("__s") + F.when(F.col("__eof") > 1, SIGNED_REVISIONS).otherwise(0)).alias("shadow"), "signature")


def raster_score(rows: DataFrame) -> DataFrame:
    """rows: weight_sum, n_regions (confirmed blocks), n_noise, n_erasure, flat_confidence, scanned, is_compiled and a column for each of DIVISORS. Adds ela (0 to 100)."""
    blocks = F.least(F.lit(float(BLOCKS[1])), F.col("weight_sum") * BLOCKS[0])
    kept = F.when(F.col("scanned"), F.when(F.col("is_compiled"), COMPILED).otherwise(SCANNED) * F.when(F.col("n_regions") < FEW_REGIONS, FEW_WEIGHT).otherwise(1.0)).otherwise(1.0)
    score = F.least(F.lit(100.0), blocks * kept + capped(F.col("n_noise"), NOISE) + capped(F.col("n_erasure"), ERASURE) + F.least(F.lit(float(FLAT[1])), F.col("flat_confidence") * FLAT[0]))
    for name, divisor in DIVISORS.items():
        score = F.least(F.lit(100.0), score + F.floor(F.coalesce(name, F.lit(0)) / divisor))
    return rows.withColumn("ela", score)


def check_scores(findings: DataFrame, limits: dict[str, tuple[float, float]], key: str) -> DataFrame:
    """key, score: for each check of findings (check, confidence) its points per hit weighted by confidence, up to its most, added up to 100."""
    points = lambda i: F.coalesce(*[F.when(F.col("check") == name, F.lit(float(pair[i]))) for name, pair in limits.items()], F.lit(0.0))
    per = findings.groupBy(key, "check").agg(F.least(points(1), F.sum(points(0) * F.col("confidence"))).alias("s"))
    return per.groupBy(key).agg(F.least(F.lit(100.0), F.sum("s")).alias("score"))


def image_fold(ela: Column, image_scores: Column, weight: float = 0.6, most: float = 80.0) -> Column:
    """The layer's score with what the checks of single images add."""
    return F.least(F.lit(100.0), ela + F.least(F.lit(most), image_scores * weight))


def cross_page_noise(pages: DataFrame, key: str) -> DataFrame:
    """key, page, noise, z of the pages whose noise is far from the document's mean; documents of CROSS_PAGES pages or more."""
    from pyspark.sql import Window

    group = Window.partitionBy(key)
    rows = pages.withColumn("__n", F.count("*").over(group)).withColumn("__m", F.avg("noise").over(group)).withColumn("__s", F.stddev_samp("noise").over(group))
    return rows.where((F.col("__n") >= CROSS_PAGES) & (F.col("__s") > 0)).withColumn("z", F.abs(F.col("noise") - F.col("__m")) / F.col("__s")).where(F.col("z") >= CROSS_Z).select(key, "page", "noise", "z")


def block_outliers(blocks: DataFrame, on: list[str], value: str, least: int, z_least: float, std_least: float, above: bool = False) -> DataFrame:
    """blocks with z (population statistics of their page) of z_least or more, of pages with so many blocks and that spread; above: only values over the mean."""
    from pyspark.sql import Window

    page = Window.partitionBy(*on)
    rows = blocks.withColumn("__n", F.count("*").over(page)).withColumn("__m", F.avg(value).over(page)).withColumn("__s", F.stddev_pop(value).over(page))
    far = F.col(value) - F.col("__m") if above else F.abs(F.col(value) - F.col("__m"))
    return rows.where((F.col("__n") >= least) & (F.col("__s") >= std_least) & (F.col("__s") > 0)).withColumn("z", far / F.col("__s")).where(F.col("z") >= z_least).drop("__n", "__m", "__s")


def erased_blocks(blocks: DataFrame, on: list[str], bright: float, ratio: float = 0.2, median_least: float = 3.0, least: int = 10) -> DataFrame:
    """Bright blocks (mean, std) that are far smoother than their page: of less than ratio times the median spread of the page's bright blocks."""
    light = blocks.where(F.col("mean") >= bright)
    usual = light.groupBy(*on).agg(F.percentile("std", F.lit(0.5)).alias("__median"), F.count("*").alias("__n")).where((F.col("__n") >= least) & (F.col("__median") >= median_least))
    return light.join(usual, on).where(F.col("std") < ratio * F.col("__median")).drop("__median", "__n")


def agreed_blocks(blocks: DataFrame, on: list[str], z_least: float = 3.0, qualities: int = 2) -> DataFrame:
    """on, br, bc, z, err (means over the qualities that flag it) of the blocks that so many qualities flag; blocks: quality, br, bc, z, err."""
    return blocks.where(F.col("z") > z_least).groupBy(*on, "br", "bc").agg(F.countDistinct("quality").alias("n"), F.avg("z").alias("z"), F.avg("err").alias("err")).where(F.col("n") >= qualities)


def confirmed(rows: DataFrame, others: DataFrame, on: list[str], padding: float = 3.0, order: str = "ord", size: float = 64) -> DataFrame:
    """The regions of one scale whose box, with some padding, meets a region of another scale."""
    from ..functions.geometry import box, intersects
    from .spatial import grid_join

    wide = rows.select(*on, order, *[(F.col(c) - padding).alias(c) for c in ("x0", "y0")], *[(F.col(c) + padding).alias(c) for c in ("x1", "y1")])
    met = grid_join(wide, others, on, size, intersects(box("a_"), box("b_"))).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return rows.join(met, [*on, order], "left_semi")


def raster_regions(rows: DataFrame, images: DataFrame, pages: DataFrame, on: list[str], order: str = "ord") -> DataFrame:
    """The regions on raster content: all of pages without text (pages: has_text), of others those that meet an image's box."""
    plain = rows.join(pages.where("not has_text").select(*on), on, "left_semi")
    rest = rows.join(pages.where("has_text").select(*on), on, "left_semi")
    return plain.unionByName(confirmed(rest, images, on, 3.0, order))


def block_clusters(blocks: DataFrame, on: list[str], gap: float = 4.0, least: int = 3, order: str = "ord", size: float = 64) -> DataFrame:
    """on, component, n_blocks, box of the groups of so many blocks or more whose boxes lie within the gap of each other, step by step."""
    from ..functions.geometry import box
    from .cluster import components
    from .spatial import grid_join

    wide = blocks.select(*on, order, *[(F.col(c) - gap / 2).alias(c) for c in ("x0", "y0")], *[(F.col(c) + gap / 2).alias(c) for c in ("x1", "y1")])
    a, b = box("a_"), box("b_")
    near = (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])
    edges = grid_join(wide, wide, on, size, (F.col(f"a_{order}") < F.col(f"b_{order}")) & near).select(*on, F.col(f"a_{order}").alias("a"), F.col(f"b_{order}").alias("b"))
    found = components(edges, on).join(blocks.select(*on, F.col(order).alias("v"), "x0", "y0", "x1", "y1"), [*on, "v"])
    return found.groupBy(*on, "component").agg(F.count("*").alias("n_blocks"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]).where(F.col("n_blocks") >= least)


def associated(rows: DataFrame, others: DataFrame, on: list[str], name: str, order: str = "ord", size: float = 64) -> DataFrame:
    """rows with a flag: whether their box meets one of the others'."""
    from ..functions.geometry import box, intersects
    from .spatial import grid_join

    met = grid_join(rows, others, on, size, intersects(box("a_"), box("b_"))).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return rows.join(met.withColumn(name, F.lit(True)), [*on, order], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def stamped(patches: DataFrame, stamps: DataFrame, on: list[str], least: float = 0.5, order: str = "ord", size: float = 64) -> DataFrame:
    """patches with stamp_associated: whether they cover so much of a stamp."""
    from ..functions.geometry import box, overlap
    from .spatial import grid_join

    w, h = overlap(box("a_"), box("b_"))
    area = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0"))
    met = grid_join(patches, stamps, on, size, (w > 0) & (h > 0) & (area > 0) & (w * h >= least * area)).select(*on, F.col(f"a_{order}").alias(order)).distinct()
    return patches.join(met.withColumn("stamp_associated", F.lit(True)), [*on, order], "left").withColumn("stamp_associated", F.coalesce("stamp_associated", F.lit(False)))
