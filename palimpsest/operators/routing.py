"""What kind of document it is, which checks its pages get, and what is said about the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lines import holds_any

#: Fixed values.
TEXT_CHARS, NATIVE, MIXED, FEW_WORDS, MANY_PATHS, BARE_CHARS = 30, 0.7, 0.3, 10, 10, 20
SCANNERS = ("scan", "canon", "epson", "hp", "fujitsu", "brother", "xerox", "ricoh", "sharp", "kodak", "ij scan", "scansnap", "twain", "wia")
MERGERS = ("pdf24", "ilovepdf", "smallpdf", "adobe acrobat", "foxit", "pdfcreator", "ghostscript", "microsoft print to pdf", "cups-pdf")
MERGED_PAGES, MERGED_MINUTES, MERGED_WEIGHT, COMPILED_PAGES = 3, 60, 0.4, 4
IMAGE_SIDE, IMAGE_SHARE = 100, 0.85
ROUTED = ("scanned", "mixed", "scanned_native")
STRONG_LAYERS, DRAWN_Z, DRAWN_SCORE = 3, 5.0, 0.40
ACTIVE = {"metadata": 30, "content": 20, "numeric": 20, "ela": 20, "pymupdf": 20, "xref": 20}
BLOCKED_BOTTOM, LIGHT_TOP, LIGHT_WEIGHT = 0.15, 0.12, 0.6


def scanner(producer: Column, creator: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return holds_any(low(producer), SCANNERS) | holds_any(low(creator), SCANNERS)


def document_types(pages: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """key, total_pages, pdf_type, image_based, compiled, converted of documents; pages: page, n_chars (without blanks around), n_words, n_paths, n_images; meta: producer, creator."""
    text = F.col("n_chars") > TEXT_CHARS
    bare = F.col("n_chars") < BARE_CHARS
    facts = pages.groupBy(key).agg(
        F.count("*").alias("total_pages"),
        F.avg(text.cast("double")).alias("__share"),
        F.sum("n_words").alias("__words"),
        F.bool_or((F.col("n_paths") > MANY_PATHS) & bare).alias("__drawn"),
        F.count_if(bare & (F.col("n_images") >= 1)).alias("__images"),
        F.bool_or((F.col("page") < 3) & (F.col("n_chars") > 0)).alias("__early"),
        F.bool_or((F.col("n_chars") == 0) & (F.col("n_images") >= 1)).alias("__only"),
    )
    rows = facts.join(meta.select(key, "producer", "creator"), key, "left")
    share = F.when(F.col("__share") >= NATIVE, "native_text").when(F.col("__share") >= MIXED, "mixed").otherwise("scanned")
    kind = F.when(scanner(F.col("producer"), F.col("creator")), "scanned_native").when((F.col("__words") <= FEW_WORDS) & F.col("__drawn"), "scanned").otherwise(share)
    out = rows.withColumn("pdf_type", kind)
    based = (F.col("pdf_type") == "scanned") | (F.col("__images") >= F.greatest(F.lit(1), F.floor(F.col("total_pages") / 2)))
    compiled = F.col("pdf_type").isin("scanned", "scanned_native") & (F.col("total_pages") >= COMPILED_PAGES)
    return out.select(key, "total_pages", "pdf_type", based.alias("image_based"), compiled.alias("compiled"), (~F.col("__early") & F.col("__only")).alias("converted"))


def merged(producer: Column, creator: Column, total_pages: Column, seconds: Column) -> Column:
    """Whether a document was put together from others: more than MERGED_PAGES pages and a tool that does it, or a long time between creation and change."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tool = holds_any(low(producer), MERGERS) | holds_any(low(creator), MERGERS)
    return (total_pages > MERGED_PAGES) & (tool | F.coalesce(seconds / 60 > MERGED_MINUTES, F.lit(False)))


def merge_discount(metadata: Column, is_merged: Column) -> Column:
    return F.when(is_merged, (metadata * MERGED_WEIGHT).cast("int")).otherwise(metadata)


def scanned_pages(pages: DataFrame, types: DataFrame, key: str) -> DataFrame:
    """The pages that the checks of scans get: all of scanned documents, those of mixed ones that are nearly without text and have an image."""
    rows = pages.join(types.where(F.col("pdf_type").isin(*ROUTED)).select(key, "pdf_type"), key)
    return rows.where((F.col("pdf_type") != "mixed") | ((F.col("n_chars") < BARE_CHARS) & (F.col("n_images") >= 1)))


def checked_images(images: DataFrame, page_area: Column) -> DataFrame:
    """The images that are looked at on their own: not small (w, h in pixels) and not most of the page (box)."""
    covered = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / page_area
    return images.where((F.least("w", "h") >= IMAGE_SIDE) & (covered < IMAGE_SHARE))


def distinct_images(images: DataFrame, key: str) -> DataFrame:
    """key, digest, n_placements of each distinct image of a document; findings of it join back to its placements by digest."""
    return images.withColumn("digest", F.md5("content")).groupBy(key, "digest").agg(F.count("*").alias("n_placements"))


def zone_weights(regions: DataFrame, height: Column, scanned: Column) -> DataFrame:
    """regions (box) without those that begin in the lowest BLOCKED_BOTTOM of the page, with score_weight, which is less at the top of scans."""
    rows = regions.where(F.col("y0") <= height * (1 - BLOCKED_BOTTOM))
    return rows.withColumn("score_weight", F.when(scanned & (F.col("y0") < height * LIGHT_TOP), LIGHT_WEIGHT).otherwise(1.0))


def drawn(findings: DataFrame, strong: DataFrame, agreed: DataFrame, key: str) -> DataFrame:
    """The findings that are strong enough to be drawn: on pages where layers agree (agreed: page), sure by themselves (running balances and arithmetic, high z or score), or on pages with many layers (strong: page, strong)."""
    rows = findings.join(agreed.select(key, "page").distinct().withColumn("__a", F.lit(True)), [key, "page"], "left").join(strong.where("strong").select(key, "page").distinct().withColumn("__s", F.lit(True)), [key, "page"], "left")
    own = (F.col("layer") == "numeric") & ((F.col("context") == "running_balance") | F.col("context").startswith("arithmetic_") | (F.col("z") >= DRAWN_Z)) | (F.col("layer") == "content") & (F.col("score") >= DRAWN_SCORE)
    return rows.where(F.coalesce(F.col("__a"), F.col("__s"), own, F.lit(False))).drop("__a", "__s")


def page_totals(pages: DataFrame, key: str) -> DataFrame:
    """key, total_pages, total_chars, total_words (a fifth of the characters), images."""
    return pages.groupBy(key).agg(F.count("*").alias("total_pages"), F.sum("n_chars").alias("total_chars"), F.sum(F.floor(F.col("n_chars") / 5)).alias("total_words"), F.sum("n_images").alias("images"))


def confidence_detail(rows: DataFrame) -> DataFrame:
    """rows: verdict, combined, a column a layer. Adds active (layers that say something), detail_score and detail_label."""
    active = F.array_compact(F.array(*[F.when(F.col(layer) >= least, F.lit(layer)) for layer, least in ACTIVE.items() if layer in rows.columns]))
    n, verdict, score = F.size("active"), F.col("verdict"), F.col("combined")
    cases = [(verdict == "UNCERTAIN", 50, "REVIEW NEEDED"), ((verdict == "ORIGINAL") & (score < 10), 90, "VERY HIGH"), ((verdict == "ORIGINAL") & (score < 20), 75, "HIGH"), (verdict == "ORIGINAL", 55, "MEDIUM"), (n >= 3, 92, "VERY HIGH"), (n == 2, 78, "HIGH"), (n == 1, 60, "MEDIUM")]
    points, label = F.lit(50), F.lit("LOW")
    for when, p, name in reversed(cases):
        points, label = F.when(when, p).otherwise(points), F.when(when, name).otherwise(label)
    return rows.withColumn("active", active).withColumn("detail_score", points).withColumn("detail_label", label)


def summary(verdict: Column, combined: Column, kind: Column, source: Column, n_signals: Column, n_lines: Column, n_numbers: Column) -> Column:
    """One sentence or two on the result."""
    evidence = F.array_join(F.array_compact(F.array(F.when(n_lines > 0, F.format_string("%d suspicious lines", n_lines)), F.when(n_numbers > 0, F.format_string("%d numeric outliers", n_numbers)))), ", ")
    begin = F.format_string("%s document from %s, score %.1f of 100: ", F.replace(kind, F.lit("_"), F.lit(" ")), source, combined)
    end = F.when(verdict == "UNCERTAIN", F.format_string("near the threshold, %d signals; a person should look at it.", n_signals)).when(verdict == "ORIGINAL", F.lit("below the threshold, no significant evidence.")).otherwise(F.format_string("above the threshold; %s, %d signals.", F.when(evidence == "", "metadata and visual signals").otherwise(evidence), n_signals))
    return F.concat(begin, end)


def response(verdicts: DataFrame, lists: dict[str, DataFrame], key: str) -> DataFrame:
    """key, json: each document's verdict and capped lists of findings as one JSON object. lists: name to rows that have key and rank (see the reported functions)."""
    out = verdicts
    for name, rows in lists.items():
        body = F.struct("rank", *[c for c in rows.columns if c not in (key, "rank")])
        out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(body)).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns if c != key])).alias("json"))


def latest(rows: DataFrame, key: str, time: str, most: int) -> DataFrame:
    """The newest rows, so many of them: retention of a spool; rows with one key count once, the newest."""
    one = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    return rows.withColumn("__r", one).where("__r = 1").drop("__r").orderBy(F.desc(time), key).limit(most)


def reading_order(words: DataFrame, on: list[str], band: float = 4.0) -> DataFrame:
    """words (top, x0) with place: their number on the page by bands of the height, then from left to right."""
    order = Window.partitionBy(*on).orderBy(F.bround(F.col("top") / band) * band, "x0", "ord")
    return words.withColumn("place", F.row_number().over(order))


def full_metadata(rows: DataFrame, key: str) -> DataFrame:
    """key and one struct of what a report says of a file's metadata: empty texts as null, whether and how long after its creation it was changed, the age of the edit (edit_age), and all further columns."""
    texts = [c for c in ("producer", "creator", "author", "title", "subject", "keywords") if c in rows.columns]
    seconds = F.col("delta_seconds")
    interval = F.when(seconds < 120, F.format_string("%.0f seconds", seconds)).when(seconds.isNotNull(), F.format_string("%.1f minutes", seconds / 60))
    rest = [c for c in rows.columns if c not in (key, *texts, "delta_seconds")]
    body = [F.nullif(F.col(c), F.lit("")).alias(c) for c in texts] + [(F.coalesce(seconds, F.lit(0.0)) > 0).alias("was_modified_later"), interval.alias("modification_interval"), *rest]
    return rows.select(key, F.struct(*body).alias("metadata"))
