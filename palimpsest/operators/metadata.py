"""What a file's metadata say: the tool behind it, and points for what does not fit."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lines import holds_any

#: Points.
SUSPICION = {"HIGH": 40, "MEDIUM": 20, "UNKNOWN": 15, "LOW": 0}
STRIPPED, XMP_MISMATCH, XMP_DATE, ROTATION, INSTANT, LATER, PRODUCERS, XMP_PRODUCER, CONVERTED, CLEARED, AUTHOR_CLEARED, UNRECOGNISED = 25, 30, 20, 15, 15, 5, 20, 15, 15, 30, 15, 30
RAPID_SECONDS, INSTANT_SECONDS, MOST = 60, 5, 100
#: Names that say nothing about the author, an own converter's mark and creators, and the kinds of tools.
NAMELESS = ("(anonymous)", "(unspecified)", "anonymous", "unknown", "(unknown)", "user", "owner")
CONVERTER, CONVERTER_CREATORS = "reportlab", ("anonymous", "", "—")
ONLINE, EDITOR, SCANNER = "online_editor", "desktop_editor", "scanner"


def producers(spark: SparkSession, path: str) -> DataFrame:
    """ord, pattern, name, suspicion, category of a JSON file {"producers": [...]}; the order in the file is the priority."""
    held = "producers array<struct<pattern:string,name:string,suspicion:string,category:string>>"
    return spark.read.schema(held).option("multiLine", "true").json(path).select(F.posexplode("producers").alias("ord", "p")).select("ord", "p.*")


def identified(docs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """docs (key, producer, creator) with name, suspicion, category of the first known pattern that the two hold, and is_online_tool, is_editor, is_scanner; Unknown if none is.

    The dimension has a row a tool, so it goes to all executors; each distinct pair of names is looked up once.
    """
    pair = F.lower(F.concat_ws(" ", F.coalesce("producer", F.lit("")), F.coalesce("creator", F.lit(""))))
    rows = docs.withColumn("__pair", pair)
    found = rows.select("__pair").distinct().join(F.broadcast(known), F.contains(F.col("__pair"), F.col("pattern"))).groupBy("__pair").agg(F.min(F.struct("ord", "name", "suspicion", "category")).alias("t"))
    out = rows.join(found, "__pair", "left").drop("__pair")
    out = out.withColumns({"name": F.coalesce("t.name", F.lit("Unknown")), "suspicion": F.coalesce("t.suspicion", F.lit("UNKNOWN")), "category": F.coalesce("t.category", F.lit("unknown"))}).drop("t")
    return out.withColumns({"is_online_tool": F.col("category") == ONLINE, "is_editor": F.col("category") == EDITOR, "is_scanner": F.col("category") == SCANNER})


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def nameless(name: str) -> Column:
    bare = F.trim(F.lower(text_of(name)))
    return (bare == "") | holds_any(bare, NAMELESS)


def benign(rows: DataFrame) -> DataFrame:
    """rows with own_converter and server_made: documents of which the metadata say nothing against them."""
    mark = F.contains(F.lower(text_of("producer")), F.lit(CONVERTER)) & F.lower(text_of("creator")).isin(*CONVERTER_CREATORS)
    absent = (F.trim(text_of("producer")) == "") & (F.trim(text_of("creator")) == "")
    other = reduce(or_, [F.coalesce(F.col(c), F.lit(False)) for c in ("xmp_mismatch", "multiple_producers", "rotation_anomaly", "xmp_date_mismatch")]) | xmp_differs() | F.coalesce(F.col("delta_seconds") >= RAPID_SECONDS, F.lit(False))
    quick = F.col("delta_seconds").isNull() | (F.col("delta_seconds") < 1)
    return rows.withColumn("own_converter", mark).withColumn("server_made", ~mark & absent & quick & ~other)


def xmp_differs() -> Column:
    """Whether both producers are named, differently."""
    return (text_of("xmp_producer") != "") & (text_of("producer") != "") & (F.lower(text_of("xmp_producer")) != F.lower(text_of("producer")))


def metadata_score(rows: DataFrame) -> DataFrame:
    """rows: producer, creator, author, xmp_producer, delta_seconds, was_modified, xmp_mismatch, multiple_producers, stripped, rotation_anomaly, xmp_date_mismatch, suspicion. Adds
    own_converter, server_made, author_cleared, creator_cleared and metadata (0 to 100)."""
    out = benign(rows).withColumn("author_cleared", nameless("author")).withColumn("creator_cleared", nameless("creator"))
    points = lambda when, n: F.when(when, n).otherwise(0)
    author, creator, modified, delta = F.col("author_cleared"), F.col("creator_cleared"), F.coalesce("was_modified", F.lit(False)), F.col("delta_seconds")
    unknown = F.col("suspicion") == "UNKNOWN"
    named = (text_of("producer") != "") | (text_of("creator") != "")
    total = sum((points(F.col("suspicion") == k, n) for k, n in SUSPICION.items()), F.lit(0))
    total = total + sum((points(F.col(c), n) for c, n in (("stripped", STRIPPED), ("xmp_mismatch", XMP_MISMATCH), ("xmp_date_mismatch", XMP_DATE), ("rotation_anomaly", ROTATION), ("multiple_producers", PRODUCERS))), F.lit(0))
    total = total + F.when(delta < RAPID_SECONDS, INSTANT).when(delta > 0, LATER).otherwise(0) + points(xmp_differs(), XMP_PRODUCER)
    total = total + points((F.coalesce("stripped", F.lit(False)) | unknown) & (delta < INSTANT_SECONDS), CONVERTED)
    total = total + F.when(author & creator & modified, CLEARED).when(author & modified, AUTHOR_CLEARED).otherwise(0)
    total = total + points(unknown & named & modified & (author | creator), UNRECOGNISED)
    return out.withColumn("metadata", F.when(F.col("own_converter") | F.col("server_made"), 0).otherwise(F.least(F.lit(MOST), total)))


def rotations(pages: DataFrame, key: str) -> DataFrame:
    """key, rotations (distinct, sorted), rotation_anomaly of documents whose pages are turned differently."""
    held = pages.groupBy(key).agg(F.array_sort(F.collect_set("rotation")).alias("rotations"))
    return held.withColumn("rotation_anomaly", F.size("rotations") > 1)


def page_sizes(pages: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """pages (width, height in points) with paper: A4, Letter or A5, either way round, within so many millimetres, or Custom."""
    mm = lambda c: F.col(c) * 25.4 / 72
    sizes = {"A4": (210.0, 297.0), "Letter": (215.9, 279.4), "A5": (148.0, 210.0)}  # fixed values
    near = lambda a, b: (F.abs(mm("width") - a) <= tolerance) & (F.abs(mm("height") - b) <= tolerance)
    return pages.withColumn("paper", F.coalesce(*[F.when(near(a, b) | near(b, a), name) for name, (a, b) in sizes.items()], F.lit("Custom")))
