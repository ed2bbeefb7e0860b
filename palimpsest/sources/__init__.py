"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: What the intake takes.
DOCUMENT_TYPES, IMAGE_TYPES = ("pdf", "jpg", "jpeg", "png", "docx", "doc"), ("jpg", "jpeg", "png")


def uploads(spark: SparkSession, folder: str, types: tuple[str, ...] = DOCUMENT_TYPES) -> DataFrame:
    """path, ext, size_kb, content of the files that the intake takes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", ext.alias("ext"), (F.col("length") / 1024).alias("size_kb"), "content").where(F.col("ext").isin(*types))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """As uploads(), of image files; a PDF there is an error, as uploads() takes it."""
    found = uploads(spark, folder, (*IMAGE_TYPES, "pdf"))
    wrong = found.where("ext = 'pdf'").select("path").head(1)
    if wrong:
        raise ValueError(f"{wrong[0].path}: read PDF files with uploads()")
    return found


def latin(content: str = "content"):
    """A file's bytes as text, a character a byte."""
    return F.decode(F.col(content), "ISO-8859-1")


def raw_objects(files: DataFrame) -> DataFrame:
    """path, eof_marks, ord, objid, gen, offset of every `<id> <gen> obj` in the files' bytes."""
    # texts between the definitions give their offsets
    pattern = r"(\d+)[ \t]+(\d+)[ \t]+obj\b"
    held = files.select("path", latin().alias("t")).withColumn("found", F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).withColumn("between", F.split("t", pattern))
    ends = F.transform(F.sequence(F.lit(1), F.size("found")), lambda n: F.aggregate(F.slice("between", 1, n), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice("found", 1, n - 1), F.lit(0), lambda s, x: s + F.length(x)))
    marks = F.size(F.split("t", "%%EOF")) - 1
    rows = held.where(F.size("found") > 0).select("path", marks.alias("eof_marks"), F.posexplode(F.arrays_zip("found", ends.alias("offset"))).alias("ord", "o"))
    return rows.select("path", "eof_marks", "ord", F.regexp_extract("o.found", r"^(\d+)", 1).cast("long").alias("objid"), F.regexp_extract("o.found", r"[ \t](\d+)[ \t]", 1).cast("int").alias("gen"), F.col("o.offset").cast("long").alias("offset"))


def raw_facts(files: DataFrame) -> DataFrame:
    """path, size, version, eof, xrefs, startxrefs, prev (offset of the earlier table, or null), notes (free texts and redactions), scripts, open_action, embedded_files, encrypted, trailer_ids of PDF files, by marks in their bytes."""
    t = F.col("t")
    count = lambda mark: F.size(F.split(t, mark)) - 1
    number = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).cast("long")
    rows = files.select("path", F.octet_length("content").cast("long").alias("size"), latin().alias("t"))
    return rows.select(
        "path",
        "size",
        F.nullif(F.regexp_extract(t, r"^%PDF-([0-9.]+)", 1), F.lit("")).alias("version"),
        count("%%EOF").alias("eof"),
        count("\nxref").alias("xrefs"),
        count("startxref").alias("startxrefs"),
        number(r"/Prev\s+([0-9]+)").alias("prev"),
        F.size(F.regexp_extract_all(t, F.lit(r"/Subtype\s*/(FreeText|Redact)\b"), F.lit(0))).alias("notes"),
        F.size(F.regexp_extract_all(t, F.lit(r"/(JavaScript|JS)\b"), F.lit(0))).alias("scripts"),
        t.rlike(r"/OpenAction\b").alias("open_action"),
        t.rlike(r"/EmbeddedFiles?\b").alias("embedded_files"),
        t.rlike(r"/Encrypt\b").alias("encrypted"),
        F.regexp_extract_all(F.regexp_extract(t, r"/ID\s*\[([^\]]*)\]", 1), F.lit(r"<([0-9A-Fa-f]+)>"), F.lit(1)).alias("trailer_ids"),
    )


def signatures(files: DataFrame) -> DataFrame:
    """path, ord, start1, length1, start2, length2 of every signed range in the files' bytes."""
    pattern = r"/ByteRange\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
    rows = files.select("path", F.posexplode(F.regexp_extract_all(latin(), F.lit(pattern), F.lit(0))).alias("ord", "r"))
    return rows.select("path", "ord", *[F.regexp_extract("r", pattern, i + 1).cast("long").alias(n) for i, n in enumerate(("start1", "length1", "start2", "length2"))])


def information(files: DataFrame) -> DataFrame:
    """path and the entries of the files' information dictionaries and XMP packets that are plain text: title, author, subject, keywords, creator, producer, created, modified (texts), xmp_producer, xmp_tool, xmp_created, xmp_modified, xmp_metadata_date. The last one of a kind counts, as later revisions come later; the first
    that is not empty of /Info and XMP is taken for producer, creator and author by first_of()."""
    t = F.col("t")
    last = lambda found: F.nullif(F.trim(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))), F.lit(""))
    literal = lambda name: last(F.regexp_extract_all(t, F.lit(rf"/{name}\s*\(((?:[^()\\]|\\.)*)\)"), F.lit(1)))
    tag = lambda name: last(F.concat(F.regexp_extract_all(t, F.lit(rf"<{name}>\s*(?:<rdf:\w+>\s*<rdf:li[^>]*>)?([^<]*)"), F.lit(1)), F.regexp_extract_all(t, F.lit(rf'{name}="([^"]*)"'), F.lit(1))))
    info = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "created": "CreationDate", "modified": "ModDate"}
    xmp = {"xmp_producer": "pdf:Producer", "xmp_tool": "xmp:CreatorTool", "xmp_creator": "dc:creator", "xmp_created": "xmp:CreateDate", "xmp_modified": "xmp:ModifyDate", "xmp_metadata_date": "xmp:MetadataDate"}
    return files.select("path", latin().alias("t")).select("path", *[literal(n).alias(c) for c, n in info.items()], *[tag(n).alias(c) for c, n in xmp.items()])


def first_of(*columns: str):
    """The first of the columns that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


def shown_text(files: DataFrame) -> DataFrame:
    """path, ord, text, y0: the operands of Tj and TJ in streams that are not compressed, as rows of 20 points: what is left where no other reader finds words."""
    t = latin()
    string = r"\(((?:[^()\\]|\\.)*)\)"
    shown = F.regexp_extract_all(t, F.lit(rf"(?s)(?:{string}\s*Tj|\[(?:[^\]\\]|\\.)*\]\s*TJ)"), F.lit(0))
    parts = F.transform(shown, lambda s: F.array_join(F.regexp_extract_all(s, F.lit(string), F.lit(1)), ""))
    rows = files.select("path", F.posexplode(F.filter(parts, lambda s: F.trim(s) != "")).alias("ord", "text"))
    return rows.select("path", "ord", F.regexp_replace("text", r"\\([()\\])", "$1").alias("text"), (F.col("ord") * 20.0).alias("y0"))


def revision_bytes(files: DataFrame) -> DataFrame:
    """path, rev, content: the file as it was at each end-of-file mark (and six bytes), for files with more than one."""
    t = latin()
    pieces = F.split(t, "%%EOF")
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda n: F.aggregate(F.slice(pieces, 1, n), F.lit(0), lambda s, x: s + F.length(x)) + n * 5 + 1)
    rows = files.where(F.size(F.split(t, "%%EOF")) > 2).select("path", "content", F.posexplode(ends).alias("rev", "size"))
    return rows.select("path", "rev", F.substr("content", F.lit(1), F.col("size").cast("int")).alias("content"))


def object_versions(objects: DataFrame, most: int = 5) -> DataFrame:
    """path, objid, versions, first_offset of the objects that are defined more than once, those of the most versions first."""
    from pyspark.sql import Window

    counted = objects.groupBy("path", "objid").agg(F.count("*").alias("versions"), F.min("offset").alias("first_offset")).where("versions > 1")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("versions"), "first_offset"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


def write_findings(findings: DataFrame, folder: str) -> None:
    """Findings by layer; a run replaces the layers that it has."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(folder)


def quantisation(files: DataFrame) -> DataFrame:
    """path, number, steps (64, in zigzag order) of the tables that a JPEG file's own bytes define; the last definition of a number counts."""
    import pyarrow as pa

    def tables(body: bytes) -> dict[int, list[int]]:
        found, at = {}, 2
        while body[:2] == b"\xff\xd8" and at + 4 <= len(body) and body[at] == 0xFF and body[at + 1] != 0xDA:
            size = int.from_bytes(body[at + 2 : at + 4], "big")
            part, here = body[at + 4 : at + 2 + size], 0
            while body[at + 1] == 0xDB and here < len(part):
                wide = 2 if part[here] >> 4 else 1
                values = part[here + 1 : here + 1 + 64 * wide]
                if len(values) == 64 * wide:
                    found[part[here] & 15] = [int.from_bytes(values[i : i + wide], "big") for i in range(0, 64 * wide, wide)]
                here += 1 + 64 * wide
            at += 2 + max(size, 2)
        return found

    def run(batches):
        for batch in batches:
            rows = [(p, n, s) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for n, s in sorted(tables(c or b"").items())]
            yield pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "number": pa.array([r[1] for r in rows], pa.int32()), "steps": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})

    return files.select("path", "content").mapInArrow(run, "path string, number int, steps array<int>")
