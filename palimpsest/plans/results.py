"""Queries of metadata, routing, fusion, structure and drawing on derived views, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import dates, geometry
from ..operators import drawing, fusion, metadata, routing, structure, verdicts
from .evidence import HIT, PSPANS, any_part, page_spans, quoted
from .forensics import COMBINED, combined, query, read

# ---------------------------------------------------------------- metadata

#: What documents' metadata say, by the remainder of their id.
SAID = {
    "producer": ["", "ReportLab PDF Library", "iLovePDF", "Acrobat Distiller 9", "Foo Writer", "Canon Scan", None, "Smallpdf Basic", "Skia/PDF m90"],
    "creator": ["", "anonymous", "Word", "(unspecified)", "iLovePDF online", None, "Chrome"],
    "author": [None, "Jane Doe", "User", "", "  unknown "],
    "xmp_producer": [None, "ILOVEPDF", "Other", ""],
    "delta_seconds": [None, 0.0, 0.5, 3.0, 59.0, 60.0, 4000.0, 86400.0],
}
FLAGS = {"xmp_mismatch": 11, "multiple_producers": 13, "stripped": 17, "rotation_anomaly": 19, "xmp_date_mismatch": 23}
#: Fixed values of these queries: a few known tools, in order of priority.
TOOLS = [("ilovepdf", "iLovePDF", "HIGH", "online_editor"), ("acrobat", "Adobe Acrobat", "MEDIUM", "desktop_editor"), ("canon", "Canon", "LOW", "scanner"), ("word", "Microsoft Word", "LOW", "office"), ("pdf", "Some PDF tool", "LOW", "library"), ("chrome", "Chrome", "LOW", "browser")]


def _listed(values) -> str:
    return "[" + ", ".join(quoted(v) if not isinstance(v, float) else f"{v}::DOUBLE" for v in values) + "]"


META = (
    f"meta AS (SELECT doc_id, {', '.join(f'({_listed(v)})[doc_id % {len(v)} + 1] AS {k}' for k, v in SAID.items())}, {', '.join(f'doc_id % {n} = 0 AS {k}' for k, n in FLAGS.items())} FROM documents), "
    f"tools(ord, pattern, name, suspicion, category) AS (VALUES {', '.join(f'({i}, {quoted(p)}, {quoted(n)}, {quoted(s)}, {quoted(c)})' for i, (p, n, s, c) in enumerate(TOOLS))}), "
    "hits AS (SELECT doc_id, first((name, suspicion, category) ORDER BY ord) AS t FROM meta JOIN tools ON contains(lower(concat_ws(' ', coalesce(producer, ''), coalesce(creator, ''))), pattern) GROUP BY doc_id), "
    "named AS (SELECT meta.*, coalesce(t[1], 'Unknown') AS name, coalesce(t[2], 'UNKNOWN') AS suspicion, coalesce(t[3], 'unknown') AS category, coalesce(delta_seconds > 0, false) AS was_modified FROM meta LEFT JOIN hits USING (doc_id))"
)


def meta(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (d % len(values)).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", *[pick(v).alias(k) for k, v in SAID.items()], *[(d % n == 0).alias(k) for k, n in FLAGS.items()])


def tools(spark) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TOOLS)], "ord int, pattern string, name string, suspicion string, category string")


def named(spark, sf_dir) -> DataFrame:
    return metadata.identified(meta(spark, sf_dir), tools(spark), "doc_id").withColumn("was_modified", F.coalesce(F.col("delta_seconds") > 0, F.lit(False)))


@query(f"WITH {META} SELECT doc_id, name, suspicion, category, category = 'online_editor' AS is_online_tool, category = 'desktop_editor' AS is_editor, category = 'scanner' AS is_scanner FROM named")
def producer_lookup(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", "name", "suspicion", "category", "is_online_tool", "is_editor", "is_scanner")


def _nameless(c: str) -> str:
    bare = f"trim(lower(coalesce({c}, '')), ' ')"
    return f"({bare} = '' OR {any_part(bare, metadata.NAMELESS)})"


_DIFFERS = "(coalesce(xmp_producer, '') <> '' AND coalesce(producer, '') <> '' AND lower(xmp_producer) <> lower(producer))"
SCORED = f"""{META}, judged AS (SELECT *, contains(lower(coalesce(producer, '')), 'reportlab') AND lower(coalesce(creator, '')) IN ('anonymous', '', '—') AS own, {_nameless('author')} AS a, {_nameless('creator')} AS c, {_DIFFERS} AS differs, coalesce(producer, '') <> '' OR coalesce(creator, '') <> '' AS said FROM named),
benign AS (SELECT *, NOT own AND trim(coalesce(producer, ''), ' ') = '' AND trim(coalesce(creator, ''), ' ') = '' AND (delta_seconds IS NULL OR delta_seconds < 1) AND NOT (xmp_mismatch OR multiple_producers OR rotation_anomaly OR xmp_date_mismatch OR differs) AS server FROM judged),
scored AS (SELECT doc_id, own AS own_converter, server AS server_made, CASE WHEN own OR server THEN 0 ELSE least(100, CASE suspicion WHEN 'HIGH' THEN 40 WHEN 'MEDIUM' THEN 20 WHEN 'UNKNOWN' THEN 15 ELSE 0 END + CASE WHEN stripped THEN 25 ELSE 0 END + CASE WHEN xmp_mismatch THEN 30 ELSE 0 END + CASE WHEN xmp_date_mismatch THEN 20 ELSE 0 END + CASE WHEN rotation_anomaly THEN 15 ELSE 0 END + CASE WHEN multiple_producers THEN 20 ELSE 0 END
  + CASE WHEN delta_seconds < 60 THEN 15 WHEN delta_seconds > 0 THEN 5 ELSE 0 END + CASE WHEN differs THEN 15 ELSE 0 END + CASE WHEN (stripped OR suspicion = 'UNKNOWN') AND delta_seconds < 5 THEN 15 ELSE 0 END + CASE WHEN a AND c AND was_modified THEN 30 WHEN a AND was_modified THEN 15 ELSE 0 END + CASE WHEN suspicion = 'UNKNOWN' AND said AND was_modified AND (a OR c) THEN 30 ELSE 0 END) END AS metadata, producer, creator, delta_seconds FROM benign)"""


@query(f"WITH {SCORED} SELECT doc_id, own_converter, server_made, metadata FROM scored")
def metadata_score(spark, sf_dir):
    return metadata.metadata_score(named(spark, sf_dir)).select("doc_id", "own_converter", "server_made", "metadata")


@query(f"WITH {SCORED}, p AS (SELECT *, doc_id % 7 AS pages, pages > 3 AND ({any_part('lower(coalesce(producer, chr(32)))', routing.MERGERS)} OR {any_part('lower(coalesce(creator, chr(32)))', routing.MERGERS)} OR coalesce(delta_seconds / 60 > 60, false)) AS merged FROM scored) SELECT doc_id, merged, CASE WHEN merged THEN CAST(floor(metadata * 0.4) AS INT) ELSE metadata END AS discounted FROM p")
def merge_discounts(spark, sf_dir):
    rows = metadata.metadata_score(named(spark, sf_dir))
    is_merged = routing.merged(F.col("producer"), F.col("creator"), F.col("doc_id") % 7, F.col("delta_seconds"))
    return rows.select("doc_id", is_merged.alias("merged"), routing.merge_discount(F.col("metadata"), is_merged).alias("discounted"))


# ---------------------------------------------------------------- pages

PAGES = "pg AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 25 ELSE o_orderkey % 40 * (o_orderkey % 5) END AS n_chars, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey % 40 // 5 END AS n_words, o_orderkey % 17 AS n_paths, o_orderkey % 3 AS n_images, CASE o_orderkey % 11 WHEN 0 THEN 90 WHEN 1 THEN 180 ELSE 0 END AS rotation, [595.0, 612.0, 420.0, 842.0, 500.0][o_orderkey % 5 + 1] + o_orderkey % 4 AS width, [842.0, 792.0, 595.0, 595.0, 700.0][o_orderkey % 5 + 1] + o_orderkey % 3 AS height FROM orders)"
DOC_META = f"dm AS (SELECT c_custkey AS doc, ({_listed(SAID['producer'])})[c_custkey % 9 + 1] AS producer, ({_listed(SAID['creator'])})[c_custkey % 7 + 1] AS creator FROM customer)"


def pages(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % 5).cast("int"))
    return read(spark, sf_dir, "orders").select(
        c.alias("doc"),
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("page"),
        F.when(c % 3 == 0, k % 25).otherwise(k % 40 * (k % 5)).alias("n_chars"),
        F.when(c % 5 == 0, 0).otherwise(F.floor(k % 40 / 5)).alias("n_words"),
        (k % 17).alias("n_paths"),
        (k % 3).alias("n_images"),
        F.when(k % 11 == 0, 90).when(k % 11 == 1, 180).otherwise(0).alias("rotation"),
        (pick(595.0, 612.0, 420.0, 842.0, 500.0) + k % 4).alias("width"),
        (pick(842.0, 792.0, 595.0, 595.0, 700.0) + k % 3).alias("height"),
    )


def doc_meta(spark, sf_dir) -> DataFrame:
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values)).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), pick(SAID["producer"]).alias("producer"), pick(SAID["creator"]).alias("creator"))


TYPES = f"""{PAGES}, {DOC_META}, fx AS (SELECT doc, count(*) AS total_pages, avg(CASE WHEN n_chars > 30 THEN 1.0 ELSE 0.0 END) AS share, sum(n_words) AS words, bool_or(n_paths > 10 AND n_chars < 20) AS drawn, count(*) FILTER (n_chars < 20 AND n_images >= 1) AS images, bool_or(page < 3 AND n_chars > 0) AS early, bool_or(n_chars = 0 AND n_images >= 1) AS only_ FROM pg GROUP BY doc),
ty AS (SELECT fx.*, CASE WHEN {any_part("lower(coalesce(producer, ''))", routing.SCANNERS)} OR {any_part("lower(coalesce(creator, ''))", routing.SCANNERS)} THEN 'scanned_native' WHEN words <= 10 AND drawn THEN 'scanned' WHEN share >= 0.7 THEN 'native_text' WHEN share >= 0.3 THEN 'mixed' ELSE 'scanned' END AS pdf_type FROM fx LEFT JOIN dm USING (doc))"""


@query(f"WITH {TYPES} SELECT doc, total_pages, pdf_type, pdf_type = 'scanned' OR images >= greatest(1, total_pages // 2) AS image_based, pdf_type IN ('scanned', 'scanned_native') AND total_pages >= 4 AS compiled, NOT early AND only_ AS converted FROM ty")
def document_types(spark, sf_dir):
    return routing.document_types(pages(spark, sf_dir), doc_meta(spark, sf_dir), "doc")


@query(f"WITH {TYPES} SELECT doc, page FROM pg JOIN ty USING (doc) WHERE pdf_type IN ('scanned', 'scanned_native') OR pdf_type = 'mixed' AND n_chars < 20 AND n_images >= 1")
def scanned_pages(spark, sf_dir):
    rows = pages(spark, sf_dir)
    return routing.scanned_pages(rows, routing.document_types(rows, doc_meta(spark, sf_dir), "doc"), "doc").select("doc", "page")


@query(f"WITH {PAGES}, r AS (SELECT doc, list_sort(list_distinct(list(rotation))) AS rot FROM pg GROUP BY doc) SELECT doc, count(*) AS total_pages, CAST(sum(n_chars) AS BIGINT) AS total_chars, CAST(sum(n_chars // 5) AS BIGINT) AS total_words, CAST(sum(n_images) AS BIGINT) AS images, any_value(array_to_string(rot, ',')) AS rotations, any_value(len(rot) > 1) AS rotation_anomaly FROM pg JOIN r USING (doc) GROUP BY doc")
def page_totals(spark, sf_dir):
    rows = pages(spark, sf_dir)
    turned = metadata.rotations(rows, "doc").select("doc", F.array_join(F.transform("rotations", lambda r: r.cast("string")), ",").alias("rotations"), "rotation_anomaly")
    return routing.page_totals(rows, "doc").join(turned, "doc")


_PAPER = " ".join(f"WHEN (abs(width * 25.4 / 72 - {a}) <= 3 AND abs(height * 25.4 / 72 - {b}) <= 3) OR (abs(width * 25.4 / 72 - {b}) <= 3 AND abs(height * 25.4 / 72 - {a}) <= 3) THEN '{n}'" for n, (a, b) in {"A4": (210, 297), "Letter": (215.9, 279.4), "A5": (148, 210)}.items())


@query(f"WITH {PAGES} SELECT doc, page, CASE {_PAPER} ELSE 'Custom' END AS paper FROM pg")
def page_sizes(spark, sf_dir):
    return metadata.page_sizes(pages(spark, sf_dir)).select("doc", "page", "paper")


@query("WITH i AS (SELECT p_partkey AS k, p_size % 40 AS doc, p_size * 7 AS w, p_partkey % 300 AS h, 10.0 AS x0, 10.0 AS y0, 10.0 + p_partkey % 600 AS x1, 10.0 + p_size * 16 AS y1 FROM part) SELECT k, doc, md5(CAST(k % 50 AS VARCHAR)) AS digest, count(*) OVER (PARTITION BY doc, k % 50) AS n_placements FROM i WHERE least(w, h) >= 100 AND (x1 - x0) * (y1 - y0) / 484704.0 < 0.85")
def checked_images(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = read(spark, sf_dir, "part").select(k.alias("k"), (s % 40).alias("doc"), (s * 7).alias("w"), (k % 300).alias("h"), F.lit(10.0).alias("x0"), F.lit(10.0).alias("y0"), (10.0 + k % 600).alias("x1"), (10.0 + s * 16).alias("y1"), (k % 50).cast("string").cast("binary").alias("content"))
    held = routing.checked_images(rows, F.lit(612.0 * 792.0))
    return held.withColumn("digest", F.md5("content")).join(routing.distinct_images(held, "doc"), ["doc", "digest"]).select("k", "doc", "digest", "n_placements")


@query(f"WITH {PSPANS} SELECT ord, CASE WHEN doc % 2 = 0 AND y0 < 792 * 0.12::DOUBLE THEN 0.6 ELSE 1.0 END::DOUBLE AS score_weight FROM pspans WHERE y0 <= 792 * (1 - 0.15::DOUBLE)")
def zone_weights(spark, sf_dir):
    return routing.zone_weights(page_spans(spark, sf_dir), F.lit(792.0), F.col("doc") % 2 == 0).select("ord", "score_weight")


@query("SELECT doc, left(CAST(placed AS VARCHAR), 10) AS day FROM (SELECT o_custkey AS doc, max(o_orderdate) AS placed FROM orders GROUP BY o_custkey ORDER BY placed DESC, doc LIMIT 50)")
def newest_analyses(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderdate").alias("at")).distinct()
    return routing.latest(rows, "doc", "at", 50).select("doc", F.date_format("at", "yyyy-MM-dd").alias("day"))


# ---------------------------------------------------------------- fusion

#: Findings of five layers out of spans, and of metadata for every third document.
FINDINGS = f"""{PSPANS}, findings AS (SELECT doc, CASE ord % 5 WHEN 0 THEN 'content' WHEN 1 THEN 'numeric' WHEN 2 THEN 'ela' WHEN 3 THEN 'pymupdf' ELSE 'image' END AS layer, ord % 5 AS layer_ord, ord, page, CASE WHEN ord % 5 < 2 THEN CAST(floor(y0 / 40) AS BIGINT) END AS line, CASE WHEN ord % 5 < 2 THEN trim(text, ' ') END AS text, CASE WHEN ord % 31 > 0 THEN x0 END AS x0, CASE WHEN ord % 31 > 0 THEN y0 END AS y0, CASE WHEN ord % 31 > 0 THEN x1 END AS x1, CASE WHEN ord % 31 > 0 THEN y1 END AS y1 FROM pspans WHERE seqno < 9
  UNION ALL SELECT DISTINCT doc, 'metadata', 5, doc, 0, NULL, 'producer', NULL, NULL, NULL, NULL FROM pspans WHERE doc % 3 = 0)"""


def layer_findings(spark, sf_dir) -> DataFrame:
    o = F.col("ord")
    rows = page_spans(spark, sf_dir).where("seqno < 9")
    line = F.floor(F.col("y0") / 40)
    boxed = [F.when(o % 31 > 0, F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    of = lambda k, *more: rows.where(o % 5 == k).select("doc", "ord", "page", *more, F.lit(0.5).alias("score"), *boxed)
    said = [line.alias("line"), F.trim("text").alias("text")]
    held = {"content": of(0, *said), "numeric": of(1, *said), "ela": of(2), "pymupdf": of(3), "image": of(4)}
    held["metadata"] = page_spans(spark, sf_dir).where("doc % 3 = 0").select("doc").distinct().select("doc", F.col("doc").alias("ord"), F.lit(0).alias("page"), F.lit(0.4).alias("score"), F.lit("producer").alias("text"))
    return fusion.findings_union(held, "doc")


_MATCH = "(x.layer = 'metadata' OR a.layer = 'metadata' OR (x.page = a.page AND (coalesce(x.line = a.line, false) OR x.x0 IS NULL OR a.x0 IS NULL OR (x.x0 < a.x1 AND x.x1 > a.x0 AND x.y0 < a.y1 AND x.y1 > a.y0) OR sqrt(((x.x0 + x.x1) / 2 - (a.x0 + a.x1) / 2) ** 2 + ((x.y0 + x.y1) / 2 - (a.y0 + a.y1) / 2) ** 2) < 50)))"
GROUPED = f"""{FINDINGS}, listed AS (SELECT doc, list({{'layer': layer, 'layer_ord': layer_ord, 'ord': ord, 'page': page, 'line': line, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY layer_ord, ord) AS held FROM findings GROUP BY doc),
steps(doc, grp, held, got) AS (SELECT doc, -1, held, held[1:0] FROM listed UNION ALL SELECT doc, grp + 1, list_filter(held[2:len(held)], lambda x: NOT {_MATCH.replace('a.', 'held[1].')}), list_concat(held[1:1], list_filter(held[2:len(held)], lambda x: {_MATCH.replace('a.', 'held[1].')})) FROM steps WHERE len(held) > 0),
placed AS (SELECT doc, grp, unnest(got, recursive := true) FROM steps WHERE grp >= 0)"""


@query(f"WITH RECURSIVE {GROUPED} SELECT doc, layer, ord, grp FROM placed")
def fusion_groups(spark, sf_dir):
    return fusion.grouped(layer_findings(spark, sf_dir), "doc").select("doc", "layer", "ord", "grp")


@query(f"WITH RECURSIVE {GROUPED}, g AS (SELECT doc, grp, first(page ORDER BY layer_ord, ord) AS page, list_sort(list_distinct(list(layer))) AS layers, coalesce(min(x0), 0) AS x0, coalesce(min(y0), 0) AS y0, coalesce(max(x1), 100) AS x1, coalesce(max(y1), 20) AS y1 FROM placed GROUP BY doc, grp) SELECT doc, grp, page, array_to_string(layers, ',') AS layers, CASE WHEN list_contains(layers, 'metadata') OR len(layers) >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN list_contains(layers, 'metadata') THEN 85 WHEN len(layers) >= 3 THEN 90 ELSE 70 END AS score, x0, y0, x1, y1 FROM g WHERE len(layers) >= 2")
def fused_findings(spark, sf_dir):
    return fusion.fused(fusion.grouped(layer_findings(spark, sf_dir), "doc"), "doc").withColumn("layers", F.array_join("layers", ","))


@query(f"WITH RECURSIVE {GROUPED}, g AS (SELECT doc, grp, count(DISTINCT layer) AS n, count(*) AS held FROM placed GROUP BY doc, grp) SELECT doc, CAST(sum(held) AS BIGINT) AS total, count(*) AS \"groups\", count(*) FILTER (n >= 2) AS agreed, count(*) FILTER (n < 2) AS single FROM g GROUP BY doc")
def fusion_stats(spark, sf_dir):
    return fusion.fusion_stats(fusion.grouped(layer_findings(spark, sf_dir), "doc"), "doc")


#: Findings that repeat at a place, and rows of page furniture.
CONTRADICTED = f"""{FINDINGS}, f1 AS (SELECT doc, layer, ord, page, CASE WHEN ord % 3 = 0 THEN 'Running header' ELSE coalesce(text, CASE WHEN ord % 2 = 0 THEN 'x' || ord % 7 END) END AS text, CASE WHEN ord % 3 = 0 THEN 10.0 ELSE x0 END AS x0, CASE WHEN ord % 3 = 0 THEN 14.0 ELSE y0 END AS y0, CASE WHEN ord % 3 = 0 THEN 90.0 ELSE x1 END AS x1, CASE WHEN ord % 3 = 0 THEN 26.0 ELSE y1 END AS y1 FROM findings WHERE layer <> 'metadata'),
f2 AS (SELECT *, round_even(x0 / 10, 0) AS cx, round_even(y0 / 10, 0) AS cy, left(text, 25) AS t FROM f1 WHERE x0 IS NOT NULL AND coalesce(trim(text, ' '), '') <> ''),
f3 AS (SELECT *, (SELECT count(DISTINCT page) FROM f2 b WHERE b.doc = f2.doc AND b.layer = f2.layer AND b.cx = f2.cx AND b.cy = f2.cy AND b.t = f2.t) AS n FROM f2),
furniture AS (SELECT doc, page, ord AS line, x0, y0 + ord % 9 AS y0, x1, y1 AS y1 FROM pspans WHERE seqno >= 9 AND ord % 4 = 0),
beside AS (SELECT f.doc, f.layer, f.ord, f.page, min(b.line) AS furniture_line FROM f3 f JOIN furniture b ON f.doc = b.doc AND f.page = b.page AND least(f.y1, b.y1) - greatest(f.y0, b.y0) > 0 AND (least(f.y1 - f.y0, b.y1 - b.y0) <= 0 OR least(f.y1, b.y1) - greatest(f.y0, b.y0) >= 0.5 * least(f.y1 - f.y0, b.y1 - b.y0)) WHERE n < 3 GROUP BY ALL),
contra AS (SELECT doc, layer, ord, page, n AS n_pages, NULL::BIGINT AS furniture_line FROM f3 WHERE n >= 3 UNION ALL SELECT doc, layer, ord, page, NULL, furniture_line FROM beside)"""


def repeating(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = F.col("ord")
    rows = layer_findings(spark, sf_dir).where("layer <> 'metadata'")
    text = F.when(o % 3 == 0, "Running header").otherwise(F.coalesce("text", F.when(o % 2 == 0, F.concat(F.lit("x"), (o % 7).cast("string")))))
    rows = rows.withColumns({"text": text, **{c: F.when(o % 3 == 0, v).otherwise(F.col(c)) for c, v in (("x0", 10.0), ("y0", 14.0), ("x1", 90.0), ("y1", 26.0))}})
    furniture = page_spans(spark, sf_dir).where("seqno >= 9 and ord % 4 = 0").select("doc", "page", o.alias("line"), "x0", (F.col("y0") + o % 9).alias("y0"), "x1", "y1")
    return rows, furniture


@query(f"WITH {CONTRADICTED} SELECT doc, layer, ord, page, coalesce(n_pages, -1) AS n_pages, coalesce(furniture_line, -1) AS furniture_line, CASE layer WHEN 'numeric' THEN 'numeric_vs_structural_context' ELSE 'cross_page_repetition' END AS rule FROM contra")
def contradictions(spark, sf_dir):
    return fusion.contradictions(*repeating(spark, sf_dir), "doc").drop("points").na.fill(-1, ["n_pages", "furniture_line"])


@query(f"WITH {CONTRADICTED} SELECT doc, layer, 10 * count(*) AS points FROM contra GROUP BY doc, layer")
def layer_points(spark, sf_dir):
    return fusion.layer_points(fusion.contradictions(*repeating(spark, sf_dir), "doc"), "doc")


POINTS = "pts(doc_id, layer, points) AS (SELECT doc_id, ['content', 'numeric', 'ela', 'pymupdf', 'image'][doc_id % 5 + 1], doc_id % 9 * 10 FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'content', 10 FROM documents WHERE doc_id % 4 = 0)"


def points(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id")
    layers = F.array(*[F.lit(x) for x in ("content", "numeric", "ela", "pymupdf", "image")])
    one = rows.where("doc_id % 3 > 0").select("doc_id", F.get(layers, (d % 5).cast("int")).alias("layer"), (d % 9 * 10).alias("points"))
    return one.unionByName(rows.where("doc_id % 4 = 0").select("doc_id", F.lit("content").alias("layer"), F.lit(10).cast("long").alias("points")))


@query(f"""WITH {COMBINED}, {POINTS}, s AS (SELECT doc_id, {', '.join(f"sum(points) FILTER (layer = '{x}') AS p_{x}" for x in ('content', 'numeric', 'ela', 'pymupdf'))} FROM pts GROUP BY doc_id),
a AS (SELECT c.*, greatest(0, content - coalesce(p_content, 0)) AS c2, greatest(0, numeric_ - coalesce(p_numeric, 0)) AS n2, greatest(0, ela - coalesce(p_ela, 0)) AS e2, greatest(0, pymupdf - coalesce(p_pymupdf, 0)) AS o2 FROM combined c LEFT JOIN s USING (doc_id)),
l AS (SELECT a.*, (content - c2) * CAST(b AS DOUBLE) + (numeric_ - n2) * CAST(c AS DOUBLE) + (ela - e2) * CAST(d AS DOUBLE) + (pymupdf - o2) * CAST(e AS DOUBLE) AS lost FROM a JOIN w USING (pdf_type)),
f AS (SELECT *, CASE WHEN lost > 0 THEN greatest(0, combined - lost) END AS raw_ FROM l), h AS (SELECT *, CAST(CAST(raw_ AS VARCHAR) AS DECIMAL(30, 22)) * 10 AS t FROM f), g AS (SELECT *, CAST(floor(t) + CASE WHEN t - floor(t) > 0.5 OR (t - floor(t) = 0.5 AND floor(t) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10 AS fresh FROM h)
SELECT doc_id, c2 AS content, round(coalesce(fresh, combined), 1) AS combined, CASE WHEN fresh IS NULL THEN verdict WHEN abs(fresh - threshold) <= 5 THEN 'UNCERTAIN' WHEN fresh >= threshold THEN 'MODIFIED' ELSE 'ORIGINAL' END AS verdict FROM g""")
def contradicted_verdicts(spark, sf_dir):
    return fusion.contradicted(combined(spark, sf_dir), points(spark, sf_dir), "doc_id").select("doc_id", "content", F.round("combined", 1).alias("combined"), "verdict")


@query(f"WITH {FINDINGS}, l AS (SELECT doc, page, count(DISTINCT layer) AS n FROM findings WHERE layer <> 'metadata' GROUP BY doc, page), agreed AS (SELECT DISTINCT doc, page FROM findings WHERE ord % 37 = 0 AND layer <> 'metadata'), f AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 'running_balance' WHEN ord % 4 = 1 THEN 'arithmetic_x' ELSE 'column group' END AS context, (ord % 70) / 10 AS z, (ord % 8) / 10 AS score FROM findings WHERE page < 4) SELECT f.doc, f.layer, f.ord FROM f LEFT JOIN l USING (doc, page) LEFT JOIN agreed USING (doc, page) WHERE agreed.doc IS NOT NULL OR l.n >= 4 OR layer = 'numeric' AND (context <> 'column group' OR z >= 5) OR layer = 'content' AND score >= 0.4")
def drawn_findings(spark, sf_dir):
    rows, o = layer_findings(spark, sf_dir), F.col("ord")
    strong = fusion.layers_per_page(rows, "doc", 4)
    held = rows.where("page < 4").withColumns({"context": F.when(o % 4 == 0, "running_balance").when(o % 4 == 1, "arithmetic_x").otherwise("column group"), "z": o % 70 / 10, "score": o % 8 / 10})
    return routing.drawn(held, strong, rows.where("ord % 37 = 0 and layer <> 'metadata'"), "doc").select("doc", "layer", "ord")


@query(f"WITH {PSPANS}, t AS (SELECT doc, page, ord, lower(trim(text, ' ')) AS t FROM pspans WHERE ord % 6 = 0) SELECT t.doc, t.page, t.ord, coalesce(first(s.y0 ORDER BY s.ord), -1) AS y0 FROM t LEFT JOIN pspans s ON s.doc = t.doc AND s.page = t.page AND t.t <> '' AND s.ord % 6 > 0 AND contains(lower(s.text), t.t) GROUP BY ALL")
def trace_places(spark, sf_dir):
    rows = page_spans(spark, sf_dir)
    return fusion.first_span_with(rows.where("ord % 6 = 0").select("doc", "page", "ord", "text"), rows.where("ord % 6 > 0"), "doc").select("doc", "page", "ord", F.coalesce("y0", F.lit(-1.0)).alias("y0"))


@query(f"WITH {COMBINED}, a AS (SELECT *, list_filter([CASE WHEN metadata >= 30 THEN 'metadata' END, CASE WHEN content >= 20 THEN 'content' END, CASE WHEN numeric_ >= 20 THEN 'numeric' END, CASE WHEN ela >= 20 THEN 'ela' END, CASE WHEN pymupdf >= 20 THEN 'pymupdf' END], lambda x: x IS NOT NULL) AS act FROM combined) SELECT doc_id, array_to_string(act, ',') AS active, CASE WHEN verdict = 'UNCERTAIN' THEN 50 WHEN verdict = 'ORIGINAL' THEN CASE WHEN combined < 10 THEN 90 WHEN combined < 20 THEN 75 ELSE 55 END WHEN len(act) >= 3 THEN 92 WHEN len(act) = 2 THEN 78 WHEN len(act) = 1 THEN 60 ELSE 50 END AS detail_score, CASE WHEN verdict = 'UNCERTAIN' THEN 'REVIEW NEEDED' WHEN verdict = 'ORIGINAL' THEN CASE WHEN combined < 10 THEN 'VERY HIGH' WHEN combined < 20 THEN 'HIGH' ELSE 'MEDIUM' END WHEN len(act) >= 3 THEN 'VERY HIGH' WHEN len(act) = 2 THEN 'HIGH' WHEN len(act) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS detail_label FROM a")
def confidence_details(spark, sf_dir):
    return routing.confidence_detail(combined(spark, sf_dir)).select("doc_id", F.array_join("active", ",").alias("active"), "detail_score", "detail_label")


@query(f"WITH {COMBINED} SELECT doc_id, verdict, doc_id % 4 AS n_lines FROM combined")
def responses(spark, sf_dir):
    """The JSON objects, read again."""
    rows = combined(spark, sf_dir).select("doc_id", "verdict", "combined")
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).where("rank <= doc_id % 4")
    held = routing.response(rows, {"lines": found}, "doc_id")
    back = held.select("doc_id", F.from_json("json", "verdict string, lines array<struct<rank:int>>").alias("j"))
    return back.select("doc_id", "j.verdict", F.coalesce(F.size("j.lines"), F.lit(0)).alias("n_lines"))


@query("WITH d AS (SELECT doc_id, doc_id % 3 AS k, (doc_id * 29) % 25 + 2000 AS created, 'Offer of ' || CAST(doc_id % 28 + 1 AS VARCHAR) || ' July ' || CAST(2000 + doc_id % 35 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN ', paid 1/2/' || CAST(1990 + doc_id % 60 AS VARCHAR) ELSE ' ' END || CASE WHEN doc_id % 5 = 0 THEN ' (2024-06-01)' ELSE '' END AS text FROM documents), y AS (SELECT doc_id, created, list_sort(list_distinct(list_filter([2000 + doc_id % 35, CASE WHEN doc_id % 2 = 0 AND 1990 + doc_id % 60 >= 2000 THEN 1990 + doc_id % 60 END, CASE WHEN doc_id % 5 = 0 THEN 2024 END], lambda x: x BETWEEN 2000 AND 2030))) AS printed FROM d) SELECT doc_id, array_to_string(printed, ',') AS printed, CAST(least(70, coalesce(list_sum(list_transform(printed, lambda x: CASE WHEN created - x > 1 THEN 35 WHEN x - created > 1 THEN 10 ELSE 0 END)), 0)) AS BIGINT) AS timeline FROM y")
def timelines(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat(F.lit("Offer of "), (d % 28 + 1).cast("string"), F.lit(" July "), (2000 + d % 35).cast("string"), F.when(d % 2 == 0, F.concat(F.lit(", paid 1/2/"), (1990 + d % 60).cast("string"))).otherwise(" "), F.when(d % 5 == 0, " (2024-06-01)").otherwise(""))
    rows = verdicts.timeline(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", d * 29 % 25 + 2000)
    return rows.select("doc_id", F.array_join(F.transform("printed", lambda y: y.cast("string")), ",").alias("printed"), "timeline")


# ---------------------------------------------------------------- structure

FORMS = f"{PAGES}, forms AS (SELECT doc, page, (doc + page) % 4 AS objid, 20.0 AS x0, 50.0 + (doc * 7 + page * 90) % 600 AS y0, 20.0 + (doc * 13) % 500 AS x1, 50.0 + (doc * 7 + page * 90) % 600 + (doc * 3) % 150 AS y1 FROM pg WHERE (doc + page) % 3 > 0 OR doc % 2 = 0), tot AS (SELECT doc, count(*) AS total FROM pg GROUP BY doc), first_ AS (SELECT f.doc, objid, count(DISTINCT f.page) AS n, first((f.x0, f.y0, f.x1, f.y1, pg.height, pg.width * pg.height) ORDER BY f.page) AS b FROM forms f JOIN pg USING (doc, page) GROUP BY f.doc, objid), place AS (SELECT doc, objid, n / total AS frequency, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1, b[5] AS h, b[6] AS area FROM first_ JOIN tot USING (doc)), objs AS (SELECT DISTINCT doc, o AS objid, (doc + o) % 5 > 0 AS has_text FROM pg, range(6) t(o))"
INJECTED = f"{FORMS}, inj AS (SELECT o.doc, o.objid, CASE WHEN frequency IS NULL THEN true ELSE frequency < 0.5 AND NOT (y0 / h <= 0.15 OR (h - y1) / h <= 0.15) AND (x1 - x0) * (y1 - y0) / area >= 0.05 AND has_text END AS injected FROM objs o LEFT JOIN place USING (doc, objid))"


def forms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d, p = F.col("doc"), F.col("page")
    top = 50.0 + (d * 7 + p * 90) % 600
    rows = pages(spark, sf_dir)
    used = rows.where("(doc + page) % 3 > 0 or doc % 2 = 0").select("doc", "page", ((d + p) % 4).alias("objid"), F.lit(20.0).alias("x0"), top.alias("y0"), (20.0 + d * 13 % 500).alias("x1"), (top + d * 3 % 150).alias("y1"))
    objects = rows.select("doc").distinct().withColumn("objid", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("has_text", (d + F.col("objid")) % 5 > 0)
    return objects, structure.placements(used, rows.select("doc", "page", "width", "height"), "doc")


@query(f"WITH {INJECTED} SELECT inj.doc, inj.objid, coalesce(round(frequency, 6), -1) AS frequency, injected FROM inj LEFT JOIN place USING (doc, objid)")
def injected_forms(spark, sf_dir):
    objects, placed = forms(spark, sf_dir)
    return structure.injected(objects, placed, "doc").join(placed.select("doc", "objid", "frequency"), ["doc", "objid"], "left").select("doc", "objid", F.coalesce(F.round("frequency", 6), F.lit(-1.0)).alias("frequency"), "injected")


@query("WITH f AS (SELECT o_orderkey AS k, o_orderkey % 6 AS eof, o_orderkey % 5 AS gen, o_orderkey % 4 AS notes, o_orderkey % 7 AS forms, o_orderkey % 3 AS xrefs, o_orderkey % 4 AS starts, o_orderkey % 2 AS old FROM orders) SELECT k, least(100, least(40, greatest(0, eof - 1) * 15) + least(35, gen * 10) + least(40, notes * 15) + least(30, forms * 10)) AS objects, least(100, least(50, greatest(0, eof - 1) * 20) + CASE WHEN xrefs > 1 AND xrefs <> starts THEN 25 ELSE 0 END + CASE WHEN old > 0 THEN 20 ELSE 0 END) AS incremental FROM f")
def structure_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("k"), structure.fingerprint_score(k % 6, k % 5, k % 4, k % 7).alias("objects"), structure.incremental_score(k % 6, k % 3, k % 4, k % 2).alias("incremental"))


@query("""WITH f AS (SELECT c_custkey AS doc, 1000 AS size, c_custkey % 3 AS eof, c_custkey % 50 AS modified_at FROM customer), s AS (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 7 > 0 THEN 0 END AS start1, CASE WHEN o_orderkey % 7 > 0 THEN 300 END AS length1, CASE WHEN o_orderkey % 7 > 0 THEN 400 END AS start2, CASE WHEN o_orderkey % 7 > 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 600 WHEN 1 THEN 500 ELSE 700 END END AS length2, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 60 END AS signed_at FROM orders WHERE o_custkey % 2 = 0),
r AS (SELECT *, start1 IS NOT NULL AS known, coalesce(start2 + length2 = size, false) AS whole FROM s JOIN f USING (doc)) SELECT doc, count(*) AS n_signatures, CAST(least(100, sum(CASE WHEN known AND NOT whole THEN 60 ELSE 0 END + CASE WHEN known AND size > start2 + length2 THEN 40 ELSE 0 END) + CASE WHEN max(eof) > 1 THEN 50 ELSE 0 END) AS BIGINT) AS shadow, max(CASE WHEN NOT whole THEN 70 WHEN modified_at > signed_at THEN 50 ELSE 0 END) AS signature FROM r GROUP BY doc""")
def signature_scores(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    files = read(spark, sf_dir, "customer").select(c.alias("doc"), F.lit(1000).alias("size"), (c % 3).alias("eof"), (c % 50).alias("modified_at"))
    known = k % 7 > 0
    rows = read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("doc"), F.when(known, 0).alias("start1"), F.when(known, 300).alias("length1"), F.when(known, 400).alias("start2"), F.when(known, F.when(k % 3 == 0, 600).when(k % 3 == 1, 500).otherwise(700)).alias("length2"), F.when(k % 5 > 0, k % 60).alias("signed_at"))
    return structure.signature_scores(rows, files, "doc")


_RASTER = {"weight_sum": "o_orderkey % 7 * 0.6::DOUBLE", "n_regions": "o_orderkey % 7", "n_noise": "o_orderkey % 8", "n_erasure": "o_orderkey % 5", "flat_confidence": "o_orderkey % 4 * 0.75::DOUBLE", "scanned": "o_orderkey % 2 = 0", "is_compiled": "o_orderkey % 4 = 0", "cross_page": "o_orderkey % 31", "objects": "o_orderkey % 23", "incremental": "o_orderkey % 19", "dct": "o_orderkey % 17", "shadow": "o_orderkey % 13", "signature": "o_orderkey % 11"}


@query(
    f"WITH f AS (SELECT o_orderkey AS k, {', '.join(f'{e} AS {n}' for n, e in _RASTER.items())} FROM orders), b AS (SELECT *, least(100, least(70, weight_sum * 15) * CASE WHEN scanned THEN CASE WHEN is_compiled THEN 0.35::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN n_regions < 5 THEN 0.5::DOUBLE ELSE 1 END ELSE 1 END + least(40, n_noise * 8) + least(45, n_erasure * 15) + least(45, flat_confidence * 15)) AS s FROM f) "
    "SELECT k, round(least(100, least(100, least(100, least(100, least(100, least(100, s + cross_page // 2) + objects // 3) + incremental // 2) + dct // 4) + shadow // 2) + signature // 2), 6) AS ela FROM b"
)
def raster_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *[F.expr(e.replace("::DOUBLE", "D")).alias(n) for n, e in _RASTER.items()])
    return structure.raster_score(rows).select("k", F.round("ela", 6).alias("ela"))


@query("WITH f AS (SELECT o_custkey AS doc, ['jpeg', 'edges', 'copy'][o_orderkey % 3 + 1] AS \"check\", (o_orderkey % 10) / 10 AS confidence FROM orders), q AS (SELECT doc, \"check\" AS c, sum(CASE \"check\" WHEN 'jpeg' THEN 25 WHEN 'edges' THEN 12 ELSE 0 END * confidence) AS t FROM f GROUP BY doc, \"check\"), p AS (SELECT doc, least(CASE c WHEN 'jpeg' THEN 40 WHEN 'edges' THEN 30 ELSE 0 END, t) AS s FROM q) SELECT doc, round(least(100, sum(s)), 6) AS score, round(least(100, 30 + least(80, least(100, sum(s)) * 0.6)), 6) AS folded FROM p GROUP BY doc")
def check_scores(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("jpeg", "edges", "copy")])
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.get(names, (F.col("o_orderkey") % 3).cast("int")).alias("check"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))
    out = structure.check_scores(rows, {"jpeg": (25, 40), "edges": (12, 30)}, "doc")
    return out.select("doc", F.round("score", 6).alias("score"), F.round(structure.image_fold(F.lit(30.0), F.col("score")), 6).alias("folded"))


@query("WITH p AS (SELECT o_custkey % 40 AS doc, o_orderkey AS page, 5 + (o_orderkey * 7 % 11) * 0.25::DOUBLE + CASE WHEN o_orderkey % 97 = 0 THEN 30 ELSE 0 END AS noise FROM orders), s AS (SELECT *, count(*) OVER w AS n, avg(noise) OVER w AS m, stddev_samp(noise) OVER w AS d FROM p WINDOW w AS (PARTITION BY doc)) SELECT doc, page, noise, round(abs(noise - m) / d, 4) AS z FROM s WHERE n >= 3 AND d > 0 AND abs(noise - m) / d >= 2.5")
def cross_page_noise(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("doc"), k.alias("page"), (5 + k * 7 % 11 * 0.25 + F.when(k % 97 == 0, 30).otherwise(0)).alias("noise"))
    return structure.cross_page_noise(rows, "doc").withColumn("z", F.round("z", 4))


#: Blocks of pages with statistics by arithmetic; some far off.
BLOCKS = "blocks AS (SELECT l_orderkey // 40 AS page, l_orderkey * 8 + l_linenumber AS ord, 200 + l_orderkey % 56 AS mean, 4 + (l_orderkey * 5 % 13) * 0.5::DOUBLE - CASE WHEN l_orderkey % 29 = 0 THEN 3.9 ELSE 0 END AS std, 2 + (l_orderkey * 3 % 7) * 0.2::DOUBLE + CASE WHEN l_orderkey % 37 = 0 THEN 25 ELSE 0 END AS err, l_linenumber % 3 * 10 + 75 AS quality, l_orderkey % 5 AS br, l_orderkey % 7 AS bc, (l_orderkey % 9) * 0.6::DOUBLE AS z, (l_orderkey * 13 % 500)::DOUBLE AS x0, (l_orderkey * 29 % 700)::DOUBLE AS y0, (l_orderkey * 13 % 500) + 10.0 AS x1, (l_orderkey * 29 % 700) + 10.0 AS y1 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"


def blocks(spark, sf_dir) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    x0, y0 = (k * 13 % 500).cast("double"), (k * 29 % 700).cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.select(F.floor(k / 40).alias("page"), (k * 8 + n).alias("ord"), (200 + k % 56).alias("mean"), (4 + k * 5 % 13 * 0.5 - F.when(k % 29 == 0, 3.9).otherwise(0.0)).alias("std"), (2 + k * 3 % 7 * 0.2 + F.when(k % 37 == 0, 25).otherwise(0)).alias("err"), (n % 3 * 10 + 75).alias("quality"), (k % 5).alias("br"), (k % 7).alias("bc"), (k % 9 * 0.6).alias("z"), x0.alias("x0"), y0.alias("y0"), (x0 + 10).alias("x1"), (y0 + 10).alias("y1"))


@query(f"WITH {BLOCKS}, s AS (SELECT *, count(*) OVER w AS n, avg(err) OVER w AS m, stddev_pop(err) OVER w AS d FROM blocks WINDOW w AS (PARTITION BY page)) SELECT page, ord, round((err - m) / d, 4) AS z FROM s WHERE n >= 10 AND d >= 0.1 AND (err - m) / d >= 3.5")
def block_outliers(spark, sf_dir):
    return structure.block_outliers(blocks(spark, sf_dir).drop("z"), ["page"], "err", 10, 3.5, 0.1, above=True).select("page", "ord", F.round("z", 4).alias("z"))


@query(f"WITH {BLOCKS}, m AS (SELECT page, median(std) AS mid FROM blocks WHERE mean >= 220 GROUP BY page HAVING count(*) >= 10 AND median(std) >= 3) SELECT page, ord, round(std, 4) AS std FROM blocks JOIN m USING (page) WHERE mean >= 220 AND std < 0.2 * mid")
def erased_blocks(spark, sf_dir):
    return structure.erased_blocks(blocks(spark, sf_dir), ["page"], 220).select("page", "ord", F.round("std", 4).alias("std"))


@query(f"WITH {BLOCKS} SELECT page, br, bc, count(DISTINCT quality) AS n, round(avg(z), 6) AS z, round(avg(err), 6) AS err FROM blocks WHERE z > 3 GROUP BY page, br, bc HAVING count(DISTINCT quality) >= 2")
def agreed_blocks(spark, sf_dir):
    return structure.agreed_blocks(blocks(spark, sf_dir), ["page"]).select("page", "br", "bc", "n", F.round("z", 6).alias("z"), F.round("err", 6).alias("err"))


@query(f"WITH {BLOCKS} SELECT page, ord FROM blocks a WHERE ord % 3 = 0 AND EXISTS (SELECT 1 FROM blocks b WHERE b.ord % 3 > 0 AND b.page = a.page AND a.x0 - 3 < b.x1 AND a.x1 + 3 > b.x0 AND a.y0 - 3 < b.y1 AND a.y1 + 3 > b.y0)")
def confirmed_regions(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    return structure.confirmed(rows.where("ord % 3 = 0"), rows.where("ord % 3 > 0"), ["page"]).select("page", "ord")


@query(f"WITH {BLOCKS} SELECT page, ord FROM blocks a WHERE ord % 3 = 0 AND (page % 2 = 0 OR EXISTS (SELECT 1 FROM blocks b WHERE b.ord % 3 > 0 AND b.page = a.page AND a.x0 - 3 < b.x1 AND a.x1 + 3 > b.x0 AND a.y0 - 3 < b.y1 AND a.y1 + 3 > b.y0))")
def raster_regions(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    has = rows.select("page").distinct().withColumn("has_text", F.col("page") % 2 > 0)
    return structure.raster_regions(rows.where("ord % 3 = 0"), rows.where("ord % 3 > 0"), has, ["page"]).select("page", "ord")


@query(f"WITH RECURSIVE {BLOCKS}, e AS (SELECT a.page, a.ord AS a, b.ord AS b FROM blocks a JOIN blocks b ON a.page = b.page AND a.ord <> b.ord AND a.x0 - 2 <= b.x1 + 2 AND a.x1 + 2 >= b.x0 - 2 AND a.y0 - 2 <= b.y1 + 2 AND a.y1 + 2 >= b.y0 - 2), r(page, v, m) AS (SELECT DISTINCT page, a, a FROM e UNION SELECT r.page, e.b, m FROM r JOIN e ON e.page = r.page AND e.a = r.v), c AS (SELECT page, v, min(m) AS component FROM r GROUP BY page, v) SELECT c.page, component, count(*) AS n_blocks, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c JOIN blocks ON blocks.page = c.page AND ord = v GROUP BY c.page, component HAVING count(*) >= 3")
def block_clusters(spark, sf_dir):
    return structure.block_clusters(blocks(spark, sf_dir), ["page"])


# ---------------------------------------------------------------- drawing

#: The fold of a page's boxes: each goes into the first group that it meets, whose box grows.
MERGED = f"""{PSPANS}, bx AS (SELECT doc, page, ord, CASE WHEN ord % 3 = 0 THEN 'replaced' ELSE 'missing' END AS kind, 't' || ord % 5 AS t, x0, y0, x1 + 30 AS x1, y1 + 20 AS y1, row_number() OVER (PARTITION BY doc, page ORDER BY ord) AS r FROM pspans WHERE seqno < 12),
st(doc, page, r, gs) AS (SELECT doc, page, 0::BIGINT, [{{'kind': '', 'texts': ['']::VARCHAR[], 'x0': 0.0::DOUBLE, 'y0': 0.0::DOUBLE, 'x1': 0.0::DOUBLE, 'y1': 0.0::DOUBLE}}][1:0] FROM bx GROUP BY doc, page
  UNION ALL SELECT doc, page, r, CASE WHEN spot IS NULL THEN list_append(gs, {{'kind': kind, 'texts': [t]::VARCHAR[], 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) ELSE list_concat(gs[1:spot - 1], [{{'kind': CASE WHEN kind = 'replaced' THEN 'replaced' ELSE gs[spot].kind END, 'texts': CASE WHEN list_contains(gs[spot].texts, t) THEN gs[spot].texts ELSE list_append(gs[spot].texts, t) END, 'x0': least(gs[spot].x0, x0), 'y0': least(gs[spot].y0, y0), 'x1': greatest(gs[spot].x1, x1), 'y1': greatest(gs[spot].y1, y1)}}], gs[spot + 1:len(gs)]) END
  FROM (SELECT b.doc, b.page, b.r, gs, b.kind, b.t, b.x0, b.y0, b.x1, b.y1, list_position(list_transform(gs, lambda g: b.x0 < g.x1 AND b.x1 > g.x0 AND b.y0 < g.y1 AND b.y1 > g.y0), true) AS spot FROM st JOIN bx b ON b.doc = st.doc AND b.page = st.page AND b.r = st.r + 1)),
fin AS (SELECT doc, page, last(gs ORDER BY r) AS gs FROM st GROUP BY doc, page), mg AS (SELECT doc, page, generate_subscripts(gs, 1) - 1 AS grp, unnest(gs, recursive := true) FROM fin)"""


def auth_boxes(spark, sf_dir) -> DataFrame:
    o = F.col("ord")
    rows = page_spans(spark, sf_dir).where("seqno < 12")
    return rows.select("doc", "page", "ord", F.when(o % 3 == 0, "replaced").otherwise("missing").alias("kind"), F.array(F.concat(F.lit("t"), (o % 5).cast("string"))).alias("texts"), "x0", "y0", (F.col("x1") + 30).alias("x1"), (F.col("y1") + 20).alias("y1"))


@query(f"WITH RECURSIVE {MERGED} SELECT doc, page, grp, kind, array_to_string(texts, ',') AS texts, x0, y0, x1, y1 FROM mg")
def merged_boxes(spark, sf_dir):
    return drawing.merged_boxes(auth_boxes(spark, sf_dir), "doc").withColumn("texts", F.array_join("texts", ","))


@query(f"WITH RECURSIVE {MERGED}, fs AS (SELECT doc, page, CASE ord % 2 WHEN 0 THEN 'ela' ELSE 'content' END AS layer, ord, x0, y0, x1, y1 FROM pspans WHERE seqno >= 12), hit AS (SELECT a.doc, a.page, a.layer, a.ord, min(b.grp) AS grp FROM fs a JOIN mg b ON a.doc = b.doc AND a.page = b.page AND {HIT} GROUP BY ALL) SELECT mg.doc, mg.page, mg.grp, coalesce(string_agg(DISTINCT layer, ',' ORDER BY layer), '') AS also, count(layer) AS n FROM mg LEFT JOIN hit USING (doc, page, grp) GROUP BY ALL")
def absorbed_findings(spark, sf_dir):
    found = page_spans(spark, sf_dir).where("seqno >= 12").withColumn("layer", F.when(F.col("ord") % 2 == 0, "ela").otherwise("content")).select("doc", "page", "layer", "ord", "x0", "y0", "x1", "y1")
    boxes = drawing.merged_boxes(auth_boxes(spark, sf_dir), "doc")
    left, flagged = drawing.absorbed(found, boxes, "doc")
    taken = found.join(left, ["doc", "page", "layer", "ord"], "left_anti")
    # how many went into each box, by the same first box
    met = taken.alias("a").join(boxes.alias("b"), ["doc", "page"]).where("a.x0 < b.x1 and a.x1 > b.x0 and a.y0 < b.y1 and a.y1 > b.y0").groupBy("doc", "page", "layer", "ord").agg(F.min("grp").alias("grp")).groupBy("doc", "page", "grp").agg(F.count("*").alias("n"))
    return flagged.join(met, ["doc", "page", "grp"], "left").select("doc", "page", "grp", F.array_join("also_flagged_by", ",").alias("also"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {PSPANS} SELECT doc, page + 1 AS page, ord, CASE ord % 3 WHEN 0 THEN 'Line ' || (ord % 9 + 1) || ': ' || CASE ord % 2 WHEN 0 THEN 'Font Size Mismatch' ELSE 'Abnormal Line Gap' END WHEN 1 THEN CASE ord % 4 WHEN 0 THEN 'Balance Mismatch' WHEN 1 THEN 'Arithmetic Inconsistency' ELSE 'Statistical Outlier (z=' || (ord % 10) || '.5)' END ELSE CASE ord % 2 WHEN 0 THEN 'Ghost Text (Layered)' ELSE 'other' END END AS label, CASE ord % 3 WHEN 0 THEN '255,50,50' WHEN 1 THEN '255,220,0' ELSE CASE ord % 2 WHEN 0 THEN '255,200,0' END END AS colour, CAST(floor(x0 * (150 / 72::DOUBLE)) AS INT) - 4 AS x0, CAST(floor(y1 * (150 / 72::DOUBLE)) AS INT) + 4 AS y1 FROM pspans")
def boxes_to_draw(spark, sf_dir):
    o = F.col("ord")
    rows = page_spans(spark, sf_dir).withColumns(
        {
            "layer": F.when(o % 3 == 0, "content").when(o % 3 == 1, "numeric").otherwise("pymupdf"),
            "kind": F.when(o % 3 == 2, F.when(o % 2 == 0, "ghost_text").otherwise("other")),
            "line": o % 9,
            "reason": F.when(o % 3 == 0, F.when(o % 2 == 0, "font_size").otherwise("line_gap")).when(o % 3 == 2, F.when(o % 2 == 0, "ghost_text").otherwise("other")),
            "context": F.when(o % 4 == 0, "running_balance").when(o % 4 == 1, "arithmetic_x").otherwise("column"),
            "z": o % 10 + 0.5,
        }
    )
    return drawing.boxes_to_draw(rows, "doc").select("doc", "page", "ord", "label", "colour", "x0", "y1")


@query(f"WITH RECURSIVE {PSPANS}, l AS (SELECT doc, page, list({{'ord': ord, 'x0': x0, 'y0': y0}} ORDER BY ord) AS held FROM pspans GROUP BY doc, page), s(doc, page, grp, held, got) AS (SELECT doc, page, -1, held, held[1:0] FROM l UNION ALL SELECT doc, page, grp + 1, list_filter(held, lambda x: (x.x0 - held[1].x0) ** 2 + (x.y0 - held[1].y0) ** 2 >= 3600), list_filter(held, lambda x: (x.x0 - held[1].x0) ** 2 + (x.y0 - held[1].y0) ** 2 < 3600) FROM s WHERE len(held) > 0), o AS (SELECT doc, page, grp, unnest(got, recursive := true) FROM s WHERE grp >= 0) SELECT doc, page, ord, grp FROM o")
def anchor_groups(spark, sf_dir):
    return drawing.anchors(page_spans(spark, sf_dir), ["doc", "page"], "ord", 60.0)


# ---------------------------------------------------------------- descriptions and places


@query("WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 > 0 THEN to_timestamp(1700000000 - (o_orderkey * o_orderkey % 7000) * 5000) AT TIME ZONE 'UTC' END AS at_, (o_orderkey * o_orderkey % 7000) * 5000 AS s FROM orders) SELECT k, strftime(at_, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, strftime(at_, '%B %d, %Y at %I:%M %p') AS human, CASE WHEN at_ IS NOT NULL THEN s // 86400 ELSE -1 END AS age_days, CASE WHEN at_ IS NULL THEN NULL WHEN s // 86400 = 0 THEN CASE WHEN s // 3600 > 0 THEN s // 3600 || ' hours ago' ELSE 'Just now' END WHEN s // 86400 < 7 THEN s // 86400 || CASE WHEN s // 86400 > 1 THEN ' days ago' ELSE ' day ago' END WHEN s // 86400 < 30 THEN s // 86400 // 7 || CASE WHEN s // 86400 // 7 > 1 THEN ' weeks ago' ELSE ' week ago' END WHEN s // 86400 < 365 THEN s // 86400 // 30 || CASE WHEN s // 86400 // 30 > 1 THEN ' months ago' ELSE ' month ago' END ELSE s // 86400 // 365 || CASE WHEN s // 86400 // 365 > 1 THEN ' years ago' ELSE ' year ago' END END AS relative FROM a")
def described_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    at = F.when(k % 9 > 0, F.timestamp_seconds(1_700_000_000 - k * k % 7000 * 5000))
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), dates.described(at, F.timestamp_seconds(F.lit(1_700_000_000))).alias("d"))
    return rows.select("k", F.col("d.iso8601").alias("iso"), "d.human", F.coalesce("d.age_days", F.lit(-1)).alias("age_days"), "d.relative")


@query(f"WITH {PSPANS} SELECT doc, page, ord, row_number() OVER (PARTITION BY doc, page ORDER BY round_even(y0 / 4, 0) * 4, x0, ord) AS place FROM pspans")
def reading_order(spark, sf_dir):
    return routing.reading_order(page_spans(spark, sf_dir).withColumn("top", F.col("y0")), ["doc", "page"]).select("doc", "page", "ord", "place")


@query(f"WITH {PSPANS}, r AS (SELECT doc, page, rank() OVER (PARTITION BY doc, page ORDER BY seqno) + (count(*) OVER (PARTITION BY doc, page, seqno) - 1) / 2.0 AS paint, rank() OVER (PARTITION BY doc, page ORDER BY y0) + (count(*) OVER (PARTITION BY doc, page, y0) - 1) / 2.0 AS seen FROM pspans), c AS (SELECT doc, page, corr(paint, seen) AS rho FROM r GROUP BY doc, page HAVING count(*) >= 3) SELECT doc, round(avg(rho), 6) AS mean_rho FROM c GROUP BY doc")
def mean_correlations(spark, sf_dir):
    def ranks(c):
        tied = F.count("*").over(Window.partitionBy("doc", "page", c))
        return F.rank().over(Window.partitionBy("doc", "page").orderBy(c)) + (tied - 1) / 2

    rows = page_spans(spark, sf_dir).select("doc", "page", ranks("seqno").alias("paint"), ranks("y0").alias("seen"))
    each = rows.groupBy("doc", "page").agg(F.count("*").alias("n"), F.corr("paint", "seen").alias("rho")).where("n >= 3")
    return each.groupBy("doc").agg(F.round(F.avg("rho"), 6).alias("mean_rho"))


_AREA = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"WITH {PSPANS} SELECT doc, page, ord, EXISTS (SELECT 1 FROM pspans b WHERE b.ord % 4 = 1 AND b.doc = a.doc AND b.page = a.page AND {HIT}) AS sharp, EXISTS (SELECT 1 FROM pspans b WHERE b.ord % 4 = 2 AND b.doc = a.doc AND b.page = a.page AND {HIT} AND {_AREA} >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0)) AS stamp_associated FROM pspans a WHERE ord % 4 = 0")
def region_flags(spark, sf_dir):
    rows = page_spans(spark, sf_dir)
    on = ["doc", "page"]
    found = structure.associated(rows.where("ord % 4 = 0"), rows.where("ord % 4 = 1"), on, "sharp")
    return structure.stamped(found, rows.where("ord % 4 = 2"), on).select("doc", "page", "ord", "sharp", "stamp_associated")


@query(f"WITH {PSPANS}, f AS (SELECT doc, page, ord, x0 + 5 * (x1 - x0) / (ord % 50 + 60) AS px0, y0 + 3 * (y1 - y0) / (ord % 40 + 50) AS py0, x0 + 25 * (x1 - x0) / (ord % 50 + 60) AS px1, y0 + 13 * (y1 - y0) / (ord % 40 + 50) AS py1, (x1 - x0) / (y1 - y0) BETWEEN 0.8 AND 1.2 OR (x1 - x0) / (y1 - y0 + 20) BETWEEN 0.8 AND 1.2 AND (x1 - x0) * (y1 - y0 + 20) < 0.15 * 6000 AS code FROM pspans) SELECT doc, page, ord, round(px0, 6) AS x0, round(py0, 6) AS y0, round(px1, 6) AS x1, round(py1, 6) AS y1, greatest(8, CAST(round_even((ord % 600) * 12.0 / 72, 0) AS INT)) AS block, code FROM f")
def pixel_places(spark, sf_dir):
    o = F.col("ord")
    rows = page_spans(spark, sf_dir)
    place = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    points = geometry.pixel_box((F.lit(5), F.lit(3), F.lit(20), F.lit(10)), (o % 50 + 60, o % 40 + 50), place)
    tall = (place[0], place[1], place[2], place[3] + 20)
    code = geometry.code_shaped(place, F.lit(1e9)) | geometry.code_shaped(tall, F.lit(6000.0))
    return rows.select("doc", "page", "ord", *[F.round(p, 6).alias(n) for p, n in zip(points, ("x0", "y0", "x1", "y1"))], geometry.block_pixels(o % 600, 12.0).alias("block"), code.alias("code"))


@query(f"WITH {META} SELECT doc_id, nullif(producer, '') AS producer, nullif(author, '') AS author, CASE WHEN delta_seconds < 120 THEN CAST(round_even(delta_seconds, 0) AS INT) || ' seconds' WHEN delta_seconds IS NOT NULL THEN CAST(round(delta_seconds / 60, 1) AS DECIMAL(10, 1)) || ' minutes' END AS interval_ FROM named WHERE delta_seconds IS NULL OR delta_seconds <> 0.5")
def full_metadata(spark, sf_dir):
    held = routing.full_metadata(named(spark, sf_dir).where("delta_seconds is null or delta_seconds <> 0.5"), "doc_id")
    return held.select("doc_id", "metadata.producer", "metadata.author", F.col("metadata.modification_interval").alias("interval_"))
