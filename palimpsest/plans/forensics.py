"""The library's operators on the driver's tables, through derived views, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import clean_number, field_type
from ..operators import cluster, layers, outliers, spatial, verdicts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- views

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]


def numbers(spark, sf_dir) -> DataFrame:
    """grp, page, line, value, ord: prices of a part; ord counts within the part."""
    rows = read(spark, sf_dir, "lineitem").select(*ORDER)
    order = Window.partitionBy("l_partkey").orderBy(*ORDER)
    return rows.select(F.col("l_partkey").alias("grp"), F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("line"), F.col("l_extendedprice").alias("value"), F.row_number().over(order).alias("ord"))


NUMBERS = f"numbers AS (SELECT l_partkey AS grp, l_suppkey AS page, l_orderkey AS line, l_extendedprice AS value, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(ORDER)}) AS ord FROM lineitem)"


def spans(spark, sf_dir) -> DataFrame:
    """page, ord, text, box, seqno: orders laid out on pages."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x0, y0 = ((c * 37 + o * 11) % 500).cast("double"), ((o * 13 + c * 7) % 700).cast("double")
    return read(spark, sf_dir, "orders").select(F.floor(o / 75).alias("page"), o.alias("ord"), F.concat(F.lit("T"), (c % 50).cast("string")).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + o % 41).alias("x1"), (y0 + 12).alias("y1"), (o % 17).alias("seqno"))


SPANS = "spans AS (SELECT o_orderkey // 75 AS page, o_orderkey AS ord, 'T' || CAST(o_custkey % 50 AS VARCHAR) AS text, CAST((o_custkey * 37 + o_orderkey * 11) % 500 AS DOUBLE) AS x0, CAST((o_orderkey * 13 + o_custkey * 7) % 700 AS DOUBLE) AS y0, CAST((o_custkey * 37 + o_orderkey * 11) % 500 AS DOUBLE) + 20 + o_orderkey % 41 AS x1, CAST((o_orderkey * 13 + o_custkey * 7) % 700 AS DOUBLE) + 12 AS y1, o_orderkey % 17 AS seqno FROM orders)"
MEET = "least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS smaller"


def lines(spark, sf_dir) -> DataFrame:
    """doc_id, line, text."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"


def words(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line", F.posexplode(F.split("text", " ")).alias("i", "word")).where("word <> ''")


WORDS = LINES + ", words AS (SELECT doc_id, line, i, word FROM (SELECT doc_id, line, generate_subscripts(string_split(text, ' '), 1) - 1 AS i, unnest(string_split(text, ' ')) AS word FROM lines) WHERE word <> '')"


def layer_scores(spark, sf_dir) -> DataFrame:
    """doc_id, pdf_type, five scores, cleared, was_modified, suspicion, flags: by arithmetic on documents."""
    d = F.col("doc_id")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "native_text", "de", "scanned", "fr", "mixed", "es", "scanned_native")]), F.col("lang"))
    score = lambda a, b: ((d * a + b) % 61).cast("int")
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(kind, F.lit("native_text")).alias("pdf_type"), score(7, 3).alias("metadata"), score(11, 5).alias("content"), score(13, 1).alias("numeric"), score(17, 9).alias("ela"), score(19, 2).alias("pymupdf"), (d % 3 == 0).alias("cleared"), (d % 2 == 0).alias("was_modified"), F.when(d % 5 < 2, "UNKNOWN").otherwise("LOW").alias("suspicion"), (d % 7 == 0).alias("xmp_mismatch"), (d % 11 == 0).alias("multiple_producers"), (d % 13 == 0).alias("stripped"), ((d * 29) % 200).alias("delta_seconds"))


SCORES = "scores AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'scanned' WHEN 'fr' THEN 'mixed' WHEN 'es' THEN 'scanned_native' ELSE 'native_text' END AS pdf_type, (doc_id * 7 + 3) % 61 AS metadata, (doc_id * 11 + 5) % 61 AS content, (doc_id * 13 + 1) % 61 AS numeric_, (doc_id * 17 + 9) % 61 AS ela, (doc_id * 19 + 2) % 61 AS pymupdf, doc_id % 3 = 0 AS cleared, doc_id % 2 = 0 AS was_modified, CASE WHEN doc_id % 5 < 2 THEN 'UNKNOWN' ELSE 'LOW' END AS suspicion, doc_id % 7 = 0 AS xmp_mismatch, doc_id % 11 = 0 AS multiple_producers, doc_id % 13 = 0 AS stripped, (doc_id * 29) % 200 AS delta_seconds FROM documents)"
COMBINED = (
    SCORES
    + """, w(pdf_type, a, b, c, d, e) AS (VALUES ('native_text', 0.20, 0.35, 0.20, 0.15, 0.10), ('scanned', 0.15, 0.05, 0.10, 0.50, 0.20), ('mixed', 0.20, 0.20, 0.15, 0.30, 0.15), ('scanned_native', 0.20, 0.10, 0.15, 0.35, 0.20)),
raw AS (SELECT scores.*, metadata * CAST(a AS DOUBLE) + content * CAST(b AS DOUBLE) + numeric_ * CAST(c AS DOUBLE) + ela * CAST(d AS DOUBLE) + pymupdf * CAST(e AS DOUBLE) AS score,
  CASE WHEN cleared AND was_modified AND suspicion = 'UNKNOWN' THEN greatest(12, CASE pdf_type WHEN 'scanned' THEN 25 ELSE 20 END - 8) ELSE CASE pdf_type WHEN 'scanned' THEN 25 ELSE 20 END END AS threshold FROM scores JOIN w USING (pdf_type)),
combined AS (SELECT * EXCLUDE (t), CASE WHEN abs(score - threshold) <= 5 THEN 'UNCERTAIN' WHEN score >= threshold THEN 'MODIFIED' ELSE 'ORIGINAL' END AS verdict, least(99, 50 + CAST(trunc(abs(score - threshold) * CAST(1.8 AS DOUBLE)) AS INT)) AS confidence, CAST(floor(t) + CASE WHEN t - floor(t) > 0.5 OR (t - floor(t) = 0.5 AND floor(t) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10 AS combined FROM (SELECT *, CAST(CAST(score AS VARCHAR) AS DECIMAL(20, 15)) * 10 AS t FROM raw))"""
)


def combined(spark, sf_dir) -> DataFrame:
    return verdicts.combine(layer_scores(spark, sf_dir))


# ---------------------------------------------------------------- queries

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LEFT_OUT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value, ord) AS r, list(value) OVER (PARTITION BY {keys} ORDER BY value, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS held FROM {rows}),
others AS (SELECT *, len(held) AS n, list_concat(held[1:r - 1], held[r + 1:len(held)]) AS rest FROM ranked),
kept AS (SELECT *, CASE WHEN len(rest) <= 2 OR len(rest) - 2 * greatest(1, len(rest) // 10) < 2 THEN rest ELSE rest[greatest(1, len(rest) // 10) + 1:len(rest) - greatest(1, len(rest) // 10)] END AS k FROM others WHERE len(rest) >= 2),
z AS (SELECT *, abs(value - list_avg(k)) / greatest(list_stddev_samp(k), 0.01) AS z FROM kept)"""
FOUND = f"{NUMBERS}, {LEFT_OUT.format(keys='grp', rows='numbers')}, found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, page, line ORDER BY ord) AS f FROM z WHERE n >= 4 AND z >= 3) WHERE f = 1)"


def found_outliers(spark, sf_dir) -> DataFrame:
    return outliers.outliers(numbers(spark, sf_dir), ["grp"], ["ord"], ["page", "line"])


@query(f"WITH {FOUND} SELECT grp, page, line, ord, value, n, round(z, 4) AS z, CASE WHEN z >= 5 THEN 'extreme' ELSE 'high' END AS severity FROM found")
def loo_zscore_outliers(spark, sf_dir):
    rows = found_outliers(spark, sf_dir)
    return rows.select("grp", "page", "line", "ord", "value", "n", F.round("z", 4).alias("z"), F.when(F.col("z") >= 5, "extreme").otherwise("high").alias("severity"))


@query(f"WITH {NUMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, ord) AS r, count(*) OVER (PARTITION BY grp) AS n FROM numbers), t AS (SELECT a.grp, a.ord, a.value, b.value AS max_other FROM r a JOIN r b ON a.grp = b.grp AND a.r = 1 AND b.r = 2 WHERE a.n >= 3) SELECT grp, ord, value, max_other, round(value / max_other, 6) AS ratio, value / max_other >= 10 AS flagged FROM t WHERE max_other > 0 AND value / max_other >= 1.1")
def magnitude_ratio(spark, sf_dir):
    rows = outliers.magnitude_ratios(numbers(spark, sf_dir), ["grp"], ["ord"], 1.1)
    return rows.select("grp", "ord", "value", "max_other", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= outliers.RATIO_LEAST).alias("flagged"))


@query(f"WITH {NUMBERS}, big AS (SELECT *, ord - 1 AS i, count(*) OVER (PARTITION BY grp) AS size FROM numbers), wins AS (SELECT big.*, win FROM big, unnest(generate_series(0, (size - 10) // 5)) AS s(win) WHERE size > 30 AND win * 5 <= size - 10 AND i >= win * 5 AND i < win * 5 + 10), {LEFT_OUT.format(keys='grp, win', rows='wins')}, h AS (SELECT *, row_number() OVER (PARTITION BY grp, page, line ORDER BY win, ord) AS f FROM z WHERE z >= 2.5) SELECT grp, page, line, ord, CAST(win AS BIGINT) AS win, value, round(z, 4) AS z FROM h WHERE f = 1")
def rolling_window_outliers(spark, sf_dir):
    rows = outliers.rolling(numbers(spark, sf_dir), ["grp"], ["ord"], ["page", "line"])
    return rows.select("grp", "page", "line", "ord", "win", "value", F.round("z", 4).alias("z"))


@query(f"WITH {FOUND}, c AS (SELECT grp, ord, z, page % 4 AS page, line // 64 AS line FROM found) SELECT grp, page, line, ord, count(*) OVER (PARTITION BY page, line) > 1 AS boosted, round(z + CASE WHEN count(*) OVER (PARTITION BY page, line) > 1 THEN 15 ELSE 0 END, 4) AS z FROM c")
def cross_column_boost(spark, sf_dir):
    rows = found_outliers(spark, sf_dir).withColumn("page", F.col("page") % 4).withColumn("line", F.floor(F.col("line") / 64))
    return outliers.boosted(rows, ["page", "line"]).select("grp", "page", "line", "ord", "boosted", F.round("z", 4).alias("z"))


@query(f"WITH {FOUND}, r AS (SELECT page % 5 AS doc, grp, ord, z, row_number() OVER (PARTITION BY page % 5 ORDER BY round(z, 6) DESC, grp, ord) AS rank FROM found) SELECT doc, grp, ord, round(z, 4) AS z, rank FROM r WHERE rank <= 10")
def reported_numbers(spark, sf_dir):
    rows = found_outliers(spark, sf_dir).withColumn("doc", F.col("page") % 5)
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.round("z", 6)), "grp", "ord"))
    return rows.withColumn("rank", rank).where("rank <= 10").select("doc", "grp", "ord", F.round("z", 4).alias("z"), "rank")


@query(f"WITH {FOUND}, c AS (SELECT page, count(*) FILTER (round_even(z, 2) >= 5) AS n_extreme, count(*) FILTER (round_even(z, 2) >= 3 AND round_even(z, 2) < 5) AS n_high FROM found GROUP BY page) SELECT page, n_extreme, n_high, CAST(least(100, least(60, 20 * n_extreme) + least(30, 10 * n_high)) AS BIGINT) AS score FROM c")
def numeric_layer_score(spark, sf_dir):
    return outliers.layer_score(found_outliers(spark, sf_dir), ["page"])


LEDGER = "flow AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'click') THEN round(abs(value), 2) END AS withdrawal, CASE WHEN event_type IN ('signup', 'view') THEN round(abs(value), 2) END AS deposit FROM events), ledger AS (SELECT *, round(1000 + sum(coalesce(deposit, 0) - coalesce(withdrawal, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + CASE WHEN event_id % 97 = 0 THEN 50 ELSE 0 END, 2) AS balance FROM flow)"


def ledger(spark, sf_dir) -> DataFrame:
    amount = F.round(F.abs("value"), 2)
    flow = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("purchase", "click"), amount).alias("withdrawal"), F.when(F.col("event_type").isin("signup", "view"), amount).alias("deposit"))
    total = F.sum(F.coalesce("deposit", F.lit(0.0)) - F.coalesce("withdrawal", F.lit(0.0))).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return flow.withColumn("balance", F.round(1000 + total + F.when(F.col("event_id") % 97 == 0, 50).otherwise(0), 2))


@query(f"WITH {LEDGER}, b AS (SELECT *, lag(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ledger), e AS (SELECT *, prev - coalesce(withdrawal, 0) + coalesce(deposit, 0) AS expected FROM b WHERE prev IS NOT NULL) SELECT user_id, event_id, round(expected, 2) AS expected, balance, round(abs(expected - balance), 2) AS diff, round(abs(expected - balance) / greatest(balance, 1.0) * 100, 4) AS diff_pct, CASE WHEN abs(expected - balance) > 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM e WHERE abs(expected - balance) > 1")
def running_balance(spark, sf_dir):
    rows = outliers.running_balance(ledger(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", F.round("expected", 2).alias("expected"), "balance", F.round("diff", 2).alias("diff"), F.round("diff_pct", 4).alias("diff_pct"), "confidence")


@query(f"WITH {SPANS}, m AS (SELECT a.page, a.ord AS a_ord, b.ord AS b_ord, a.text AS a_text, b.text AS b_text, {MEET} FROM spans a JOIN spans b ON a.page = b.page AND a.ord < b.ord AND a.text <> b.text) SELECT page, a_ord, b_ord, a_text, b_text, round(w * h / smaller, 6) AS overlap FROM m WHERE w > 0 AND h > 0 AND w * h / smaller >= 0.5")
def stacked_text_pairs(spark, sf_dir):
    rows = spatial.stacked_pairs(spans(spark, sf_dir), ["page"])
    return rows.select("page", "a_ord", "b_ord", "a_text", "b_text", F.round("overlap", 6).alias("overlap"))


@query(f"WITH RECURSIVE {SPANS}, m AS (SELECT a.page, a.ord AS a, b.ord AS b, {MEET} FROM spans a JOIN spans b ON a.page = b.page AND a.ord < b.ord AND a.text <> b.text), e AS (SELECT a, b FROM m WHERE w > 0 AND h > 0 AND w * h / smaller >= 0.5), both_ AS (SELECT a AS v, b AS w FROM e UNION SELECT b, a FROM e), reach(v, r) AS (SELECT v, v FROM both_ UNION SELECT both_.w, r FROM reach JOIN both_ ON reach.v = both_.v), c AS (SELECT v, min(r) AS component FROM reach GROUP BY v), t AS (SELECT component, text, count(*) AS n, min(v) AS first FROM c JOIN spans ON ord = v GROUP BY component, text), s AS (SELECT component, CAST(sum(n) AS BIGINT) AS n_members, string_agg(text, ',' ORDER BY first) AS texts FROM t GROUP BY component HAVING count(*) >= 2), best AS (SELECT c.component, first(m.a ORDER BY w * h / smaller DESC, m.a, m.b) AS a, first(m.b ORDER BY w * h / smaller DESC, m.a, m.b) AS b, max(w * h / smaller) AS overlap FROM m JOIN c ON c.v = m.a WHERE w > 0 AND h > 0 AND w * h / smaller >= 0.5 GROUP BY c.component) SELECT component, n_members, texts, a, b, round(overlap, 6) AS overlap FROM s JOIN best USING (component)")
def stacked_components(spark, sf_dir):
    rows = spans(spark, sf_dir)
    found = cluster.stacks(rows, spatial.stacked_pairs(rows, ["page"]), ["page"])
    return found.select("component", "n_members", F.array_join("texts", ",").alias("texts"), "a", "b", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {SPANS}, m AS (SELECT a.page, a.ord AS a_ord, b.ord AS b_ord, {MEET} FROM spans a JOIN spans b ON a.page = b.page AND a.ord < b.ord AND a.text <> b.text) SELECT page, a_ord, b_ord, round(w * h / smaller, 6) AS overlap FROM m WHERE w > 5 AND h > 5 AND w * h / smaller > 0.3")
def ghost_text(spark, sf_dir):
    return spatial.ghosts(spans(spark, sf_dir), ["page"], 612.0 * 792.0).select("page", "a_ord", "b_ord", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {SPANS}, m AS (SELECT a.page, a.ord, b.ord AS b_ord, {MEET}, (b.x1 - b.x0) * (b.y1 - b.y0) AS area FROM spans a JOIN spans b ON a.page = b.page AND a.ord % 3 = 0 AND b.ord % 3 <> 0 AND b.seqno < a.seqno) SELECT page, ord, count(*) AS n_covered, min(b_ord) AS first_covered FROM m WHERE w > 0 AND h > 0 AND w * h >= 0.4 * area GROUP BY page, ord")
def paint_order_cover(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return spatial.covered(rows.where("ord % 3 <> 0"), rows.where("ord % 3 = 0"), ["page"])


@query(f"WITH {SPANS}, k AS (SELECT page // 200 AS sheet, ord, text, first(trim(text, ' ')) OVER k AS first_text, first(ord) OVER k AS first_ord FROM spans WINDOW k AS (PARTITION BY page // 200, x0, y0, x1, y1 ORDER BY ord)) SELECT sheet, ord, text, first_ord, first_text FROM k WHERE text <> first_text")
def coordinate_overwrite(spark, sf_dir):
    rows = spans(spark, sf_dir).withColumn("sheet", F.floor(F.col("page") / 200))
    return spatial.overwritten(rows, ["sheet"]).select("sheet", "ord", "text", "first_ord", "first_text")


@query(f"WITH {SPANS}, k AS (SELECT *, round_even((y0 + y1) / 4, 0) * 2 AS y_key FROM spans) SELECT a.page, a.ord AS a_ord, b.ord AS b_ord FROM k a JOIN k b ON a.page = b.page AND a.y_key = b.y_key AND a.ord < b.ord AND a.text <> b.text WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5 OR abs(a.x0 - b.x0) < 5")
def ybucket_overlap(spark, sf_dir):
    return spatial.y_buckets(spans(spark, sf_dir), ["page"]).select("page", "a_ord", "b_ord")


@query(f"WITH {SPANS} SELECT page, ord FROM spans a WHERE ord % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.page = a.page AND b.ord % 10 = 0 AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0)")
def qr_antijoin(spark, sf_dir):
    rows = spans(spark, sf_dir)
    return spatial.outside(rows.where("ord % 10 <> 0"), rows.where("ord % 10 = 0"), ["page"]).select("page", "ord")


@query(f"WITH RECURSIVE {SPANS}, o AS (SELECT page, ord, x0, row_number() OVER (PARTITION BY page ORDER BY x0, ord) AS r FROM spans), f AS (SELECT page, ord, x0, r, x0 AS start, 0 AS cluster FROM o WHERE r = 1 UNION ALL SELECT o.page, o.ord, o.x0, o.r, CASE WHEN o.x0 - f.start > 40 THEN o.x0 ELSE f.start END, f.cluster + CASE WHEN o.x0 - f.start > 40 THEN 1 ELSE 0 END FROM f JOIN o ON o.page = f.page AND o.r = f.r + 1) SELECT page, ord, x0, cluster FROM f")
def column_clusters(spark, sf_dir):
    return cluster.start_clusters(spans(spark, sf_dir), ["page"], "x0", "ord", 40)


@query(f"WITH RECURSIVE {SPANS}, o AS (SELECT page, ord, y0, row_number() OVER (PARTITION BY page ORDER BY y0, ord) AS r FROM spans), f AS (SELECT page, ord, y0, r, y0 AS start, 0 AS cluster FROM o WHERE r = 1 UNION ALL SELECT o.page, o.ord, o.y0, o.r, CASE WHEN o.y0 - f.start > 5 THEN o.y0 ELSE f.start END, f.cluster + CASE WHEN o.y0 - f.start > 5 THEN 1 ELSE 0 END FROM f JOIN o ON o.page = f.page AND o.r = f.r + 1) SELECT f.page, cluster AS line, count(*) AS n_words, string_agg(text, ' ' ORDER BY x0, f.ord) AS text, min(x0) AS x0, max(x1) AS x1 FROM f JOIN spans USING (page, ord) GROUP BY f.page, cluster")
def line_grouping(spark, sf_dir):
    rows = spans(spark, sf_dir)
    found = cluster.start_clusters(rows, ["page"], "y0", "ord", 5).select("page", "ord", F.col("cluster").alias("line")).join(rows, ["page", "ord"])
    ordered = F.array_sort(F.collect_list(F.struct("x0", "ord", "text")))
    return found.groupBy("page", "line").agg(F.count("*").alias("n_words"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"WITH {WORDS}, c AS (SELECT doc_id, line, i, regexp_extract(word, '^[^A-Za-z0-9]{{0,3}}((?:[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:[.][0-9]+)?|[0-9]+(?:[.][0-9]+)?))\\b[^0-9]{{0,3}}$', 1) AS t FROM words) SELECT doc_id, line, i, round(CAST(replace(t, ',', '') AS DOUBLE), 6) AS value FROM c WHERE t <> ''")
def clean_numbers(spark, sf_dir):
    value = clean_number(F.col("word"))
    return words(spark, sf_dir).select("doc_id", "line", "i", F.round(value, 6).alias("value")).where("value is not null")


@query(f"WITH {WORDS} SELECT CASE WHEN regexp_full_match(word, '[0-9,.₹$€£]+') THEN 'amount' WHEN regexp_matches(word, '[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{2,4}}') THEN 'date' WHEN regexp_full_match(upper(word), '[A-Z]{{1,4}}[-0-9/]+') THEN 'id_number' WHEN regexp_full_match(word, '[A-Za-z.]+') AND length(word) > 3 THEN 'name' WHEN regexp_matches(lower(word), 'street|road|avenue|city|state|country|pin|postal') THEN 'address' ELSE 'unknown' END AS field, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY ALL")
def field_types(spark, sf_dir):
    return words(spark, sf_dir).groupBy(field_type(F.col("word")).alias("field")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"WITH {LINES}, s AS (SELECT doc_id, line, trim(text, ' ') AS text FROM lines) SELECT doc_id, text, count(*) AS n, min(line) AS first_line FROM s WHERE text <> '' GROUP BY doc_id, text HAVING count(*) > 1")
def repeated_lines(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("text", F.trim("text")).where("text <> ''")
    return rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("line").cast("long").alias("first_line")).where("n > 1")


@query(f"WITH {LINES}, long AS (SELECT DISTINCT doc_id, text FROM lines WHERE length(text) > 40), small AS (SELECT text, count(*) AS held, min(doc_id) AS first_doc FROM long GROUP BY text HAVING count(*) > 1), p AS (SELECT l.doc_id, s.first_doc, count(*) AS shared FROM long l JOIN small s USING (text) WHERE l.doc_id > s.first_doc GROUP BY ALL), own AS (SELECT doc_id, count(DISTINCT text) AS n FROM lines GROUP BY doc_id), both_ AS (SELECT p.doc_id, p.first_doc, p.shared, count(DISTINCT a.text) AS common FROM p JOIN lines a ON a.doc_id = p.doc_id JOIN lines b ON b.doc_id = p.first_doc AND a.text = b.text GROUP BY ALL) SELECT doc_id, first_doc, shared, o1.n - coalesce(common, 0) AS added, o2.n - coalesce(common, 0) AS removed FROM both_ JOIN own o1 USING (doc_id) JOIN own o2 ON o2.doc_id = first_doc")
def revision_diff(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "text").distinct()
    long = rows.where(F.length("text") > 40)
    first = long.groupBy("text").agg(F.count("*").alias("held"), F.min("doc_id").alias("first_doc")).where("held > 1")
    pairs = long.join(first, "text").where("doc_id > first_doc").groupBy("doc_id", "first_doc").agg(F.count("*").alias("shared"))
    # lines go by a hash, and only those of documents in pairs
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s"))
    own = keyed.groupBy("doc_id").agg(F.count("*").alias("n"))
    left = pairs.join(keyed, "doc_id").select("doc_id", "first_doc", "h", "s")
    common = left.join(keyed.withColumnRenamed("doc_id", "first_doc"), ["first_doc", "h", "s"]).groupBy("doc_id", "first_doc").agg(F.count("*").alias("common"))
    both = pairs.join(common, ["doc_id", "first_doc"], "left").join(own.withColumnRenamed("n", "n1"), "doc_id").join(own.select(F.col("doc_id").alias("first_doc"), F.col("n").alias("n2")), "first_doc")
    held = F.coalesce("common", F.lit(0))
    return both.select("doc_id", "first_doc", "shared", (F.col("n1") - held).alias("added"), (F.col("n2") - held).alias("removed"))


@query("WITH f AS (SELECT p_brand AS name, p_size % 2 = 0 AS embedded, p_type FROM part) SELECT p_type, string_agg(DISTINCT name, ',' ORDER BY name) AS families FROM f a WHERE embedded AND EXISTS (SELECT 1 FROM f b WHERE b.p_type = a.p_type AND b.name = a.name AND NOT b.embedded) GROUP BY p_type")
def mixed_embedding(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_type", F.col("p_brand").alias("name"), (F.col("p_size") % 2 == 0).alias("embedded"))
    by_type = rows.groupBy("p_type", "name").agg(F.bool_or("embedded").alias("some"), F.bool_and("embedded").alias("every"))
    return by_type.where("some and not every").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("families"))


@query("WITH c AS (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_type, p_brand AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, first) AS r FROM c) WHERE r = 1")
def dominant_font(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    best = counts.groupBy("p_type").agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col("p_brand"))).alias("b"))
    return best.select("p_type", F.col("b.p_brand").alias("dominant"), F.col("b.n").alias("n"))


@query(f"WITH {COMBINED} SELECT doc_id, pdf_type, threshold, combined, verdict, confidence FROM combined")
def combine_verdict(spark, sf_dir):
    return combined(spark, sf_dir).select("doc_id", "pdf_type", "threshold", "combined", "verdict", "confidence")


REGIONS = "regions AS (SELECT doc_id, CASE length(text) % 97 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS region_confidence FROM lines)"


def regions(spark, sf_dir) -> DataFrame:
    """Every line is a region; its length says how sure it is."""
    n = F.length("text") % 97
    return lines(spark, sf_dir).select("doc_id", F.when(n == 0, "HIGH").when(n < 3, "MEDIUM").otherwise("LOW").alias("region_confidence"))


@query(f"WITH {COMBINED}, {LINES}, {REGIONS}, g AS (SELECT doc_id, least(15, sum(CASE region_confidence WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END)) AS gain FROM regions GROUP BY doc_id), n AS (SELECT c.*, CASE WHEN verdict = 'ORIGINAL' AND gain > 0 THEN round_even(least(100, combined + gain), 1) END AS fresh FROM combined c LEFT JOIN g USING (doc_id)) SELECT doc_id, coalesce(fresh, combined) AS combined, CASE WHEN fresh IS NULL THEN verdict WHEN abs(fresh - threshold) <= 5 THEN 'UNCERTAIN' WHEN fresh >= threshold THEN 'MODIFIED' ELSE 'ORIGINAL' END AS verdict, CASE WHEN fresh IS NULL THEN confidence ELSE least(99, 50 + CAST(trunc(abs(fresh - threshold) * CAST(1.8 AS DOUBLE)) AS INT)) END AS confidence FROM n")
def fusion_escalation(spark, sf_dir):
    return verdicts.escalate(combined(spark, sf_dir), regions(spark, sf_dir), "doc_id").select("doc_id", "combined", "verdict", "confidence")


@query(f"WITH {COMBINED}, l AS (SELECT doc_id, verdict, 100 - (CASE WHEN xmp_mismatch THEN 25 ELSE 0 END + CASE WHEN multiple_producers THEN 15 ELSE 0 END + CASE WHEN stripped THEN 30 ELSE 0 END + CASE WHEN delta_seconds > 0 AND delta_seconds < 60 THEN 10 ELSE 0 END + least(80.0, combined)) AS s FROM combined), a AS (SELECT doc_id, round(greatest(CASE verdict WHEN 'MODIFIED' THEN least(s, 30) WHEN 'UNCERTAIN' THEN least(s, 60) ELSE s END, 0), 6) AS authenticity FROM l) SELECT doc_id, authenticity, CASE WHEN authenticity >= 80 THEN 'high' WHEN authenticity >= 50 THEN 'medium' ELSE 'low' END AS assessment FROM a")
def authenticity(spark, sf_dir):
    return verdicts.authenticity(combined(spark, sf_dir)).select("doc_id", F.round("authenticity", 6).alias("authenticity"), "assessment")


@query(f"WITH {COMBINED}, j AS (SELECT quality = 0 AS t, verdict <> 'ORIGINAL' AS p FROM combined JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn FROM j) SELECT *, (tp + tn) / (tp + fn + fp + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c")
def accuracy_metrics(spark, sf_dir):
    rows = combined(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").withColumn("truth", F.col("quality") == 0)
    return verdicts.accuracy(rows, "truth", "verdict")


@query(f"WITH {COMBINED}, {LINES}, {REGIONS} SELECT doc_id, count(*) AS n_regions FROM regions WHERE doc_id NOT IN (SELECT doc_id FROM combined WHERE verdict = 'ORIGINAL') GROUP BY doc_id")
def gate_clean(spark, sf_dir):
    return verdicts.gated(regions(spark, sf_dir), combined(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_regions"))


@query(f"WITH {FOUND}, r AS (SELECT page, grp, ord, z, row_number() OVER (PARTITION BY page ORDER BY round(z, 6) DESC, grp, ord) AS rank FROM found) SELECT page, grp, ord, round(z, 4) AS z, rank FROM r WHERE rank <= 10")
def topk_per_page(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc(F.round("z", 6)), "grp", "ord"))
    return found_outliers(spark, sf_dir).withColumn("rank", rank).where("rank <= 10").select("page", "grp", "ord", F.round("z", 4).alias("z"), "rank")


@query(f"WITH {SPANS}, r AS (SELECT page, rank() OVER (PARTITION BY page ORDER BY seqno) + (count(*) OVER (PARTITION BY page, seqno) - 1) / 2.0 AS paint, rank() OVER (PARTITION BY page ORDER BY y0) + (count(*) OVER (PARTITION BY page, y0) - 1) / 2.0 AS seen FROM spans) SELECT page, count(*) AS n, round(corr(paint, seen), 6) AS rho FROM r GROUP BY page HAVING count(*) >= 3")
def spearman_order(spark, sf_dir):
    def ranks(c):
        tied = F.count("*").over(Window.partitionBy("page", c))
        return F.rank().over(Window.partitionBy("page").orderBy(c)) + (tied - 1) / 2

    rows = spans(spark, sf_dir).select("page", ranks("seqno").alias("paint"), ranks("y0").alias("seen"))
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.round(F.corr("paint", "seen"), 6).alias("rho")).where("n >= 3")


OVERLAY_KINDS = ["covering_rect", "image_overlay", "char_spacing", "ghost_text", "coordinate_overwrite", "text_stacking"]
OVERLAYS = "overlays AS (SELECT o_orderkey // 13 AS page, CASE (o_orderkey * 7 + o_custkey) % 23 WHEN 0 THEN 'covering_rect' WHEN 1 THEN 'image_overlay' WHEN 2 THEN 'char_spacing' WHEN 3 THEN 'ghost_text' WHEN 4 THEN 'coordinate_overwrite' WHEN 5 THEN 'text_stacking' END AS kind FROM orders)"


def overlays(spark, sf_dir) -> DataFrame:
    k = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 23
    kind = F.coalesce(*[F.when(k == i, name) for i, name in enumerate(OVERLAY_KINDS)])
    return read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 13).alias("page"), kind.alias("kind"))


@query(f"WITH {OVERLAYS}, c AS (SELECT page, count(kind) AS n_findings, least(70, 25 * count(*) FILTER (kind = 'covering_rect')) + least(60, 20 * count(*) FILTER (kind = 'image_overlay')) + least(40, 5 * count(*) FILTER (kind = 'char_spacing')) + least(70, 35 * count(*) FILTER (kind = 'ghost_text')) + least(50, 25 * count(*) FILTER (kind = 'coordinate_overwrite')) AS s, least(80, 40 * count(*) FILTER (kind = 'text_stacking')) AS t FROM overlays GROUP BY page) SELECT page, n_findings, least(100, least(100, s) + t) AS score FROM c")
def overlay_layer_score(spark, sf_dir):
    return layers.overlay_score(overlays(spark, sf_dir), ["page"], "kind")


@query(f"WITH {LINES}, l AS (SELECT doc_id, length(text) % 7 AS font, (length(text) % 41) / 80 + CASE WHEN length(text) % 37 = 0 THEN 0.25 ELSE 0 END AS anomaly, length(text) % 29 = 1 AS off, length(text) % 31 = 2 AS gap, length(text) % 43 = 3 AS mixed FROM lines), f AS (SELECT doc_id, font, count(*) AS n FROM l GROUP BY ALL), d AS (SELECT doc_id, count(*) AS n_fonts, max(n) / sum(n) AS share FROM f GROUP BY doc_id), c AS (SELECT doc_id, count(*) FILTER (anomaly > 0.5) AS n_strong, count(*) FILTER (anomaly > 0.3 AND anomaly <= 0.5) AS n_moderate, count(*) FILTER (off) AS off, count(*) FILTER (gap) AS gap, bool_or(mixed) AS mixed FROM l GROUP BY doc_id) SELECT doc_id, n_fonts, n_strong, n_moderate, CAST(least(100, CASE WHEN mixed THEN 25 ELSE 0 END + CASE WHEN n_fonts > 3 AND share < 0.6 THEN 15 ELSE 0 END + least(50, 12 * n_strong) + least(20, 5 * n_moderate) + least(40, 10 * off) + least(60, 20 * gap) * 0.5) AS DOUBLE) AS score FROM c JOIN d USING (doc_id)")
def content_layer_score(spark, sf_dir):
    n = F.length("text")
    anomaly = (n % 41) / 80 + F.when(n % 37 == 0, 0.25).otherwise(0.0)
    rows = lines(spark, sf_dir).select("doc_id", (n % 7).alias("font"), anomaly.alias("anomaly"), (n % 29 == 1).alias("off_colour"), (n % 31 == 2).alias("gap_before"), (n % 43 == 3).alias("mixed"))
    return layers.content_score(rows, ["doc_id"])


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
