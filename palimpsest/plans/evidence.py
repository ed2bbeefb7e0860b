"""Queries of the content, numeric, hidden-text and overlay layers on derived views, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fonts, lines as L, dates
from ..operators import content, hidden, ledgers, overlays, spatial
from .forensics import FOUND, LINES, NUMBERS, SPANS, WORDS, found_outliers, lines, numbers, query, read, spans, words

# ---------------------------------------------------------------- SQL of predicates


def quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def any_part(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(p)})" for p in parts) + ")"


def any_match(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p)})" for p in patterns) + ")"


def any_word(text: str, names) -> str:
    return any_match(text, [f"{L.EDGE_BEFORE}(?:{'|'.join(names)}){L.EDGE_AFTER}"])


def label_sql(text: str, label: str) -> str:
    return any_word(text, [label]) if len(label) <= 3 else any_part(text, [label])


def n_words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def n_kept(text: str, other: str) -> str:
    return f"length(regexp_replace({text}, '{other}', '', 'g'))"


def structural_sql(text: str, page: str, line: str, height: str, repeated: str) -> str:
    t = f"trim({text}, ' ')"
    bare = f"regexp_replace({t}, '[ \\-/.]', '', 'g')"
    plain = f"replace({t}, ' ', '')"
    letters = n_kept(t, r"[^\p{L}]")
    rules = [
        f"({letters} > 0 AND {n_kept(t, chr(91) + '^' + chr(92) + 'p{Lu}]')} / greatest({letters}, 1) > 0.85)",
        f"{n_words(t)} <= 3",
        repeated,
        f"({bare} <> '' AND {n_kept(bare, '[^0-9]')} / greatest(length({bare}), 1) > 0.7)",
        f"(regexp_matches({t}, '^[A-Za-z\\s]+\\s*:\\s*.+$') AND {n_words(t)} <= 8)",
        f"regexp_matches({t}, '^[-•*0-9]+[.)]\\s')",
        f"regexp_matches({t}, '^[*\\-_=#]{{5,}}')",
        f"({n_words(t)} <= 5 AND {height} > 0)",
        f"contains({t}, ' : ') OR ends_with({t}, ':')",
        f"(len(list_distinct(list_filter(string_split({plain}, ''), lambda c: c <> ''))) <= 2 AND length({t}) > 5)",
        f"({line} < 3 AND {page} = 0)",
        any_match(t, L.ADDRESS),
        any_word(f"lower({t})", L.PLACES),
    ]
    return f"(NOT ({any_part(f'lower({t})', L.ALWAYS_CHECK)} OR {any_word(f'lower({t})', L.ALWAYS_CHECK_WORDS)}) AND ({' OR '.join(f'({r})' for r in rules)}))"


def form_sql(text: str) -> str:
    low = f"lower(trim({text}, ' '))"
    return f"({any_match(low, L.FORM_FIELD)} OR ({n_words(low)} <= 2 AND length({text}) > 30))"


def gap_field_sql(text: str) -> str:
    return any_match(f"lower(trim({text}, ' '))", L.GAP_FIELD)


# ---------------------------------------------------------------- lines with layout

#: What a line is made of, by (7 * doc_id + 13 * line) % 19: text ahead, characters of the line kept, text after.
DECORATIONS = {
    0: ("Total balance: ", 99, ""),
    1: ("PAN no ", 99, ""),
    2: ("ALL CAPS HEADER LINE HERE NOW", 0, ""),
    3: ("", 12, ""),
    4: ("Date: ____", 0, ""),
    5: ("---------- ------", 0, ""),
    6: ("Running page footer of this document", 0, ""),
    7: ("days paid ", 99, ""),
    8: ("1. ", 40, ""),
    9: ("", 60, " ■ and so it ends here"),
    10: ("", 60, " � and so it ends here"),
    11: ("a b c d e", 0, ""),
    12: ("Label : value here for it now and then some more", 0, ""),
    13: ("123-456/78", 0, ""),
    14: ("near the road ", 99, ""),
}


def content_lines(spark, sf_dir) -> DataFrame:
    """doc_id, page, line, text, font, sizes, y0, y1: documents' lines laid out twelve a page."""
    rows = lines(spark, sf_dir).select("doc_id", F.col("line").alias("i"), F.col("text").alias("raw"))
    k, n = (F.col("doc_id") * 7 + F.col("i") * 13) % 19, F.length("raw")
    text = F.col("raw")
    for at, (ahead, kept, after) in DECORATIONS.items():
        text = F.when(k == at, F.concat(F.lit(ahead), F.substring("raw", 1, kept), F.lit(after))).otherwise(text)
    m = (n * 5 + F.col("i") * 3 + F.col("doc_id")) % 41
    font = F.when(m == 0, "ABCDEF+Courier").when(m == 1, "CIDFont+F1").when(m == 2, "Times-Bold").when(m < 6, "Arial-BoldMT").when(F.col("doc_id") % 5 == 0, "CIDFont+F2").when(m == 7, "ABCDEF+Helvetica").otherwise("Helvetica")
    gap = F.when((n * 3 + F.col("i")) % 31 == 4, 40.0).otherwise(0.0) + (n % 5) * 0.75
    on_page = F.col("i") % 12
    return rows.select("doc_id", F.floor(F.col("i") / 12).alias("page"), on_page.alias("line"), text.alias("text"), font.alias("font"), (11 + (n % 3) * 0.25 + F.when(m == 9, 20.0).otherwise(0.0)).alias("font_size"), (5 + (n % 7) * 0.1 + F.when(m == 11, 9.0).otherwise(0.0)).alias("char_spacing"), F.when(m == 13, 0.0).otherwise(3 + (n % 4) * 0.23 + (n % 5) * 0.017 + F.when(m == 15, 13.3).otherwise(0.0)).alias("word_spacing"), (12 + (n % 2) * 0.5 + F.when(m == 17, 25.0).otherwise(0.0)).alias("line_height"), F.when(m % 6 == 0, 0.01 + (n % 9) * 0.01).alias("char_cv"), (on_page * 20 + gap).alias("y0"), (on_page * 20 + 12 + gap * 0.5).alias("y1"))


def _decorated() -> str:
    return "CASE (doc_id * 7 + line * 13) % 19 " + " ".join(f"WHEN {k} THEN {quoted(a)} || left(text, {n}) || {quoted(b)}" for k, (a, n, b) in DECORATIONS.items()) + " ELSE text END"


CLINES = f"""{LINES}, c0 AS (SELECT doc_id, line AS i, {_decorated()} AS text, length(text) AS n, (length(text) * 5 + line * 3 + doc_id) % 41 AS m FROM lines),
c1 AS (SELECT *, CASE WHEN (n * 3 + i) % 31 = 4 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END + (n % 5) * 0.75::DOUBLE AS gap FROM c0),
clines AS (SELECT doc_id, i // 12 AS page, i % 12 AS line, text,
  CASE WHEN m = 0 THEN 'ABCDEF+Courier' WHEN m = 1 THEN 'CIDFont+F1' WHEN m = 2 THEN 'Times-Bold' WHEN m < 6 THEN 'Arial-BoldMT' WHEN doc_id % 5 = 0 THEN 'CIDFont+F2' WHEN m = 7 THEN 'ABCDEF+Helvetica' ELSE 'Helvetica' END AS font,
  11 + (n % 3) * 0.25::DOUBLE + CASE WHEN m = 9 THEN 20 ELSE 0 END AS font_size, 5 + (n % 7) * 0.1::DOUBLE + CASE WHEN m = 11 THEN 9 ELSE 0 END AS char_spacing,
  CASE WHEN m = 13 THEN 0.0::DOUBLE ELSE 3 + (n % 4) * 0.23::DOUBLE + (n % 5) * 0.017::DOUBLE + CASE WHEN m = 15 THEN 13.3::DOUBLE ELSE 0 END END AS word_spacing, 12 + (n % 2) * 0.5::DOUBLE + CASE WHEN m = 17 THEN 25 ELSE 0 END AS line_height,
  CASE WHEN m % 6 = 0 THEN 0.01::DOUBLE + (n % 9) * 0.01::DOUBLE END AS char_cv, (i % 12) * 20 + gap AS y0, (i % 12) * 20 + 12 + gap * 0.5::DOUBLE AS y1 FROM c1),
flags AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(text, ' ')) > 1 AS repeated FROM clines),
slines AS (SELECT *, {structural_sql('text', 'page', 'line', 'line_height', 'repeated')} AS structural, {form_sql('text')} AS form_field, {gap_field_sql('text')} AS gap_field FROM flags)"""


@query(f"WITH {CLINES} SELECT doc_id, page, line, repeated, structural, form_field, gap_field, {any_part('lower(text)', L.NEVER_FLAG)} AS never_flag, bool_or({any_part('lower(text)', L.ID_CARD)}) OVER (PARTITION BY doc_id) AS id_card FROM slines")
def structural_lines(spark, sf_dir):
    from pyspark.sql import Window

    low = F.lower("text")
    rows = content.structural_lines(content_lines(spark, sf_dir), "doc_id")
    return rows.select("doc_id", "page", "line", "repeated", "structural", "form_field", "gap_field", L.holds_any(low, L.NEVER_FLAG).alias("never_flag"), F.bool_or(L.holds_any(low, L.ID_CARD)).over(Window.partitionBy("doc_id")).alias("id_card"))


def _profile_sql(name: str, keys: str) -> str:
    return f"""{name}_c AS (SELECT {keys}, font, count(*) AS c, min((page, line)) AS first FROM clines GROUP BY {keys}, font),
{name}_d AS (SELECT {keys}, first(font ORDER BY c DESC, first) AS dominant, sum(c) AS n FROM {name}_c GROUP BY {keys}),
{name}_g AS (SELECT {keys}, list(font) AS design FROM {name}_c JOIN {name}_d USING ({keys}) WHERE c / n > 0.15 GROUP BY {keys}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, feature ORDER BY value) AS r, count(*) OVER (PARTITION BY {keys}, feature) AS n FROM long WHERE value > 0),
{name}_k AS (SELECT *, greatest(1, floor(n * CAST(0.1 AS DOUBLE))) AS k FROM {name}_r),
{name}_s AS (SELECT {keys}, feature, avg(value) AS mean, greatest(coalesce(stddev_samp(value), 1e-9), 1e-9) AS std FROM {name}_k WHERE NOT (feature <> 'line_height' AND n >= 4 AND n - 2 * k >= 2) OR (r > k AND r <= n - k) GROUP BY {keys}, feature),
{name}_m AS (SELECT {keys}, map_from_entries(list((feature, (mean, std)))) AS stats FROM {name}_s GROUP BY {keys})"""


def _family_sql(name: str) -> str:
    out = f"lower({name})"
    for style in fonts.STYLES:
        out = f"replace({out}, '{style}', '')"
    return f"regexp_replace(CASE WHEN contains({out}, '+') THEN regexp_replace({out}, '^[^+]*\\+', '') ELSE {out} END, '^[-_ ]+|[-_ ]+$', '', 'g')"


_Z = {f: f"abs({f} - coalesce(stats['{f}'][1], 0)) / coalesce(stats['{f}'][2], 1e-9)" for f in ("font_size", "char_spacing", "word_spacing", "line_height")}
_MISMATCH = "font <> dominant AND NOT structural AND family <> dominant_family AND (contains(lower(font), 'cidfont') OR NOT list_contains(coalesce(design, []), font))"
_CHECKS = [
    ("replacement", "regexp_matches(text, '[■□▪▫●○]') OR (contains(text, '�') AND NOT consistent)", "0.6"),
    ("font", _MISMATCH, f"CASE WHEN contains(lower(font), 'cidfont') AND contains(lower(dominant), 'cidfont') AND NOT (contains(text, '�') AND consistent AND NOT regexp_matches(text, '[■□▪▫●○]')) THEN 0.9 WHEN {any_part('lower(text)', L.CRITICAL)} THEN 0.7 WHEN line < 3 AND page = 0 THEN 0.15 ELSE 0.4 END"),
    *[(f, f"{_Z[f]} > 2.5 AND NOT structural{'' if f == 'font_size' else ' AND NOT form_field'}{f' AND {f} > 0' if 'spacing' in f else ''}", f"least({a}, {_Z[f]} * {b})") for f, (a, b) in {"font_size": (0.25, 0.05), "char_spacing": (0.2, 0.04), "word_spacing": (0.2, 0.04), "line_height": (0.15, 0.03)}.items()],
    ("uniform", "NOT structural AND length(text) > 8 AND char_cv < 0.05", "0.25"),
]
SUSPICIOUS = f"""{CLINES}, long AS (SELECT doc_id, page, unnest(['font_size', 'char_spacing', 'word_spacing', 'line_height']) AS feature, unnest([font_size, char_spacing, word_spacing, line_height]) AS value FROM clines),
{_profile_sql('w', 'doc_id')}, {_profile_sql('p', 'doc_id, page')},
glyphs AS (SELECT doc_id, font, sum(length(text) - length(replace(text, '�', ''))) / sum(length(text)) AS share FROM clines WHERE contains(font, '+') AND length(text) > 0 GROUP BY ALL),
joined AS (SELECT s.*, CASE WHEN p_d.n >= 8 THEN p_d.dominant ELSE w_d.dominant END AS dominant, CASE WHEN p_d.n >= 8 THEN coalesce(p_g.design, w_g.design) ELSE w_g.design END AS design, CASE WHEN p_d.n >= 8 THEN coalesce(p_m.stats, w_m.stats) ELSE w_m.stats END AS stats, coalesce(glyphs.share > 0.02, false) AS consistent
  FROM slines s JOIN w_d USING (doc_id) LEFT JOIN w_g USING (doc_id) LEFT JOIN w_m USING (doc_id) LEFT JOIN p_d USING (doc_id, page) LEFT JOIN p_g USING (doc_id, page) LEFT JOIN p_m USING (doc_id, page) LEFT JOIN glyphs ON glyphs.doc_id = s.doc_id AND glyphs.font = s.font),
named AS (SELECT *, {_family_sql('font')} AS family, {_family_sql('dominant')} AS dominant_family FROM joined),
judged AS (SELECT doc_id, page, line, {', '.join(f"coalesce({when}, false) AS f{i}, CAST({points} AS DOUBLE) AS p{i}" for i, (_, when, points) in enumerate(_CHECKS))} FROM named WHERE NOT {any_part('lower(text)', L.NEVER_FLAG)}),
suspicious AS (SELECT doc_id, page, line, least(1, {' + '.join(f'CASE WHEN f{i} THEN p{i} ELSE 0 END' for i in range(len(_CHECKS)))}) AS score, list_filter([{', '.join(f"CASE WHEN f{i} THEN '{name}' END" for i, (name, _, _) in enumerate(_CHECKS))}], lambda x: x IS NOT NULL) AS reasons FROM judged WHERE {' OR '.join(f'f{i}' for i in range(len(_CHECKS)))})"""


def suspicious(spark, sf_dir) -> DataFrame:
    rows = content_lines(spark, sf_dir)
    return content.suspicious_lines(rows, "doc_id", content.glyph_shares(rows, "doc_id"))


@query(f"WITH {SUSPICIOUS} SELECT doc_id, page, line, round(score, 6) AS score, array_to_string(reasons, ',') AS reasons FROM suspicious")
def suspicious_lines(spark, sf_dir):
    return suspicious(spark, sf_dir).select("doc_id", "page", "line", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SUSPICIOUS} SELECT doc_id, page, line, rank, array_to_string(reasons[1:3], ',') AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, page, line) AS rank FROM suspicious) WHERE rank <= 15")
def reported_lines(spark, sf_dir):
    return content.reported_lines(suspicious(spark, sf_dir), "doc_id").select("doc_id", "page", "line", "rank", F.array_join("reasons", ",").alias("reasons"))


GAPS = f"""{CLINES}, g0 AS (SELECT doc_id, page, line, text, gap_field, y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, line) AS gap, count(*) OVER (PARTITION BY doc_id, page) AS n_lines FROM slines),
g1 AS (SELECT * FROM g0 WHERE n_lines >= 5 AND gap > 0), g2 AS (SELECT doc_id, page, median(gap) AS mid FROM g1 GROUP BY ALL HAVING count(*) >= 5),
g3 AS (SELECT doc_id, page, gap, row_number() OVER (PARTITION BY doc_id, page ORDER BY gap) AS r, count(*) OVER (PARTITION BY doc_id, page) AS n FROM g1 JOIN g2 USING (doc_id, page) WHERE gap <= 3 * mid),
g4 AS (SELECT doc_id, page, avg(gap) AS mean, greatest(stddev_samp(gap), 1e-9) AS std FROM g3 WHERE n >= 5 AND r > greatest(1, n // 10) AND r <= n - greatest(1, n // 10) GROUP BY ALL),
g5 AS (SELECT g1.*, mean, std, count(*) OVER (PARTITION BY g1.doc_id, g1.page, round_even(gap, 1)) AS same FROM g1 JOIN g4 USING (doc_id, page) WHERE std >= 0.5),
g6 AS (SELECT *, least(abs(gap - mean) / std, 100) AS z FROM g5),
g7 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n_found FROM g6 WHERE z > 3.5 AND gap > mean AND same < 3 AND {n_words('text')} >= 3 AND NOT gap_field)"""


@query(f"WITH {GAPS} SELECT doc_id, page, line, round_even(gap, 1) AS gap, round_even(mean, 1) AS expected, round_even(z, 2) AS z FROM g7 WHERE n_found < 3")
def line_gaps(spark, sf_dir):
    return content.line_gaps(content_lines(spark, sf_dir), "doc_id")


@query(f"WITH {WORDS}, w AS (SELECT doc_id, line, i, word, i * 40 + (length(word) * 7 + doc_id) % 23 AS x0, i * 40 + (length(word) * 7 + doc_id) % 23 + length(word) * (3 + (i % 4) * 0.25::DOUBLE) AS x1 FROM words), g AS (SELECT *, CASE WHEN length(word) > 1 THEN (x1 - x0) / length(word) END AS wide, lead(x0) OVER (PARTITION BY doc_id, line ORDER BY x0, x1) - x1 AS gap FROM w) SELECT doc_id, line, round(coalesce(avg(wide), 0), 6) AS char_spacing, coalesce(round(CASE WHEN count(wide) >= 2 AND avg(wide) > 0 THEN stddev_samp(wide) / avg(wide) END, 6), -1) AS char_cv, round(coalesce(avg(gap) FILTER (gap > 0 AND gap < 50), 0), 6) AS word_spacing FROM g GROUP BY doc_id, line")
def word_features(spark, sf_dir):
    x0 = F.col("i") * 40 + (F.length("word") * 7 + F.col("doc_id")) % 23
    rows = words(spark, sf_dir).select("doc_id", "line", F.col("word").alias("text"), x0.cast("double").alias("x0"), (x0 + F.length("word") * (3 + (F.col("i") % 4) * 0.25)).alias("x1"))
    return content.word_features(rows, ["doc_id", "line"]).select("doc_id", "line", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("char_spacing", "char_cv", "word_spacing")])


@query("WITH f AS (SELECT p_partkey, p_size, ['Helvetica-Bold', 'ABCDEF+TimesNewRomanPSMT', 'Arial-BoldItalicMT', 'Courier-Oblique', '/Calibri', 'XYZABC+CIDFont+F1', 'Georgia_Regular', '-', 'Garamond-BoldItalic', '//ABCDEF+Times-Roman', 'ArialMT'][p_partkey % 11 + 1] AS name, p_partkey * 7919 AS colour FROM part) SELECT p_partkey, " + _family_sql("name") + " AS base, regexp_replace(string_split(lower(regexp_replace(regexp_replace(name, '^/+', ''), '^[A-Z]{6}\\+', '')), '-')[1], 'mt$', '') AS family, (colour >> 16) & 255 AS r, (colour >> 8) & 255 AS g, colour & 255 AS b FROM f")
def font_families(spark, sf_dir):
    names = ["Helvetica-Bold", "ABCDEF+TimesNewRomanPSMT", "Arial-BoldItalicMT", "Courier-Oblique", "/Calibri", "XYZABC+CIDFont+F1", "Georgia_Regular", "-", "Garamond-BoldItalic", "//ABCDEF+Times-Roman", "ArialMT"]
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 11).cast("int")).alias("name"), (F.col("p_partkey") * 7919).alias("colour"))
    r, g, b = fonts.rgb(F.col("colour"))
    return rows.select("p_partkey", fonts.base_family(F.col("name")).alias("base"), fonts.embedding_family(F.col("name")).alias("family"), r.alias("r"), g.alias("g"), b.alias("b"))


DATES = "d AS (SELECT o_orderkey AS k, lpad(CAST(2000 + o_orderkey % 30 AS VARCHAR), 4, '0') AS y, lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') AS mo, lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS da, lpad(CAST(o_orderkey % 25 AS VARCHAR), 2, '0') AS h, lpad(CAST(o_orderkey % 61 AS VARCHAR), 2, '0') AS mi, lpad(CAST(o_orderkey % 59 AS VARCHAR), 2, '0') AS s FROM orders), t AS (SELECT k, CASE k % 7 WHEN 0 THEN 'D:' || y || mo || da || h || mi || s || '+05''30''' WHEN 1 THEN y || mo || da || h || mi || s WHEN 2 THEN y || '-' || mo || '-' || da || 'T' || h || ':' || mi || ':' || s || '+02:00' WHEN 3 THEN y || '-' || mo || '-' || da WHEN 4 THEN 'yesterday' WHEN 5 THEN ' D:' || y || mo || da || h || mi || s || 'Z ' END AS text FROM d)"


def dated(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    pad = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    y, mo, da, h, mi, s = pad(2000 + k % 30, 4), pad(k % 14), pad(k % 33), pad(k % 25), pad(k % 61), pad(k % 59)
    digits, iso = F.concat(y, mo, da, h, mi, s), F.concat_ws("-", y, mo, da)
    text = F.when(k % 7 == 0, F.concat(F.lit("D:"), digits, F.lit("+05'30'"))).when(k % 7 == 1, digits).when(k % 7 == 2, F.concat(iso, F.lit("T"), F.concat_ws(":", h, mi, s), F.lit("+02:00"))).when(k % 7 == 3, iso).when(k % 7 == 4, "yesterday").when(k % 7 == 5, F.concat(F.lit(" D:"), digits, F.lit("Z ")))
    return read(spark, sf_dir, "orders").select(k.alias("k"), text.alias("text"))


@query(f"WITH {DATES}, b AS (SELECT k, regexp_replace(trim(text, ' '), '^D:', '') AS x FROM t) SELECT k, strftime(CASE WHEN regexp_matches(x, '^[0-9]{{14}}') THEN try_strptime(left(x, 14), '%Y%m%d%H%M%S') WHEN regexp_full_match(left(x, 19), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime(x, '%Y-%m-%d') WHEN regexp_full_match(left(x, 19), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN try_strptime(replace(left(x, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') END, '%Y-%m-%d %H:%M:%S') AS at FROM b")
def pdf_dates(spark, sf_dir):
    return dated(spark, sf_dir).select("k", F.date_format(dates.pdf_date(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 > 0 THEN (o_orderkey * o_orderkey) % 60000 * 1000 // (1 + (o_orderkey % 5) * (o_orderkey % 5) * 400) - 3000 END AS s FROM orders), b AS (SELECT k, s, floor(s / 86400) AS d FROM a), c AS (SELECT *, floor((s - d * 86400) / 3600) AS h, floor((s - d * 86400) % 3600 / 60) AS m FROM b) SELECT k, coalesce(CAST(d AS BIGINT), -1000000) AS days_ago, CASE WHEN s IS NULL THEN 'Unknown' WHEN d = 0 AND h = 0 AND m > 0 THEN CAST(m AS BIGINT) || ' minutes ago' WHEN d = 0 AND h = 0 THEN 'Just now' WHEN d = 0 THEN CAST(h AS BIGINT) || ' hours ago' WHEN d < 7 THEN CAST(d AS BIGINT) || CASE WHEN d > 1 THEN ' days ago' ELSE ' day ago' END WHEN d < 30 THEN CAST(d AS BIGINT) // 7 || CASE WHEN d >= 14 THEN ' weeks ago' ELSE ' week ago' END WHEN d < 365 THEN CAST(d AS BIGINT) // 30 || CASE WHEN d >= 60 THEN ' months ago' ELSE ' month ago' END ELSE CAST(d AS BIGINT) // 365 || CASE WHEN d >= 730 THEN ' years ago' ELSE ' year ago' END END AS human_readable, CASE WHEN s IS NULL THEN 1.0 WHEN d = 0 AND h = 0 THEN 1.5 WHEN d = 0 THEN 1.3 WHEN d < 7 THEN 1.2 WHEN d < 30 THEN 1.0 WHEN d < 365 THEN 0.9 ELSE 0.8 END::DOUBLE AS risk_factor, coalesce(d < 1, false) AS is_recent, coalesce(d = 0 AND h < 3, false) AS is_very_recent FROM c")
def edit_ages(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.when(k % 17 > 0, F.floor(k * k % 60000 * 1000 / (1 + (k % 5) * (k % 5) * 400)) - 3000)
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    return read(spark, sf_dir, "orders").select(k.alias("k"), dates.edit_age(F.timestamp_seconds(F.lit(1_700_000_000) - s), now).alias("a")).select("k", "a.*").na.fill(-1000000, ["days_ago"])


# ---------------------------------------------------------------- numbers of lines

NUMBER_LINES = f"{NUMBERS}, n0 AS (SELECT grp, page, line, ord, value, CASE ord % 13 WHEN 0 THEN 'Total' WHEN 1 THEN 'Account no. 7' WHEN 2 THEN 'ID card of someone' WHEN 3 THEN 'MUMBAI MAHARASHTRA ' || CAST(400000 + grp AS VARCHAR) WHEN 4 THEN 'FY ' || CAST(1900 + grp % 250 AS VARCHAR) WHEN 5 THEN 'on 1/2/' || CAST(2000 + grp % 99 AS VARCHAR) WHEN 6 THEN 'Unit 4, ' || CAST(400000 + grp AS VARCHAR) WHEN 7 THEN 'LONG CAPS WORDS HERE' WHEN 8 THEN 'amount due' WHEN 9 THEN 'paid to company' WHEN 10 THEN 'balance: 12' WHEN 11 THEN 'Net Pay : 1,200 and bonus 5' ELSE 'item' END AS text, CASE ord % 5 WHEN 0 THEN CAST(400000 + grp AS DOUBLE) WHEN 1 THEN CAST(1900 + grp % 250 AS DOUBLE) WHEN 2 THEN CAST(grp * 1000003 AS DOUBLE) WHEN 3 THEN CAST(2000 + grp % 99 AS DOUBLE) ELSE value END AS v FROM numbers)"


def number_lines(spark, sf_dir) -> DataFrame:
    g, o = F.col("grp"), F.col("ord")
    text = lambda c: c.cast("string")
    said = {0: F.lit("Total"), 1: F.lit("Account no. 7"), 2: F.lit("ID card of someone"), 3: F.concat(F.lit("MUMBAI MAHARASHTRA "), text(400000 + g)), 4: F.concat(F.lit("FY "), text(1900 + g % 250)), 5: F.concat(F.lit("on 1/2/"), text(2000 + g % 99)), 6: F.concat(F.lit("Unit 4, "), text(400000 + g)), 7: F.lit("LONG CAPS WORDS HERE"), 8: F.lit("amount due"), 9: F.lit("paid to company"), 10: F.lit("balance: 12"), 11: F.lit("Net Pay : 1,200 and bonus 5")}
    words_ = F.lit("item")
    for k, v in said.items():
        words_ = F.when(o % 13 == k, v).otherwise(words_)
    v = F.when(o % 5 == 0, 400000 + g).when(o % 5 == 1, 1900 + g % 250).when(o % 5 == 2, g * 1000003).when(o % 5 == 3, 2000 + g % 99).otherwise(F.col("value"))
    return numbers(spark, sf_dir).select("grp", "page", "line", "ord", "value", words_.alias("text"), v.cast("double").alias("v"))


_DIGITS = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE '' END"


@query(
    f"WITH {NUMBER_LINES}, d AS (SELECT *, {_DIGITS} AS digits, lower(text) AS low, replace(replace(text, '/', '//'), '-', '--') AS twice FROM n0) SELECT grp, ord, {any_part('low', L.REFERENCE)} OR {any_word('low', L.REFERENCE_WORDS)} OR length(digits) > 8 OR (length(digits) = 6 AND ({any_part('low', L.POSTAL)} OR {any_part('low', L.STATES)} OR (NOT {any_part('low', L.CURRENCY)} AND (len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: length(w) >= 4 AND upper(w) = w)) >= 2 OR regexp_extract(text, '[-,]\\s*([0-9]+)\\s*$', 1) = digits)))) OR (length(digits) = 4 AND v BETWEEN 1950 AND 2099 AND ({any_part('low', L.YEAR_WORDS)} OR list_contains(regexp_extract_all(twice, '[/\\-]\\s*([0-9]+)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), digits) OR list_contains(regexp_extract_all(twice, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]+)\\s*[/\\-]', 1), digits))) AS is_id FROM d"
)
def id_numbers(spark, sf_dir):
    return number_lines(spark, sf_dir).select("grp", "ord", L.is_id_number(F.col("v"), F.col("text")).alias("is_id"))


@query(f"WITH {NUMBER_LINES}, l(pattern, label) AS (VALUES {', '.join(f'({quoted(p)}, {quoted(p.replace(chr(92) + chr(115) + chr(42), chr(95)))})' for p in ledgers.GROUP_LABELS)}) SELECT label, count(*) AS n, count(DISTINCT page) AS pages, round(sum(value), 2) AS total FROM n0 JOIN l ON regexp_matches(lower(text), pattern || '\\s*:?\\s*[0-9,.]+') WHERE value > 0 GROUP BY label")
def label_groups(spark, sf_dir):
    return ledgers.label_groups(number_lines(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {NUMBERS}, n AS (SELECT grp, ord, CASE WHEN ord = 1 THEN 'Grand Total' WHEN ord % 9 = 0 THEN 'Sub total' ELSE 'item' END AS text, value FROM numbers), s AS (SELECT grp, sum(value) FILTER (text = 'item') AS items, count(*) FILTER (text = 'item') AS k FROM n GROUP BY grp), v AS (SELECT n.grp, ord, text, CASE WHEN ord = 1 AND n.grp % 3 = 0 THEN items * (1 + (n.grp % 5) / 100.0::DOUBLE) ELSE value END AS value, items, k FROM n JOIN s USING (grp)) SELECT grp, ord, text <> 'item' AS is_total, coalesce(text <> 'item' AND k >= 2 AND abs(items - value) / greatest(abs(value), 1) * 100 <= 2, false) AS reconciles FROM v")
def reconciled_totals(spark, sf_dir):
    o = F.col("ord")
    rows = numbers(spark, sf_dir).select("grp", "ord", F.when(o == 1, "Grand Total").when(o % 9 == 0, "Sub total").otherwise("item").alias("text"), "value")
    sums = rows.where("text = 'item'").groupBy("grp").agg(F.sum("value").alias("items"))
    rows = rows.join(sums, "grp", "left").withColumn("value", F.when((o == 1) & (F.col("grp") % 3 == 0), F.col("items") * (1 + F.col("grp") % 5 / 100.0)).otherwise(F.col("value")))
    return ledgers.reconciled(rows, ["grp"]).select("grp", "ord", L.is_total(F.col("text")).alias("is_total"), "reconciles")


@query(f"WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, ord) AS k, count(*) OVER (PARTITION BY grp) AS size, lead(value) OVER (PARTITION BY grp ORDER BY value DESC, ord) AS other FROM numbers) SELECT grp, ord, value, other AS max_other, round(value / other, 6) AS ratio FROM r WHERE k = 1 AND size >= 3 AND other > 0 AND value / other >= 1.02 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.grp = r.grp AND f.page = r.page AND f.line = r.line)")
def ratio_outliers(spark, sf_dir):
    found = ledgers.ratio_outliers(numbers(spark, sf_dir), ["grp"], ["ord"], found_outliers(spark, sf_dir), ["page", "line"], 1.02)
    return found.select("grp", "ord", "value", "max_other", F.round("ratio", 6).alias("ratio"))


#: Lines of a payslip or a statement, by customer: field, amount by arithmetic, and how far it is off.
FIELDS = ["Basic Salary", "HRA", "Special allowance", "Bonus paid", "Gross salary", "Total deductions", "Net salary payable", "Opening balance", "Total deposits", "Total withdrawal", "Closing balance", "Remarks helpful"]
LABELLED = f"labelled AS (SELECT c_custkey AS doc, f // 5 AS page, f AS line, ({quoted(FIELDS)})[f + 1] AS text, CASE WHEN c_custkey % 11 = f THEN NULL WHEN f = 4 THEN 1800 + (c_custkey % 7) * 100 WHEN f = 5 THEN 300 WHEN f = 6 THEN 1500 + (c_custkey % 9) * 50 WHEN f = 7 THEN 1000 WHEN f = 8 THEN 700 WHEN f = 9 THEN 200 WHEN f = 10 THEN 1500 + c_custkey % 13 WHEN f = 0 THEN 1000 WHEN f = 1 THEN 500 WHEN f = 2 THEN 200 ELSE 100 END::DOUBLE AS value FROM customer, range(12) r(f) WHERE (c_custkey + f) % 17 > 0)"


def labelled_lines(spark, sf_dir) -> DataFrame:
    c, f = F.col("c_custkey"), F.col("f")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("f")).where("(c_custkey + f) % 17 > 0")
    value = F.when(c % 11 == f, None).when(f == 4, 1800 + c % 7 * 100).when(f == 5, 300).when(f == 6, 1500 + c % 9 * 50).when(f == 7, 1000).when(f == 8, 700).when(f == 9, 200).when(f == 10, 1500 + c % 13).when(f == 0, 1000).when(f == 1, 500).when(f == 2, 200).otherwise(100)
    return rows.select(c.alias("doc"), F.floor(f / 5).alias("page"), f.alias("line"), F.get(F.array(*[F.lit(x) for x in FIELDS]), f).alias("text"), value.cast("double").alias("value"))


ARITHMETIC = f"""{LABELLED}, kinds AS (SELECT doc, bool_or({' OR '.join(label_sql('lower(text)', x) for x in ledgers.PAYSLIP)}) AS slip, bool_or({' OR '.join(label_sql('lower(text)', x) for x in ledgers.STATEMENT)}) AS bank FROM labelled GROUP BY doc),
fields AS (SELECT doc, page, line, value, CASE {' '.join(f"WHEN {label_sql('lower(text)', label)} THEN '{name}'" for label, name in ledgers.LABELS)} END AS field FROM labelled WHERE value IS NOT NULL),
lasts AS (SELECT doc, field, last(value ORDER BY page, line) AS value, last(page ORDER BY page, line) AS page, last(line ORDER BY page, line) AS line FROM fields WHERE field IS NOT NULL GROUP BY doc, field),
wide AS (SELECT doc, sum(value) FILTER (field IN ('basic', 'hra', 'da', 'conveyance', 'allowance', 'bonus', 'incentive', 'other')) AS earned, {', '.join(f"max(value) FILTER (field = '{n}') AS {n}, max(page) FILTER (field = '{n}') AS p_{n}, max(line) FILTER (field = '{n}') AS l_{n}" for n in ('gross', 'total_deductions', 'net_pay', 'opening_balance', 'total_deposits', 'total_withdrawals', 'closing_balance'))} FROM lasts GROUP BY doc),
checks AS (SELECT doc, 'earnings_sum' AS "check", p_gross AS page, l_gross AS line, earned AS expected, gross AS stated, 2.0 AS tol, 40 AS points FROM wide JOIN kinds USING (doc) WHERE slip AND earned > 0
  UNION ALL SELECT doc, 'net_pay_equation', p_net_pay, l_net_pay, gross - total_deductions, net_pay, 2.0, 50 FROM wide JOIN kinds USING (doc) WHERE slip
  UNION ALL SELECT doc, 'bank_balance', p_closing_balance, l_closing_balance, opening_balance + total_deposits - total_withdrawals, closing_balance, 0.5, 60 FROM wide JOIN kinds USING (doc) WHERE bank),
arith AS (SELECT *, abs(expected - stated) / greatest(stated, 1) * 100 AS off FROM checks WHERE abs(expected - stated) / greatest(stated, 1) * 100 > tol)"""


@query(f"WITH {ARITHMETIC} SELECT doc, \"check\", page, line, round(expected, 2) AS expected, stated, round(off, 2) AS diff_pct, CASE WHEN off > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, points FROM arith")
def arithmetic_checks(spark, sf_dir):
    return ledgers.arithmetic_checks(labelled_lines(spark, sf_dir), "doc")


#: Rows of a statement: three columns with some numbers missing, amounts by arithmetic.
ENTRIES = "base AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders), cells AS (SELECT doc, r // 4 AS page, r % 4 AS line, c AS ord, CASE c WHEN 0 THEN 300 + k % 15 WHEN 1 THEN 400 + k % 15 ELSE 500 + k % 15 END::DOUBLE AS x, CASE c WHEN 0 THEN k % 90 + 1 WHEN 1 THEN k % 70 + 1 ELSE 5000 + r * 10 + k % 3 END::DOUBLE AS value FROM base, range(3) t(c) WHERE c = 2 AND (k + doc) % 23 > 0 OR c = k % 2 OR (k % 31 = 0)), entries AS (SELECT * FROM cells)"
TRANSACTIONS = f"""{ENTRIES}, rows_ AS (SELECT *, count(*) OVER (PARTITION BY doc, page, line) AS n FROM entries), few AS (SELECT doc, page, line, ord, x, value FROM rows_ WHERE n <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY x, page, line, ord) AS q FROM few), f AS (SELECT doc, page, line, ord, x, value, q, x AS start, 0 AS cluster FROM o WHERE q = 1 UNION ALL SELECT o.doc, o.page, o.line, o.ord, o.x, o.value, o.q, CASE WHEN o.x - f.start > 40 THEN o.x ELSE f.start END, f.cluster + CASE WHEN o.x - f.start > 40 THEN 1 ELSE 0 END FROM f JOIN o ON o.doc = f.doc AND o.q = f.q + 1),
nr AS (SELECT doc, count(DISTINCT (page, line)) AS n_rows FROM f GROUP BY doc), cols AS (SELECT doc, cluster, avg(x) AS m, count(DISTINCT (page, line)) AS held FROM f GROUP BY doc, cluster), ok AS (SELECT cols.*, n_rows FROM cols JOIN nr USING (doc) WHERE n_rows >= 5),
bal AS (SELECT doc, max(m) AS bm, arg_max(cluster, m) AS b FROM ok WHERE held / n_rows >= 0.8 GROUP BY doc), side AS (SELECT ok.doc, cluster, row_number() OVER (PARTITION BY ok.doc ORDER BY m DESC) AS q FROM ok JOIN bal USING (doc) WHERE m < bm),
roles AS (SELECT bal.doc, b, max(cluster) FILTER (q = 1) AS d, max(cluster) FILTER (q = 2) AS w FROM bal JOIN side USING (doc) GROUP BY bal.doc, b),
trans AS (SELECT f.doc, page, line, last(value ORDER BY x, ord) FILTER (cluster = w) AS withdrawal, last(value ORDER BY x, ord) FILTER (cluster = d) AS deposit, last(value ORDER BY x, ord) FILTER (cluster = b) AS balance FROM f JOIN roles ON roles.doc = f.doc AND d IS NOT NULL AND w IS NOT NULL GROUP BY f.doc, page, line),
tx AS (SELECT * FROM trans WHERE balance > 0 AND (withdrawal IS NOT NULL OR deposit IS NOT NULL))"""


def entries(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    base = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), r.alias("r"))
    k, c = F.col("k"), F.col("c")
    cells = base.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(((c == 2) & ((k + F.col("doc")) % 23 > 0)) | (c == k % 2) | (k % 31 == 0))
    x = F.when(c == 0, 300 + k % 15).when(c == 1, 400 + k % 15).otherwise(500 + k % 15)
    value = F.when(c == 0, k % 90 + 1).when(c == 1, k % 70 + 1).otherwise(5000 + F.col("r") * 10 + k % 3)
    return cells.select("doc", F.floor(F.col("r") / 4).alias("page"), (F.col("r") % 4).alias("line"), c.alias("ord"), x.cast("double").alias("x"), value.cast("double").alias("value"))


@query(f"WITH RECURSIVE {TRANSACTIONS} SELECT doc, page, line, coalesce(withdrawal, -1) AS withdrawal, coalesce(deposit, -1) AS deposit, balance FROM tx")
def transactions(spark, sf_dir):
    return ledgers.transactions(entries(spark, sf_dir), "doc").na.fill(-1.0, ["withdrawal", "deposit"])


@query(f"WITH RECURSIVE {TRANSACTIONS}, p AS (SELECT *, lag(balance) OVER (PARTITION BY doc ORDER BY page, line) - coalesce(withdrawal, 0) + coalesce(deposit, 0) AS expected FROM tx WHERE doc % 4 > 0) SELECT doc, page, line, expected, balance, abs(expected - balance) AS diff FROM p WHERE abs(expected - balance) > 1")
def statement_balances(spark, sf_dir):
    said = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.when(F.col("c_custkey") % 4 > 0, "Closing Balance").otherwise("notes").alias("text"))
    found = ledgers.statement_balances(entries(spark, sf_dir), said, "doc")
    return found.select("doc", "page", "line", "expected", "balance", "diff")


@query("SELECT o_orderkey AS k, CAST(least(100, least(100, least(100, least(60, 20 * (o_orderkey % 5)) + least(30, 10 * (o_orderkey % 4))) + round_even(least(100, o_orderkey % 3 * 55) * 0.4, 0)) + round_even(least(90, 30 * (o_orderkey % 6)) * 0.4, 0)) AS BIGINT) AS score FROM orders")
def numeric_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("k"), ledgers.numeric_score(k % 5, k % 4, k % 3 * 55, k % 6).alias("score"))


# ---------------------------------------------------------------- spans of documents

PSPANS = f"{SPANS}, pspans AS (SELECT page // 5 AS doc, page % 5 AS page, ord, CASE ord % 29 WHEN 0 THEN ' ' || text || ' ' WHEN 1 THEN ' ' WHEN 2 THEN 'X' ELSE text END AS text, x0, y0, x1, y1, seqno, CASE WHEN (ord * 7 + 3) % 11 < 8 THEN 0 ELSE (ord * 37) % 4 * 1118481 + ord % 3 * 65793 END AS colour FROM spans)"


def page_spans(spark, sf_dir) -> DataFrame:
    o = F.col("ord")
    text = F.when(o % 29 == 0, F.concat(F.lit(" "), "text", F.lit(" "))).when(o % 29 == 1, " ").when(o % 29 == 2, "X").otherwise(F.col("text"))
    return spans(spark, sf_dir).select(F.floor(F.col("page") / 5).alias("doc"), (F.col("page") % 5).alias("page"), "ord", text.alias("text"), "x0", "y0", "x1", "y1", "seqno", F.when((o * 7 + 3) % 11 < 8, 0).otherwise(o * 37 % 4 * 1118481 + o % 3 * 65793).cast("long").alias("colour"))


#: Every third span as a drawn box: some white, some of the colour around them, some without a place in the paint order; sizes vary.
RECTS = "rects AS (SELECT doc, page, ord, CASE ord % 4 WHEN 0 THEN [1.0, 1.0, 1.0]::DOUBLE[] WHEN 1 THEN [0.86, 0.9, 0.85]::DOUBLE[] WHEN 2 THEN [0.2, 0.4, 0.6]::DOUBLE[] END AS fill, CASE WHEN ord % 7 = 0 THEN [0.9, 0.9, 0.9]::DOUBLE[] END AS stroke, CASE WHEN ord % 5 < 2 THEN [0.25, 0.45, 0.55]::DOUBLE[] END AS background, x0, y0, x1 + ord % 9 * 40 AS x1, y1 + ord % 8 - 4 AS y1, CASE WHEN ord % 10 > 0 THEN seqno END AS seqno FROM pspans WHERE ord % 3 = 0)"


def rects(spark, sf_dir) -> DataFrame:
    o = F.col("ord")
    colour = lambda *c: F.array(*[F.lit(x) for x in c])
    rows = page_spans(spark, sf_dir).where("ord % 3 = 0")
    return rows.select("doc", "page", "ord", F.when(o % 4 == 0, colour(1.0, 1.0, 1.0)).when(o % 4 == 1, colour(0.86, 0.9, 0.85)).when(o % 4 == 2, colour(0.2, 0.4, 0.6)).alias("fill"), F.when(o % 7 == 0, colour(0.9, 0.9, 0.9)).alias("stroke"), F.when(o % 5 < 2, colour(0.25, 0.45, 0.55)).alias("background"), "x0", "y0", (F.col("x1") + o % 9 * 40).alias("x1"), (F.col("y1") + o % 8 - 4).alias("y1"), F.when(o % 10 > 0, F.col("seqno")).alias("seqno"))


HIT = "least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"
_WHITE = "(len({0}) >= 3 AND {0}[1] >= 0.85 AND {0}[2] >= 0.85 AND {0}[3] >= 0.85)"
COVERED = f"""{PSPANS}, {RECTS}, m1 AS (SELECT a.doc, a.page, a.ord, a.x0, a.y0, a.x1, a.y1, b.ord AS o, trim(b.text, ' ') AS t, b.colour AS c FROM rects a JOIN pspans b ON a.doc = b.doc AND a.page = b.page AND {HIT} WHERE (coalesce({_WHITE.format('fill')}, false) OR coalesce({_WHITE.format('stroke')}, false)) AND a.x1 - a.x0 >= 10 AND a.y1 - a.y0 >= 5 AND trim(b.text, ' ') <> ''),
covered AS (SELECT doc, page, 'white_rectangle_cover' AS method, ord, string_agg(t, ' | ' ORDER BY o) FILTER (c = base) AS original, coalesce(array_to_string((list(t ORDER BY o) FILTER (c <> base))[1:3], ' | '), '') AS covering, x0, y0, x1, y1 FROM (SELECT *, min(c) OVER (PARTITION BY doc, page, ord) AS base FROM m1) GROUP BY doc, page, ord, x0, y0, x1, y1),
t2 AS (SELECT doc, page, ord, trim(text, ' ') AS text, x0, y0, x1, y1, colour, round_even((y0 + y1) / 2 / 2, 0) * 2 AS y_key FROM pspans WHERE length(trim(text, ' ')) >= 2),
m2 AS (SELECT a.doc, a.page, a.ord, b.ord AS b_ord, CASE WHEN a.colour <= b.colour THEN a.text ELSE b.text END AS original, CASE WHEN a.colour <= b.colour THEN b.text ELSE a.text END AS covering, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1 FROM t2 a JOIN t2 b ON a.doc = b.doc AND a.page = b.page AND a.y_key = b.y_key AND a.ord < b.ord AND a.text <> b.text WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5 OR abs(a.x0 - b.x0) < 5),
overlapped AS (SELECT doc, page, 'text_overlap' AS method, ord, original, covering, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, left(original, 30), left(covering, 30) ORDER BY ord, b_ord) AS r FROM m2) WHERE r = 1),
revisions AS (SELECT doc, rev, page, ord, CASE WHEN rev > 0 AND ord % 13 = 0 THEN 'new' || text WHEN rev > 0 AND ord % 17 = 0 THEN 'Z' ELSE text END AS text, x0, y0, x1, y1 FROM pspans, range(3) r(rev) WHERE (rev < 2 OR doc % 2 = 0) AND (rev = 0 OR page < 4 OR doc % 3 > 0)),
ends AS (SELECT doc, min(rev) AS lo, max(rev) AS hi FROM revisions GROUP BY doc HAVING min(rev) < max(rev)),
old AS (SELECT r.* FROM revisions r JOIN ends USING (doc) WHERE rev = lo), fresh AS (SELECT r.* FROM revisions r JOIN ends USING (doc) WHERE rev = hi),
gone AS (SELECT *, row_number() OVER (PARTITION BY doc, page, text ORDER BY ord) AS r FROM old o WHERE length(text) >= 2 AND EXISTS (SELECT 1 FROM fresh n WHERE n.doc = o.doc AND n.page = o.page) AND NOT EXISTS (SELECT 1 FROM fresh n WHERE n.doc = o.doc AND n.page = o.page AND n.text = o.text)),
come AS (SELECT doc, page, left(string_agg(DISTINCT text, ', ' ORDER BY text), 100) AS covering FROM fresh n WHERE length(text) >= 2 AND NOT EXISTS (SELECT 1 FROM old o WHERE n.doc = o.doc AND n.page = o.page AND n.text = o.text) GROUP BY doc, page),
changed AS (SELECT g.doc, g.page, 'incremental_update' AS method, ord, text AS original, coalesce(covering, '') AS covering, x0, y0, x1, y1 FROM gone g LEFT JOIN come USING (doc, page) WHERE r = 1),
all_ AS (SELECT *, 1 AS m FROM covered UNION ALL SELECT *, 2 FROM overlapped UNION ALL SELECT *, 3 FROM changed),
hiddens AS (SELECT *, CASE WHEN regexp_replace(covering, '\\s+', '', 'g') = '' OR lower(regexp_replace(covering, '\\s+', '', 'g')) = 'unknown' THEN 'missing' ELSE 'replaced' END AS replacement_type FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, left(original, 20) ORDER BY m, ord, original, covering) AS r FROM all_) WHERE r = 1)"""


def revisions(spark, sf_dir) -> DataFrame:
    rows = page_spans(spark, sf_dir).withColumn("rev", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("(rev < 2 or doc % 2 = 0) and (rev = 0 or page < 4 or doc % 3 > 0)")
    o, later = F.col("ord"), F.col("rev") > 0
    text = F.when(later & (o % 13 == 0), F.concat(F.lit("new"), "text")).when(later & (o % 17 == 0), "Z").otherwise(F.col("text"))
    return rows.select("doc", "rev", "page", "ord", text.alias("text"), "x0", "y0", "x1", "y1")


_SHOWN = "doc, page, ord, original, covering, x0, y0, x1, y1"


@query(f"WITH {COVERED} SELECT {_SHOWN} FROM covered")
def covered_text(spark, sf_dir):
    return hidden.covered_text(rects(spark, sf_dir), page_spans(spark, sf_dir), "doc").drop("method")


@query(f"WITH {COVERED} SELECT {_SHOWN} FROM overlapped")
def overlapping_text(spark, sf_dir):
    return hidden.overlapping_text(page_spans(spark, sf_dir), "doc").drop("method")


@query(f"WITH {COVERED} SELECT {_SHOWN} FROM changed")
def revision_changes(spark, sf_dir):
    return hidden.revision_changes(revisions(spark, sf_dir), "doc").drop("method")


def all_hidden(spark, sf_dir) -> DataFrame:
    rows = page_spans(spark, sf_dir)
    return hidden.hidden_texts([hidden.covered_text(rects(spark, sf_dir), rows, "doc"), hidden.overlapping_text(rows, "doc"), hidden.revision_changes(revisions(spark, sf_dir), "doc")], "doc")


@query(f"WITH {COVERED} SELECT doc, page, method, ord, original, covering, replacement_type FROM hiddens")
def hidden_texts(spark, sf_dir):
    return all_hidden(spark, sf_dir).select("doc", "page", "method", "ord", "original", "covering", "replacement_type")


@query(f"WITH {COVERED} SELECT doc, count(*) AS n_found, string_agg(DISTINCT page, ',' ORDER BY page) AS pages, count(*) || ' hidden text(s) on ' || count(DISTINCT page) || ' page(s), by ' || string_agg(DISTINCT method, ', ' ORDER BY method) AS conclusion FROM hiddens GROUP BY doc")
def hidden_report(spark, sf_dir):
    return hidden.hidden_report(all_hidden(spark, sf_dir), "doc").select("doc", "n_found", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "conclusion")


@query(f"""WITH {PSPANS}, s AS (SELECT doc, page, CAST(floor(y0 / 60) AS BIGINT) AS line, ord, trim(text, ' ') AS text, colour FROM pspans WHERE trim(text, ' ') <> ''), u AS (SELECT doc, colour, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc) AS total FROM s GROUP BY doc, colour),
common AS (SELECT doc, colour FROM u WHERE n >= greatest(2, round_even(total * 0.03, 0))), c AS (SELECT doc, page, line, colour, count(*) AS n, min(ord) AS first FROM s GROUP BY ALL), d AS (SELECT doc, page, line, first(colour ORDER BY n DESC, first) AS line_colour FROM c GROUP BY ALL HAVING count(*) > 1),
odd AS (SELECT s.*, line_colour, abs((colour >> 16 & 255) - (line_colour >> 16 & 255)) + abs((colour >> 8 & 255) - (line_colour >> 8 & 255)) + abs((colour & 255) - (line_colour & 255)) AS difference FROM s JOIN d USING (doc, page, line) WHERE colour <> line_colour AND NOT EXISTS (SELECT 1 FROM common WHERE common.doc = s.doc AND common.colour = s.colour)),
far AS (SELECT * FROM odd WHERE difference >= 15), p AS (SELECT doc, text, colour, line_colour FROM far GROUP BY ALL HAVING count(DISTINCT page) < 2) SELECT doc, page, line, ord, text, colour, line_colour, difference FROM far JOIN p USING (doc, text, colour, line_colour)""")
def colour_mismatches(spark, sf_dir):
    rows = page_spans(spark, sf_dir).withColumn("line", F.floor(F.col("y0") / 60))
    return content.colour_mismatches(rows, "doc")


_TARGETED = "(x1 - x0 >= 6 AND y1 - y0 >= 6 AND (x1 - x0) * (y1 - y0) <= 6000 AND (x1 - x0) * (y1 - y0) / 484704.0 <= 0.5)"


def _fits(fill: str) -> str:
    return f"(coalesce(len({fill}) >= 3 AND {fill}[1] > 0.85 AND {fill}[2] > 0.85 AND {fill}[3] > 0.85, false) OR coalesce(sqrt(({fill}[1] - background[1]) ** 2 + ({fill}[2] - background[2]) ** 2 + ({fill}[3] - background[3]) ** 2) < 0.15, false))"


@query(f"""WITH {PSPANS}, {RECTS}, fit AS (SELECT * FROM rects a WHERE {_TARGETED} AND {_fits('fill')} AND NOT EXISTS (SELECT 1 FROM pspans b WHERE b.ord % 50 = 0 AND b.doc = a.doc AND b.page = a.page AND {HIT})),
over AS (SELECT * FROM fit a WHERE EXISTS (SELECT 1 FROM pspans b WHERE b.ord % 3 = 1 AND b.doc = a.doc AND b.page = a.page AND {HIT})),
sized AS (SELECT *, round_even((x1 - x0) / 2, 0) AS w, round_even((y1 - y0) / 2, 0) AS h FROM over), steps AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc, page, w, h ORDER BY y0, ord) AS step FROM sized),
even AS (SELECT doc, page, w, h FROM steps GROUP BY ALL HAVING count(*) >= 3 AND avg(step) > 0 AND coalesce(stddev_samp(step), 0) / avg(step) <= 0.3),
single AS (SELECT * FROM sized s WHERE NOT EXISTS (SELECT 1 FROM even e WHERE e.doc = s.doc AND e.page = s.page AND e.w = s.w AND e.h = s.h))
SELECT doc, page, ord FROM single a WHERE seqno IS NULL OR EXISTS (SELECT 1 FROM pspans b WHERE b.ord % 3 > 0 AND b.doc = a.doc AND b.page = a.page AND {HIT} AND b.seqno < a.seqno AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.4 * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def covering_rects(spark, sf_dir):
    rows = page_spans(spark, sf_dir)
    return overlays.covering_rects(rects(spark, sf_dir), rows.where("ord % 3 = 1"), rows.where("ord % 3 > 0"), ["doc", "page"], 612.0 * 792.0, rows.where("ord % 50 = 0")).select("doc", "page", "ord")


@query(f"""WITH {PSPANS}, sized AS (SELECT doc, page, ord, 20.0 AS x0, ord * 12.0 + page % 2 * (ord * ord % 40) AS y0, 120.0 + ord % 3 * 10 AS x1, ord * 12.0 + page % 2 * (ord * ord % 40) + 10 AS y1 FROM pspans), g AS (SELECT *, round_even((x1 - x0) / 2, 0) AS w, round_even((y1 - y0) / 2, 0) AS h FROM sized), s AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc, page, w, h ORDER BY y0, ord) AS step FROM g), e AS (SELECT doc, page, w, h FROM s GROUP BY ALL HAVING count(*) >= 3 AND avg(step) > 0 AND coalesce(stddev_samp(step), 0) / avg(step) <= 0.3) SELECT doc, page, ord FROM s JOIN e USING (doc, page, w, h)""")
def row_patterns(spark, sf_dir):
    o = F.col("ord")
    y0 = o * 12.0 + F.col("page") % 2 * (o * o % 40)
    rows = page_spans(spark, sf_dir).select("doc", "page", "ord", F.lit(20.0).alias("x0"), y0.alias("y0"), (120.0 + o % 3 * 10).alias("x1"), (y0 + 10).alias("y1"))
    return overlays.row_pattern(rows, ["doc", "page"])


@query(f"WITH {PSPANS}, {RECTS} SELECT doc, page, ord FROM rects a WHERE {_TARGETED} AND EXISTS (SELECT 1 FROM pspans b WHERE b.ord % 3 > 0 AND b.doc = a.doc AND b.page = a.page AND {HIT})")
def image_overlays(spark, sf_dir):
    return overlays.image_overlays(rects(spark, sf_dir), page_spans(spark, sf_dir).where("ord % 3 > 0"), ["doc", "page"], 612.0 * 792.0).select("doc", "page", "ord")


#: Spans on few places, so that some share one exactly; texts with blanks around them.
STACKED = "stacked AS (SELECT o_orderkey // 600 AS doc, o_orderkey AS ord, CASE o_custkey % 3 WHEN 0 THEN ' t' || o_custkey % 4 ELSE 't' || o_custkey % 4 || ' ' END AS text, (o_orderkey * 7 % 9) * 60.0 AS x0, (o_orderkey * 5 % 7) * 30.0 AS y0, (o_orderkey * 7 % 9) * 60.0 + 30 + o_orderkey % 2 * 0.04 AS x1, (o_orderkey * 5 % 7) * 30.0 + 12 AS y1 FROM orders)"


def stacked(spark, sf_dir) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    x0, y0, t = (o * 7 % 9) * 60.0, (o * 5 % 7) * 30.0, F.concat(F.lit("t"), (c % 4).cast("string"))
    text = F.when(c % 3 == 0, F.concat(F.lit(" "), t)).otherwise(F.concat(t, F.lit(" ")))
    return read(spark, sf_dir, "orders").select(F.floor(o / 600).alias("doc"), o.alias("ord"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 30 + o % 2 * 0.04).alias("x1"), (y0 + 12).alias("y1"))


OVERWRITES = f"{STACKED}, k AS (SELECT *, first(trim(text, ' ')) OVER w AS first_text, first(ord) OVER w AS first_ord FROM stacked WHERE trim(text, ' ') <> '' WINDOW w AS (PARTITION BY doc, round_even(x0, 1), round_even(y0, 1), round_even(x1, 1), round_even(y1, 1) ORDER BY ord)), over AS (SELECT * FROM k WHERE trim(text, ' ') <> first_text)"


@query(f"WITH {OVERWRITES} SELECT doc, ord, first_ord, first_text FROM over a WHERE NOT EXISTS (SELECT 1 FROM stacked b WHERE b.ord % 40 = 0 AND b.doc = a.doc AND {HIT})")
def overwrites_without_ghosts(spark, sf_dir):
    rows = stacked(spark, sf_dir)
    return overlays.without_ghosts(spatial.overwritten(rows, ["doc"]), rows.where("ord % 40 = 0"), ["doc"]).select("doc", "ord", "first_ord", "first_text")


@query("""WITH c AS (SELECT l_orderkey AS span, l_linenumber AS i, l_linenumber * 6.0 + CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 30 ELSE 0 END - CASE WHEN l_orderkey % 13 = 0 THEN 7 * (l_linenumber % 2) ELSE 0 END + l_orderkey % 3 * 0.001::DOUBLE * l_linenumber AS x FROM (SELECT DISTINCT l_orderkey // 8 AS l_orderkey, (l_orderkey % 8) * 7 + l_linenumber AS l_linenumber FROM lineitem)),
w AS (SELECT *, lead(x) OVER (PARTITION BY span ORDER BY i) - x AS width, count(*) OVER (PARTITION BY span) AS n FROM c), p AS (SELECT *, count(*) OVER (PARTITION BY span) AS k, avg(width) OVER (PARTITION BY span) AS mean, stddev_samp(width) OVER (PARTITION BY span) AS std, row_number() OVER (PARTITION BY span ORDER BY i) - 1 AS j FROM w WHERE n >= 4 AND width > 0) SELECT span, j AS i, round(width, 4) AS width, round(abs(width - mean) / greatest(coalesce(std, 0), 0.01), 4) AS z FROM p WHERE k >= 3 AND abs(width - mean) / greatest(coalesce(std, 0), 0.01) >= 4""")
def char_advances(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(F.floor(k / 8).alias("s"), (k % 8 * 7 + n).alias("i")).distinct()
    s, i = F.col("s"), F.col("i")
    x = i * 6.0 + F.when((s + i) % 11 == 0, 30).otherwise(0) - F.when(s % 13 == 0, 7 * (i % 2)).otherwise(0) + s % 3 * 0.001 * i
    found = overlays.char_advances(rows.select(s.alias("span"), "i", x.alias("x")), ["span"])
    return found.select("span", "i", F.round("width", 4).alias("width"), F.round("z", 4).alias("z"))


@query(f"WITH {PSPANS}, f AS (SELECT doc, page, ord, ['image_overlay', 'ghost_text', 'covering_rect', 'char_spacing', 'coordinate_overwrite'][ord % 5 + 1] AS kind FROM pspans), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, list_position(['covering_rect', 'ghost_text', 'coordinate_overwrite', 'image_overlay', 'char_spacing'], kind), ord) AS rank FROM f) SELECT doc, page, kind, ord, rank FROM r WHERE rank <= 20")
def reported_overlays(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("image_overlay", "ghost_text", "covering_rect", "char_spacing", "coordinate_overwrite")])
    return overlays.reported(page_spans(spark, sf_dir).select("doc", "page", "ord", F.get(kinds, (F.col("ord") % 5).cast("int")).alias("kind")), "doc")


