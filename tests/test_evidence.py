"""Operators on literal rows: what is found, what is left alone, and in which order."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import sources
from palimpsest.functions import dates, fonts, lines as L
from palimpsest.operators import cluster, content, drawing, fusion, hidden, ledgers, metadata, overlays, routing, spatial, structure

SPAN = "doc int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, colour long"


def spans(spark, rows):
    """rows: page, ord, text, x0, y0, colour; a span is 60 wide and 12 high."""
    return spark.createDataFrame([(1, p, o, t, float(x), float(y), x + 60.0, y + 12.0, c) for p, o, t, x, y, c in rows], SPAN)


def test_white_boxes_hide_text(spark):
    rows = spans(spark, [(0, 1, "8,50,000", 200, 200, 0), (0, 2, "18,50,000", 201, 200, 255), (0, 3, "far away", 400, 600, 0), (1, 4, "gone", 200, 200, 0)])
    rects = spark.createDataFrame([(1, 0, 1, [1.0, 1.0, 1.0], None, 198.0, 198.0, 270.0, 214.0), (1, 1, 2, [0.85, 0.9, 0.86], None, 198.0, 198.0, 270.0, 214.0), (1, 0, 3, [0.5, 0.5, 0.5], None, 0.0, 0.0, 600.0, 700.0), (1, 0, 4, [1.0, 1.0, 1.0], None, 398.0, 598.0, 470.0, 601.0)], "doc int, page int, ord int, fill array<double>, stroke array<double>, x0 double, y0 double, x1 double, y1 double")
    found = hidden.covered_text(rects, rows, "doc")
    assert sorted((r.page, r.original, r.covering) for r in found.collect()) == [(0, "8,50,000", "18,50,000"), (1, "gone", "")]
    told = {r.page: r for r in hidden.hidden_texts([found], "doc").collect()}
    assert (told[0].replacement_type, told[1].replacement_type) == ("replaced", "missing")
    assert (told[0].field_type, told[1].field_type) == ("amount", "name")


def test_overlapping_text(spark):
    rows = spans(spark, [(0, 1, "Alice", 100, 100, 16711680), (0, 2, "Bob", 102, 100.4, 0), (0, 3, "next word", 300, 100, 0), (0, 4, "Alice", 100, 100, 16711680), (0, 5, "x", 100, 100, 0), (1, 6, "Bob", 100, 100, 0)])
    found = hidden.overlapping_text(rows, "doc").collect()
    assert [(r.page, r.original, r.covering) for r in found] == [(0, "Bob", "Alice")]  # the darker one is the original, once


def test_revisions(spark):
    rows = [(1, 0, 0, 1, "Pay 100"), (1, 0, 0, 2, "same"), (1, 0, 1, 3, "only then"), (1, 1, 0, 1, "Pay 900"), (1, 1, 0, 2, "same"), (1, 2, 0, 1, "Pay 900"), (1, 2, 0, 2, "same"), (1, 2, 0, 3, "y"), (2, 0, 0, 1, "one revision")]
    table = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "doc int, rev int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.doc, r.original, r.covering) for r in hidden.revision_changes(table, "doc").collect()] == [(1, "Pay 100", "Pay 900")]


def test_hidden_texts_of_one_beginning_count_once(spark):
    schema = "doc int, page int, method string, ord int, original string, covering string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, 0, "incremental_update", 1, "the same first twenty characters A", "n", 0.0, 0.0, 1.0, 1.0), (1, 0, "white_rectangle_cover", 9, "the same first twenty characters B", "unknown", 0.0, 0.0, 1.0, 1.0)]
    found = hidden.hidden_texts([spark.createDataFrame(rows, schema)], "doc").collect()
    assert [(r.method, r.replacement_type) for r in found] == [("white_rectangle_cover", "missing")]


def test_stacks(spark):
    rows = spans(spark, [(0, 1, "A 1", 100, 100, 0), (0, 2, "B2", 102, 101, 0), (0, 3, "A1", 104, 102, 0), (0, 4, "C", 300, 300, 0), (0, 5, "D", 300, 300, 0), (0, 6, "C", 304, 301, 0)])
    found = {r.component: r for r in cluster.stacks(rows, spatial.stacked_pairs(rows, ["doc", "page"]), ["doc", "page"]).collect()}
    assert found[1].texts == ["A 1", "B2"] and found[1].n_members == 3
    assert found[4].texts == ["C", "D"] and (found[4].a, found[4].b, found[4].overlap) == (4, 5, 1.0)


def test_long_chains_of_spans(spark):
    edges = [(0, i, i + 1) for i in range(1000)] + [(1, 5, 5)]
    found = cluster.page_components(spark.createDataFrame(edges, "page int, a int, b int"), ["page"]).groupBy("page", "component").count().collect()
    assert sorted(map(tuple, found)) == [(0, 0, 1001), (1, 5, 1)]


def test_column_clusters_of_a_dense_page(spark):
    rng = np.random.RandomState(0)
    rows = [(p, i, float(x)) for p in (0, 1) for i, x in enumerate(np.round(rng.rand(400) * 900, 1))]
    found = {}
    for r in cluster.start_clusters(spark.createDataFrame(rows, "page int, i int, x double"), ["page"], "x", "i", 40).collect():
        found[r.page, r.i] = r.cluster
    for p in (0, 1):
        start, number = None, -1
        for _, i, x in sorted((r for r in rows if r[0] == p), key=lambda r: r[2]):
            if start is None or x - start > 40:
                start, number = x, number + 1
            assert found[p, i] == number


def test_groups_of_findings():
    nan = np.nan
    page = np.array([0, 0, 0, 1, 0, 0.0])
    line = np.array([3, 3, nan, 3, nan, nan])
    box = np.array([[0, 0, 10, 10], [400, 400, 410, 410], [60, 0, 70, 10], [0, 0, 10, 10], [5, 5, 6, 6], [nan] * 4])
    assert fusion.groups(page, line, box, np.array([False] * 6)).tolist() == [0, 0, 1, 2, 0, 0]
    # what lies anywhere joins the first group only
    assert fusion.groups(page, line, box, np.array([False] * 5 + [True])).tolist() == [0, 0, 1, 2, 0, 0]
    # groups don't grow: the third is near the second's box, not the anchor's
    chain = np.array([[0, 0, 10, 10], [45, 0, 55, 10], [90, 0, 100, 10.0]])
    assert fusion.groups(np.zeros(3), np.full(3, nan), chain, np.zeros(3, bool)).tolist() == [0, 0, 1]


def test_fused_confidence(spark):
    rows = [(1, "content", 0, 0, 0, 10.0), (1, "ela", 2, 1, 0, 12.0), (1, "pymupdf", 3, 2, 0, 14.0), (1, "ela", 2, 3, 5, 300.0), (2, "numeric", 1, 0, 0, 10.0), (2, "metadata", 5, 1, 0, None), (3, "content", 0, 0, 0, None), (3, "ela", 2, 0, 0, None)]
    table = spark.createDataFrame([(d, layer, k, o, p, None, None, 0.5, x, x, None if x is None else x + 10, None if x is None else x + 10) for d, layer, k, o, p, x in rows], "doc int, layer string, layer_ord int, ord int, page int, line int, text string, score double, x0 double, y0 double, x1 double, y1 double")
    found = {r.doc: r for r in fusion.fused(fusion.grouped(table, "doc"), "doc").collect()}
    assert (found[1].confidence, found[1].score, found[1].layers) == ("HIGH", 90, ["content", "ela", "pymupdf"]) and (found[1].x0, found[1].x1) == (10.0, 24.0)
    assert (found[2].confidence, found[2].score) == ("HIGH", 85) and (found[3].confidence, found[3].score) == ("MEDIUM", 70)
    assert (found[3].x0, found[3].y0, found[3].x1, found[3].y1) == fusion.FALLBACK
    stats = {r.doc: (r.total, r.groups, r.agreed, r.single) for r in fusion.fusion_stats(fusion.grouped(table, "doc"), "doc").collect()}
    assert stats == {1: (4, 2, 1, 1), 2: (2, 1, 1, 0), 3: (2, 1, 1, 0)}


def test_structural_lines(spark):
    lines = [("Net pay of this month is", False), ("Company expands", True), ("PAN AB12", False), ("ABOUT THE COMPANY AND ITS PEOPLE", True), ("12/03/2024", True), ("one two three four five six seven", False), ("a b : c d e f g h i j k", True), ("* * * * * * * *", True), ("call +91 98765 43210 now and then please", True), ("it is near the village of his fathers", True)]
    rows = spark.createDataFrame([(1, 2, i, t, 12.0) for i, (t, _) in enumerate(lines)], "doc int, page int, line int, text string, line_height double")
    assert [r.structural for r in content.structural_lines(rows, "doc").orderBy("line").collect()] == [k for _, k in lines]


def test_form_fields_and_references(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(L.is_form_field(F.lit("Date: ____"))) and one(L.is_form_field(F.lit("Signature :"))) and not one(L.is_form_field(F.lit("The date is set")))
    assert one(L.is_gap_field(F.lit("For Acme Works Ltd,"))) and not one(L.is_gap_field(F.lit("For Acme Works Ltd")))
    numbers = [(2024.0, "paid 2024", False), (2024.0, "FY 2024", True), (2024.0, "on 1/2/2024", True), (400069.0, "Andheri, 400069", True), (400069.0, "Rs. 400069", False), (123456789.0, "sum 123456789", True), (12.5, "UPI 12.5", True), (500.0, "paid to company", False), (7.0, "id 7", True)]
    rows = spark.createDataFrame(numbers, "v double, t string, k boolean")
    assert [r.x for r in rows.select(L.is_id_number(F.col("v"), F.col("t")).alias("x")).collect()] == [k for *_, k in numbers]


def test_line_gaps(spark):
    def page(doc, gaps, texts=None):
        rows, y = [], 0.0
        for i, g in enumerate(gaps):
            y += g
            rows.append((doc, 0, i, (texts or {}).get(i, "some words in this line"), y, y + 10))
            y += 10
        return rows

    normal = [0, 4, 5, 6, 4, 5, 6, 4, 5, 6]
    rows = page(1, normal + [60, 5]) + page(2, normal) + page(3, [5] * 9 + [60]) + page(4, normal + [60, 61.5, 63]) + page(5, normal + [60], {10: "Signature:"})
    found = content.line_gaps(spark.createDataFrame(rows, "doc int, page int, line int, text string, y0 double, y1 double"), "doc").collect()
    assert [(r.doc, r.line, r.gap) for r in found] == [(1, 10, 60.0)]


def test_line_gaps_of_a_spread_at_the_limit(spark):
    y, rows = 0.0, []
    for i, gap in enumerate([0, 7.625, 8.75, 10.625, 6.5, 8.0, 8.75, 8.375, 7.625, 8.0, 8.75, 7.625]):  # a spread of 0.5 without the ends
        rows.append((1, 0, i, "some words in this line", y + gap, y + gap + 10))
        y = rows[-1][-1]
    table = spark.createDataFrame(rows, "doc int, page int, line int, text string, y0 double, y1 double")
    for n in (1, 4):
        assert [tuple(r) for r in content.line_gaps(table.repartition(n, "line"), "doc").collect()] == [(1, 0, 3, 10.6, 8.2, 4.92)]


SIZES_AT_THE_LIMIT = [12.0, 11.25, 13.0, 11.5, 11.0, 12.25, 11.25, 12.5, 11.5]  # the largest is 2.5 deviations from the others' mean, and a rounding more in ascending order


def sized_lines(spark):
    rows = [(1, 1, i, f"word{i} and quite a few other plain words", "Helvetica", size) for i, size in enumerate(SIZES_AT_THE_LIMIT)]
    return spark.createDataFrame(rows, "doc int, page int, line int, text string, font string, font_size double").withColumn("line_height", F.lit(12.0))


def test_suspicious_size_at_the_limit(spark):
    for n in (1, 4):
        found = content.suspicious_lines(sized_lines(spark).repartition(n, "line"), "doc").collect()
        assert [(r.line, r.reasons) for r in found] == [(2, ["font_size"])]


def test_reported_size_at_the_limit(spark):
    found = content.reported_lines(content.suspicious_lines(sized_lines(spark).repartition(3, "line"), "doc"), "doc").collect()
    assert [(r.line, r.rank, r.reasons) for r in found] == [(2, 1, ["font_size"])]


def test_suspicious_font_and_size(spark):
    rows = [(1, 1, i, f"word{i} and quite a few other plain words", "Helvetica", 11 + i % 3 * 0.1, 12.0) for i in range(20)]
    rows += [(1, 1, 20, "the sum of it was changed by someone", "Courier", 11.0, 12.0), (1, 1, 21, "gross pay of the person in question", "Courier", 30.0, 12.0), (1, 1, 22, "bold words of the family are fine here", "Helvetica-Bold", 11.0, 12.0), (1, 1, 23, "total days in the month were thirty one", "Courier", 40.0, 12.0)]
    found = {r.line: r for r in content.suspicious_lines(spark.createDataFrame(rows, "doc int, page int, line int, text string, font string, font_size double, line_height double"), "doc").collect()}
    assert sorted(found) == [20, 21] and found[20].reasons == ["font"] and found[20].score == pytest.approx(0.4)
    assert found[21].reasons == ["font", "font_size"] and found[21].score == pytest.approx(0.95)


def test_colours(spark):
    body = [(1, p, i, o, f"w{p}{i}{o}", 0) for p in (0, 1) for i in range(10) for o in range(4)]
    odd = [(1, 0, 3, 9, "changed", 0x303030), (1, 0, 4, 9, "footer", 0x404040), (1, 1, 4, 9, "footer", 0x404040), (1, 0, 5, 9, "nearly black", 0x010203)]
    rows = spark.createDataFrame(body + odd, "doc int, page int, line int, ord int, text string, colour long")
    assert [(r.text, r.difference) for r in content.colour_mismatches(rows, "doc").collect()] == [("changed", 144)]


def test_colours_of_more_than_31_bits(spark):
    values = [0x12345678, 2188684896, 9502792081, -1]
    rows = spark.createDataFrame([(c,) for c in values], "colour long")
    assert [tuple(r) for r in rows.select(*fonts.rgb(F.col("colour"))).collect()] == [tuple((c >> s) & 255 for s in (16, 8, 0)) for c in values]


def test_ledger_of_a_payslip(spark):
    rows = [(1, 0, 0, "Basic Salary", 1000.0), (1, 0, 1, "HRA", 500.0), (1, 0, 2, "Gross", 1500.0), (1, 0, 3, "Total deductions", 200.0), (1, 0, 4, "Net pay", 5000.0), (2, 0, 0, "Opening balance", 10.0), (2, 0, 1, "Total deposits", 5.0), (2, 0, 2, "Total withdrawals", 3.0), (2, 1, 0, "Closing balance", 12.0), (3, 0, 0, "helpful remarks", 5.0)]
    found = ledgers.arithmetic_checks(spark.createDataFrame(rows, "doc int, page int, line int, text string, value double"), "doc").collect()
    assert [(r.doc, r.check, r.expected, r.stated, r.confidence, r.line) for r in found] == [(1, "net_pay_equation", 1300.0, 5000.0, "HIGH", 4)]


def test_statement_rows(spark):
    entries, balance = [], 1000.0
    for i in range(8):
        out = i % 2 == 0
        balance += -10.0 if out else 20.0
        entries += [(1, 0, i, 0, 300.0 + i % 3 if out else 400.0, 10.0 if out else 20.0), (1, 0, i, 1, 500.0, balance + (700 if i == 5 else 0))]
    table = spark.createDataFrame(entries, "doc int, page int, line int, ord int, x double, value double")
    said = spark.createDataFrame([(1, "Closing balance")], "doc int, text string")
    found = ledgers.statement_balances(table, said, "doc").orderBy("line").collect()
    assert [(r.line, r.diff, r.confidence) for r in found] == [(5, 700.0, "MEDIUM"), (6, 700.0, "MEDIUM")]
    assert ledgers.transactions(table.where("line < 4"), "doc").count() == 0


def test_covering_rectangles(spark):
    schema = "page int, ord int, x0 double, y0 double, x1 double, y1 double, fill array<double>, background array<double>, seqno int"
    white, grey = [1.0, 1.0, 1.0], [0.5, 0.5, 0.5]
    rows = [(0, 1, 10.0, 10.0, 110.0, 25.0, white, None, 9), (0, 2, 10.0, 10.0, 110.0, 25.0, white, None, 1), (0, 3, 10.0, 10.0, 110.0, 25.0, grey, [0.55, 0.5, 0.5], 9), (0, 4, 10.0, 10.0, 110.0, 25.0, grey, None, 9), (0, 5, 0.0, 0.0, 600.0, 700.0, white, None, 9), (0, 6, 10.0, 300.0, 120.0, 315.0, white, None, 9), (0, 7, 10.0, 10.0, 115.0, 27.0, white, None, None)]
    rows += [(0, 20 + i, 300.0, 100.0 + 20 * i, 420.0, 115.0 + 20 * i, white, None, 9) for i in range(4)]
    texts = spark.createDataFrame([(0, 1, 12.0, 11.0, 100.0, 23.0, 5)] + [(0, 2 + i, 305.0, 102.0 + 20 * i, 390.0, 112.0 + 20 * i, 5) for i in range(4)], "page int, ord int, x0 double, y0 double, x1 double, y1 double, seqno int")
    found = overlays.covering_rects(spark.createDataFrame(rows, schema), texts, texts, ["page"], 612.0 * 792)
    assert sorted(r.ord for r in found.collect()) == [1, 3, 7]


def test_metadata_points(spark):
    base = {"producer": "Foo", "creator": "Bar", "author": "Jane", "xmp_producer": None, "delta_seconds": None, "was_modified": False, "xmp_mismatch": False, "multiple_producers": False, "stripped": False, "rotation_anomaly": False, "xmp_date_mismatch": False, "suspicion": "LOW"}
    cases = [({}, 0), ({"suspicion": "HIGH"}, 40), ({"suspicion": "UNKNOWN"}, 15), ({"producer": "ReportLab", "creator": "anonymous", "suspicion": "HIGH"}, 0), ({"producer": None, "creator": "", "suspicion": "UNKNOWN"}, 0), ({"producer": "", "creator": None, "suspicion": "UNKNOWN", "xmp_mismatch": True}, 45), ({"delta_seconds": 90.0, "was_modified": True}, 5), ({"delta_seconds": 2.0, "suspicion": "UNKNOWN"}, 45), ({"author": "", "delta_seconds": 90.0, "was_modified": True}, 20), ({"author": "user", "creator": "(unspecified)", "delta_seconds": 90.0, "was_modified": True, "suspicion": "UNKNOWN"}, 80), ({"xmp_producer": "foo"}, 0), ({"xmp_producer": "Baz"}, 15), ({"stripped": True, "xmp_mismatch": True, "xmp_date_mismatch": True, "rotation_anomaly": True, "multiple_producers": True}, 100)]
    schema = "i int, producer string, creator string, author string, xmp_producer string, delta_seconds double, was_modified boolean, xmp_mismatch boolean, multiple_producers boolean, stripped boolean, rotation_anomaly boolean, xmp_date_mismatch boolean, suspicion string"
    rows = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    assert [r.metadata for r in metadata.metadata_score(rows).orderBy("i").collect()] == [k for _, k in cases]


def test_dates_and_ages(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    at = datetime.datetime(2024, 7, 9, 10, 11, 12)
    for text, found in (("D:20240709101112+05'30'", at), ("2024-07-09T10:11:12Z", at), ("2024-07-09", datetime.datetime(2024, 7, 9)), ("D:20241309101112", None), ("soon", None), (None, None)):
        assert one(dates.pdf_date(F.lit(text))) == found
    now = F.to_timestamp(F.lit("2024-07-10 10:11:12"))
    age = one(dates.edit_age(F.to_timestamp(F.lit("2024-07-09 10:11:12")), now))
    assert (age.days_ago, age.human_readable, age.risk_factor, age.is_recent) == (1, "1 day ago", 1.2, False)
    assert one(fonts.base_family(F.lit("ABCDEF+Times-BoldItalic"))) == one(fonts.base_family(F.lit("Times-Roman"))) == "times"


def test_kinds_of_documents(spark):
    pages = spark.createDataFrame([(1, 0, 500, 90, 0, 0), (1, 1, 400, 80, 0, 0), (2, 0, 0, 0, 0, 1), (2, 1, 0, 0, 0, 1), (2, 2, 5, 1, 0, 1), (2, 3, 0, 0, 0, 1), (3, 0, 5, 1, 40, 0), (4, 0, 500, 90, 0, 0), (5, 0, 500, 90, 0, 0), (5, 1, 0, 0, 0, 1)], "doc int, page int, n_chars int, n_words int, n_paths int, n_images int")
    meta = spark.createDataFrame([(1, "Word", None), (4, None, "Canon iR"), (2, "x", "y")], "doc int, producer string, creator string")
    found = {r.doc: r for r in routing.document_types(pages, meta, "doc").collect()}
    assert {d: r.pdf_type for d, r in found.items()} == {1: "native_text", 2: "scanned", 3: "scanned", 4: "scanned_native", 5: "mixed"}
    assert found[2].image_based and found[2].compiled and not found[1].image_based and not found[2].converted
    routed = routing.scanned_pages(pages, routing.document_types(pages, meta, "doc"), "doc")
    assert sorted((r.doc, r.page) for r in routed.collect()) == [(2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (4, 0), (5, 1)]


def test_signatures(spark):
    files = spark.createDataFrame([(1, 1000, 1, 5), (2, 1000, 2, 5), (3, 1000, 1, 9)], "doc int, size int, eof int, modified_at int")
    signed = spark.createDataFrame([(1, 0, 300, 400, 600, 7), (2, 0, 300, 400, 500, 7), (3, 0, 300, 400, 600, 7)], "doc int, start1 int, length1 int, start2 int, length2 int, signed_at int")
    assert {r.doc: (r.shadow, r.signature) for r in structure.signature_scores(signed, files, "doc").collect()} == {1: (0, 0), 2: (100, 70), 3: (0, 50)}


def test_merged_boxes_grow(spark):
    rows = [(1, 0, 1, "missing", ["a"], 0.0, 0.0, 10.0, 10.0), (1, 0, 2, "missing", ["b"], 30.0, 0.0, 40.0, 10.0), (1, 0, 3, "replaced", ["a", "c"], 5.0, 5.0, 35.0, 8.0), (1, 0, 4, "missing", ["d"], 20.0, 6.0, 25.0, 9.0)]
    boxes = drawing.merged_boxes(spark.createDataFrame(rows, "doc int, page int, ord int, kind string, texts array<string>, x0 double, y0 double, x1 double, y1 double"), "doc")
    assert sorted((r.grp, r.kind, r.texts, r.x1) for r in boxes.collect()) == [(0, "replaced", ["a", "c", "d"], 35.0), (1, "missing", ["b"], 40.0)]


PDF = b"""%PDF-1.6
1 0 obj
<< /Title (A \\(b\\)) /Producer (Foo) /CreationDate (D:20240102030405) >>
endobj
2 0 obj
<< /Length 60 >> stream
BT (Hello) Tj [(Wor) -20 (ld)] TJ ET
endstream endobj
xref
trailer << /ID [<AB12> <CD34>] >>
startxref
99
%%EOF
1 0 obj
<< /Title (Later) /Producer (Foo) >>
endobj
3 1 obj
<< /Type /Annot /Subtype /FreeText /ByteRange [0 10 20 30] >>
endobj
xref
trailer << /Prev 99 /OpenAction 5 0 R >>
startxref
300
%%EOF
"""


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(PDF)
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    files = sources.uploads(spark, str(tmp_path)).where("ext = 'pdf'")
    facts = sources.raw_facts(files).first()
    assert (facts.version, facts.eof, facts.xrefs, facts.startxrefs, facts.prev, facts.notes, facts.open_action, facts.encrypted) == ("1.6", 2, 2, 2, 99, 1, True, False)
    assert facts.trailer_ids == ["AB12", "CD34"] and facts.size == len(PDF)
    objects = sources.raw_objects(files).orderBy("ord").collect()
    assert [(r.objid, r.gen) for r in objects] == [(1, 0), (2, 0), (1, 0), (3, 1)] and all(PDF[r.offset :].startswith(str(r.objid).encode()) for r in objects)
    assert [(r.objid, r.versions, r.first_offset) for r in sources.object_versions(sources.raw_objects(files)).collect()] == [(1, 2, objects[0].offset)]
    info = sources.information(files).first()
    assert (info.title, info.producer, info.created, info.xmp_producer) == ("Later", "Foo", "D:20240102030405", None)
    assert [r.text for r in sources.shown_text(files).orderBy("ord").collect()] == ["Hello", "World"]
    signed = sources.signatures(files).first()
    assert (signed.start1, signed.length1, signed.start2, signed.length2) == (0, 10, 20, 30)
    earlier = sources.revision_bytes(files).orderBy("rev").collect()
    assert len(earlier) == 2 and bytes(earlier[0].content).endswith(b"%%EOF\n") and len(earlier[0].content) < len(PDF) and bytes(earlier[1].content) == PDF
    with pytest.raises(ValueError):
        sources.images(spark, str(tmp_path))
    (tmp_path / "a.pdf").unlink()
    assert sources.images(spark, str(tmp_path)).count() == 1


def test_tools_from_a_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"producers": [{"pattern": "foo", "name": "Foo", "suspicion": "HIGH", "category": "online_editor"}, {"pattern": "fo", "name": "Fo", "suspicion": "LOW", "category": "x"}]}')
    known = metadata.producers(spark, str(tmp_path / "p.json"))
    docs = spark.createDataFrame([(1, "FOO Writer", None), (2, None, "fox"), (3, "", None)], "doc int, producer string, creator string")
    assert {r.doc: (r.name, r.suspicion, r.is_online_tool) for r in metadata.identified(docs, known, "doc").collect()} == {1: ("Foo", "HIGH", True), 2: ("Fo", "LOW", False), 3: ("Unknown", "UNKNOWN", False)}


def test_quantisation_tables(spark, tmp_path):
    body = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xdb\x00\x43\x00" + bytes(range(1, 65)) + b"\xff\xdb\x00\x83\x11" + b"".join(i.to_bytes(2, "big") for i in range(300, 364)) + b"\xff\xda\x00\x02"
    (tmp_path / "a.jpg").write_bytes(body)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xdb\x00")
    found = sources.quantisation(sources.images(spark, str(tmp_path))).orderBy("number").collect()
    assert [(r.number, r.steps[0], r.steps[-1]) for r in found] == [(0, 1, 64), (1, 300, 363)]
