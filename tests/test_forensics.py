"""Queries against their SQL on the smallest tables, and operators on literal rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions.numeric import clean_number, currency_value, field_type, texts_differ
from palimpsest.operators import cluster, layers, outliers, spatial, verdicts

DATA = "/root/testdata/sf0.001"


def plain(frame):
    def one(x):
        if x is None or str(x) in ("<NA>", "NaT") or x != x:
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(one(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DATA).toPandas()
    expected = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_numbers_in_words(spark):
    rows = [("8,500", 8500.0), ("(12.5)", 12.5), ("8,50,000", None), ("A12", None), ("12a", None), ("12.Cr", 12.0), ("", None), ("₹72,910", 72910.0)]
    out = spark.createDataFrame(rows, "w string, v double").select("w", "v", clean_number(F.col("w")).alias("x")).collect()
    assert [r.x for r in out] == [r.v for r in out]


def test_amounts_and_differences(spark):
    rows = [("8,50,000", "18,50,000", True), ("₹8,50,000", "8,50,000.00", False), ("a b", "ab", False), ("A1", "B1", True), (" ", "x", False)]
    out = spark.createDataFrame(rows, "a string, b string, d boolean").select("d", texts_differ(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in out] == [r.d for r in out]
    assert spark.range(1).select(currency_value(F.lit("Rs.8,50,000"))).first()[0] == 850000.0


def test_field_types(spark):
    rows = [("8,50,000", "amount"), ("09/07/2024 x", "date"), ("AB123", "id_number"), ("John Doe", "name"), ("12 Main Street", "address"), ("#?", "unknown")]
    out = spark.createDataFrame(rows, "t string, k string").select("k", field_type(F.col("t")).alias("x")).collect()
    assert [r.x for r in out] == [r.k for r in out]


def test_stacked_spans(spark):
    box = "page int, ord int, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [(0, 1, "8,50,000", 200, 200, 260, 212), (0, 2, "18,50,000", 200, 200, 260, 212), (0, 3, "Net Pay:", 10, 10, 60, 22), (1, 4, "x", 200, 200, 260, 212), (0, 5, "8,50,000 ", 200, 200, 260, 212)]
    found = spatial.stacked_pairs(spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], box), ["page"])
    assert sorted((r.a_ord, r.b_ord) for r in found.collect()) == [(1, 2), (2, 5)]


def test_leave_one_out_small_groups(spark):
    rows = [("g", i, v) for i, v in enumerate([10.0, 11.0, 10.5, 500.0])] + [("h", 0, 1.0)]
    found = {(r.g, r.i): r for r in outliers.leave_one_out(spark.createDataFrame(rows, "g string, i int, value double"), ["g"], ["i"]).collect()}
    assert found["g", 3].z == pytest.approx((500 - 10.5) / 0.5)
    assert [r.i for r in outliers.outliers(spark.createDataFrame(rows, "g string, i int, value double"), ["g"], ["i"], ["i"]).collect()] == [3]


def test_start_clusters(spark):
    rows = [(0, i, float(x)) for i, x in enumerate([0, 30, 41, 80, 90])]
    found = cluster.start_clusters(spark.createDataFrame(rows, "page int, i int, x double"), ["page"], "x", "i", 40).orderBy("x").collect()
    assert [r.cluster for r in found] == [0, 0, 1, 1, 2]  # against the cluster's first value, not the last


def test_page_components_of_long_chains(spark):
    edges = [(0, i, i + 1) for i in range(100)] + [(1, i, i + 1) for i in range(3)]
    found = cluster.page_components(spark.createDataFrame(edges, "page int, a int, b int"), ["page"]).collect()
    assert sorted((r.page, r.v, r.component) for r in found) == [(p, v, 0) for p, n in ((0, 101), (1, 4)) for v in range(n)]


def test_timeline(spark):
    rows = [("Offer of 09 July 2018 and 1/2/2026", 2), (None, 0), ("2024-07-09", 0)]
    out = verdicts.timeline(spark.createDataFrame(rows, "t string, k int"), "t", F.lit(2024)).collect()
    assert [r.timeline for r in out] == [45, 0, 0]


def test_weights_sum_to_one():
    assert all(abs(sum(row) - 1) < 1e-9 for row in verdicts.WEIGHTS.values())


def test_stream_equals_batch(spark, tmp_path):
    from palimpsest.streaming import windowed_counts

    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type", "value")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("counted").collect())) == sorted(map(key, windowed_counts(events).collect()))


def test_raw_objects(spark, tmp_path):
    from palimpsest import sources

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n1 1 obj\nendobj\n2 0 obj\n%%EOF\n%%EOF")
    (tmp_path / "b.txt").write_bytes(b"1 0 obj")
    files = sources.uploads(spark, str(tmp_path))
    objects = sources.raw_objects(files)
    assert objects.count() == 3 and {r.eof_marks for r in objects.collect()} == {2}
    assert [(r.objid, r.versions) for r in sources.object_versions(objects).collect()] == [(1, 2)]


def test_overlay_score_caps(spark):
    rows = [("a", "ghost_text")] * 3 + [("b", "text_stacking")] * 3 + [("c", None), ("c", "other")] + [("d", "covering_rect"), ("d", "image_overlay")]
    rows += [("e", "covering_rect")] * 3 + [("e", "ghost_text")] * 2 + [("e", "text_stacking")]
    out = layers.overlay_score(spark.createDataFrame(rows, "doc string, kind string"), ["doc"], "kind").collect()
    assert {r.doc: (r.n_findings, r.score) for r in out} == {"a": (3, 70), "b": (3, 80), "c": (0, 0), "d": (2, 45), "e": (6, 100)}


def test_content_score_by_hand(spark):
    schema = "doc string, font string, anomaly double, off_colour boolean, gap_before boolean, mixed boolean"
    rows = [("a", f, 0.0, False, False, False) for f in "wxyz"] + [("b", "w", 0.5, True, True, True), ("b", "w", 0.51, False, False, None)]
    rows += [("c", None, None, None, None, None)] + [("d", "w", 0.9, True, True, True)] * 9 + [("e", "w", 0.3, False, True, False)]
    out = layers.content_score(spark.createDataFrame(rows, schema), ["doc"]).collect()
    assert {r.doc: r.score for r in out} == {"a": 15.0, "b": 25 + 12 + 5 + 10 + 10.0, "c": 0.0, "d": 100.0, "e": 10.0}
    assert layers.content_score(spark.createDataFrame([], schema), ["doc"]).count() == 0
