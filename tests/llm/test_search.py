"""The permutation index where it is an index: several blocks, far more vectors than are ranked."""

import numpy as np
import pytest

from palimpsest.llm import permutation_index as P


def recall(spark, x, k, **options):
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in P.search(vectors, vectors.where("vec_id % 50 = 0"), k, **options).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert len(found) == len(range(0, len(x), 50)) and all(len(v) == k for v in found.values())
    hits = 0
    for q, got in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(got) & set(np.lexsort((np.arange(len(x)), -score))[:k].tolist()))
    return hits / (k * len(found))


@pytest.mark.parametrize("norms", ["equal", "varied"])
def test_recall_on_several_blocks(spark, norms):
    rng = np.random.RandomState(5)
    x = rng.randn(6000, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "varied":
        x *= np.exp(0.5 * rng.randn(len(x)))[:, None]
    # of a block of 2,000 vectors 200 are ranked exactly
    assert P.WANTED * 4 < 200 == int(P.SHARE * 2000)
    assert recall(spark, x, 4, block=2000) >= 0.9


def test_files_are_read_in_part():
    """A query reads the files of its own list only, a quarter of the entries, and the credit is the footrule of the lists."""
    rng = np.random.RandomState(1)
    x = rng.randn(500, 16)
    pivots = P.Pivots(x[:96], np.linalg.norm(x, axis=1).max(), 24)
    files = P.Files(x, pivots)
    assert (files.place != P.FAR).sum() == 500 * 24
    lists = pivots.lists(x)
    wanted = pivots.lists(x[7:8], query=True)[0]
    credit = files.credit(wanted)
    for i in (0, 7, 100, 499):
        place = {p: j for j, p in enumerate(lists[i])}
        assert credit[i] == sum(24 - abs(j - place[p]) for j, p in enumerate(wanted) if p in place)
    assert len(wanted) == 24 and P.Files(x, P.Pivots(x[:9], 5.0, 3)).credit(np.array([0, 1, 2])).max() <= 9


def test_blocks_of_pivots():
    first, parts = P.block_names(np.array([5, 3, 4, 0, 25, 1, 9]), 10)
    assert first.tolist() == [0, 0, 1, 1, 2, 5, 5] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1]


def test_blocks_that_cannot_hold_a_neighbour():
    rng = np.random.RandomState(2)
    centres = 50 * rng.randn(20, 8)
    blocks = [c + 0.1 * rng.randn(100, 8) for c in centres]
    rows = [(i, b.mean(0).tobytes(), float(np.sqrt(((b - b.mean(0)) ** 2).sum(1).max()))) for i, b in enumerate(blocks)]
    bounds = P.Regions(rows).bounds(blocks[3][0])
    assert all((b @ blocks[3][0]).max() <= bound for b, bound in zip(blocks, bounds))
    kth = np.sort(blocks[int(np.argmax(bounds))] @ blocks[3][0])[-20]
    assert (bounds >= kth).sum() <= 3


def test_odd_vectors(spark):
    rng = np.random.RandomState(0)
    rows = [(i, rng.randn(3).tolist()) for i in range(50)] + [(100, [1.0]), (101, [0.5]), (0, None), (3, rows_3 := [1.0, 1.0, 1.0]), (3, rows_3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = P.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    assert sorted({r.query_id for r in found}) == [0, 20, 40] and len(found) == 60
    few = vectors.where("vec_id < 5")
    assert {(r.query_id, r["rank"]) for r in P.search(few, few, 20).collect()} == {(q, r) for q in range(5) for r in range(1, 6 if q != 3 else 5)}


def test_equal_vectors(spark):
    """A third of all rows are one vector: ties go to the smaller ids, and each query leaves itself out."""
    x = np.random.RandomState(4).randn(300, 8)
    x[100:200] = 9 * np.sign(x[100])
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in P.search(vectors, vectors.where("vec_id in (100, 150, 199)"), 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {100: [101, 102, 103, 104, 105], 150: [100, 101, 102, 103, 104], 199: [100, 101, 102, 103, 104]}
