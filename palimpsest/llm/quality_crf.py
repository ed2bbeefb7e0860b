"""Document quality from a linear-chain conditional random field over lines.

Every line has a state, good or bad. Its features are measured on its own bytes and words and
on those of the lines before and after it; the two states' transition weights tie neighbours together. The field
is fitted on labelled documents, whose label all their lines take, by gradient steps on the likelihood.
Forward-backward gives each line's probability of being bad; their means weighted by line length,
and the probability of the worst stretch, go through logistic regression to the score.

The fit takes FIT documents at most, none longer than FIT_TEXT bytes, and of these so many that their lines' features fit into FIT_BYTES; of each such document all
lines. Scores cover whole texts of any length.

Defined cases: null or empty texts have one empty line; with labels of one class only all texts get that
class's share; repeated rows each give a row, and one of an id is learned from, with the largest of its labels; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _text as T
from ._labels import Logistic, labelled, remainder

#: Documents that the field and the regression are fitted on, half each.
FIT = 6000
#: Bytes of the longest text that is learned from, and of all features that are.
FIT_TEXT, FIT_BYTES = 1 << 20, 256 << 20
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
N_OWN = 14
_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "mark": (_BYTES > 32) & (_BYTES < 127) & ~((_BYTES >= 48) & (_BYTES <= 57)) & ~((_BYTES >= 65) & (_BYTES <= 90)) & ~((_BYTES >= 97) & (_BYTES <= 122)),
    "blank": (_BYTES == 32) | (_BYTES == 9),
    "bar": (_BYTES == ord("|")),
    "high": _BYTES >= 128,
}


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the rows' offsets in lines; a row of n line feeds has n + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    per = np.searchsorted(breaks, offsets)
    counts = np.diff(per) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first, last = bounds[:-1], bounds[1:] - 1
    inner_start, inner_end = np.ones(len(starts), bool), np.ones(len(starts), bool)
    inner_start[first], inner_end[last] = False, False
    starts[first], ends[last] = offsets[:-1], offsets[1:]
    starts[inner_start], ends[inner_end] = breaks + 1, breaks
    return starts, ends, bounds


def own_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N_OWN features of every line, the rows' offsets in lines and the lines' sizes in bytes."""
    starts, ends, bounds = line_bounds(data, offsets)
    size = ends - starts
    n = np.maximum(size, 1)
    out = np.empty((len(starts), N_OWN))
    out[:, 0] = np.log1p(size)
    sums = np.zeros(len(data) + 1, np.int64)
    for i, table in enumerate(_IS.values()):
        np.cumsum(table[data], out=sums[1:])
        out[:, 1 + i] = (sums[ends] - sums[starts]) / n
    same = np.zeros(len(data) + 1, np.int64)
    if len(data) > 1:
        same[2:] = np.cumsum((data[1:] == data[:-1]) & _IS["mark"][data[1:]])
    out[:, 7] = (same[ends] - same[np.minimum(starts + 1, ends)]) / n
    w_start, w_end, _ = T.word_bounds(data, offsets, T.SPACED)
    # words that hold a line feed don't exist, so each lies in one line
    per = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    words = per[1] - per[0]
    out[:, 8] = np.log1p(words)
    key = T.hash_words(data, w_start, w_end)
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], key[1:] == key[:-1]]))]) if len(key) else np.zeros(1, np.int64)
    out[:, 9] = (again[per[1]] - again[np.minimum(per[0] + 1, per[1])]) / np.maximum(words, 1)
    out[:, 10] = (size - words) / np.maximum(words, 1) / 10
    line = T.hash_words(data, starts, ends)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((np.arange(len(line)), line, row))
    repeat = np.zeros(len(line), bool)
    if len(line) > 1:
        repeat[order[1:]] = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    out[:, 11] = repeat & (size > 0)
    tail = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(ends), np.uint8)
    out[:, 12] = (size > 0) & np.isin(tail, np.frombuffer(b".!?;:\"')", np.uint8))
    # how far the words of a line are different ones: distinct neighbours of neighbours
    if len(key) > 2:
        two = np.concatenate([[0], np.cumsum(np.concatenate([[False, False], key[2:] == key[:-2]]))])
        out[:, 13] = (two[per[1]] - two[np.minimum(per[0] + 2, per[1])]) / np.maximum(words, 1)
    else:
        out[:, 13] = 0
    return out, bounds, size


def with_neighbours(own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Own features, squares of the shares, those of the lines before and after, and a one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.column_stack([own, own[:, 1:12] ** 2, own[:, 1:12] > 0.02, before, after, np.ones(len(own))])


def chains(bounds: np.ndarray):
    """Rows by falling length, and for each step the lines at that place of the rows still going on."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    return [start[:k] + t for t, k in enumerate(active)]


def forward_backward(emit: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the bad state of each line, and of each pair of states of a line and the one before (zeros at a row's first line).

    emit: log potentials of the bad against the good state; move: 2 x 2 log potentials.
    """
    m = np.exp(move - move.max())
    own = np.stack([np.exp(-np.maximum(emit, 0)), np.exp(np.minimum(emit, 0))], 1)
    steps = chains(bounds)
    alpha, beta = np.empty_like(own), np.ones_like(own)
    for t, at in enumerate(steps):
        a = own[at] if t == 0 else (alpha[at - 1] @ m) * own[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for at in reversed(steps[1:]):
        b = (beta[at] * own[at]) @ m.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    pair = np.zeros((len(emit), 2, 2))
    inner = np.ones(len(emit), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = alpha[at - 1][:, :, None] * m[None] * (own[at] * beta[at])[:, None, :]
        pair[at] = joint / joint.sum((1, 2), keepdims=True)
    return p[:, 1], pair


class Field:
    """Weights of the conditional random field."""

    def __init__(self, x: np.ndarray, bounds: np.ndarray, bad: np.ndarray, size: np.ndarray):
        """bad: of each line, as its document is labelled."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        z = (x - self.mean) / self.scale
        w, move = np.zeros(z.shape[1]), np.zeros((2, 2))
        y = bad.astype(float)
        inner = np.ones(len(y), bool)
        inner[bounds[:-1]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (bad[at - 1].astype(int), bad[at].astype(int)), 1)
        mean, square = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
        for step in range(1, STEPS + 1):
            p, pair = forward_backward(z @ w, move, bounds)
            slopes = [z.T @ (y - p) / len(y) - RIDGE * w, (seen - pair.sum(0)) / len(y) - RIDGE * move]
            for i, (part, slope) in enumerate(zip((w, move), slopes)):  # Adam
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.99 * square[i] + 0.01 * slope**2
                part += RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
        self.w, self.move = w, move

    def marginals(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return forward_backward(((x - self.mean) / self.scale) @ self.w, self.move, bounds)[0]


def document_features(bad: np.ndarray, own: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length-weighted share of bad lines, share of length in lines that are likely bad, the worst line, log length."""
    weight = (size + 1).astype(float)
    first = bounds[:-1]
    total = np.add.reduceat(weight, first)
    share = np.add.reduceat(weight * bad, first) / total
    likely = np.add.reduceat(weight * (bad > 0.5), first) / total
    worst = np.maximum.reduceat(bad * np.minimum(weight / 40, 1), first)
    return np.column_stack([share, likely, worst, np.log(total), share * likely])


class Judge:
    def __init__(self, share: float, field: Field | None = None, regression: Logistic | None = None):
        self.share, self.field, self.regression = share, field, regression

    def lines(self, data: np.ndarray, offsets: np.ndarray):
        own, bounds, size = own_features(data, offsets)
        return self.field.marginals(with_neighbours(own, bounds), bounds), own, bounds, size

    def __call__(self, column: pa.Array) -> np.ndarray:
        if self.regression is None or not len(column):
            return np.full(len(column), self.share)
        data, offsets = T.buffers(column)
        out = []
        for a, b in T.slices(offsets, 2 * T.SLICE):
            out.append(self.regression(document_features(*self.lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))))
        return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, learn, ident: str = "doc_id", text: str = "text", label: str = "quality") -> Judge:
    """A classifier from FIT documents at most, those of the smallest hashes among the labels that may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & learn).groupBy(ident).agg(F.max(label).alias(label))
    chosen = known.orderBy(F.xxhash64(ident), ident).limit(FIT)
    rows = labelled(docs.where(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) <= FIT_TEXT), chosen, label, F.lit(True), ident, text)
    # of rows of one id the one of the smallest hash
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")).select("doc_id", "r.text", "r.label")

    def measure(batches):
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            for a, b in T.slices(offsets, 2 * T.SLICE):
                own, bounds, size = own_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "label": batch.column("label").slice(a, b - a), "own": pa.array([own[x:y].astype(np.float32).tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary()), "size": pa.array([size[x:y].astype(np.int32).tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())})

    half = [F.xxhash64("doc_id", F.lit("half")), F.col("doc_id")]
    before = F.sum(F.octet_length("own")).over(Window.orderBy(*half).rowsBetween(Window.unboundedPreceding, 0))  # over FIT rows
    found = rows.mapInArrow(measure, "doc_id long, label int, own binary, size binary").withColumn("before", before).where(F.col("before") <= FIT_BYTES).orderBy(*half).drop("before").collect()
    good = np.array([r[1] for r in found], float)
    if len(set(good.tolist())) < 2:
        return Judge(float(good.mean()) if len(good) else 0.5)
    halves = []
    for part in (found[::2], found[1::2]):
        own = [np.frombuffer(r[2], np.float32).reshape(-1, N_OWN) for r in part]
        size = np.concatenate([np.frombuffer(r[3], np.int32) for r in part])
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        halves.append((np.concatenate(own).astype(float), bounds, size, np.array([r[1] for r in part], float)))
    own, bounds, size, y = halves[0]
    field = Field(with_neighbours(own, bounds), bounds, np.repeat(y == 0, np.diff(bounds)), size)
    own, bounds, size, y = halves[1]
    if len(set(y.tolist())) < 2:
        own, bounds, size, y = halves[0]
    if len(set(y.tolist())) < 2:
        return Judge(float(good.mean()))
    bad = field.marginals(with_neighbours(own, bounds), bounds)
    return Judge(float(good.mean()), field, Logistic(document_features(bad, own, bounds, size), y))


def scores(docs: DataFrame, judge: Judge, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(sent.value(batch.column("text")), pa.float64())})

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def line_labels(docs: DataFrame, judge: Judge, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line (from 0), bad (probability) of every line of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            for a, b in T.slices(offsets, 2 * T.SLICE):
                bad, _, bounds, _ = sent.value.lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(bounds)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), n))), "line": pa.array(T.ragged(np.zeros(len(n), np.int64), n)), "bad": pa.array(bad)})

    if judge.field is None:
        raise ValueError("no field was fitted: the labels are of one class")
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, line long, bad double")


def held_out():
    return remainder("doc_id", 5) == 0


def op6_line_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scores(docs, fit(docs, labels, ~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
