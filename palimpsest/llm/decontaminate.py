"""Benchmark decontamination by winnowing.

A benchmark item is its windows of `window` words, or one window of all its words if it has
fewer. The fingerprint of a window is the smallest hash among its runs of `gram`
words, so equal windows have equal fingerprints: any shared span of `window` words is found.
Document windows join benchmark fingerprints; each hit is extended by comparing the whole
window. Items shorter than `window` words use their own length as the gram.

The benchmark index is sent to all executors only up to CHUNK_BYTES of text. Of a larger
benchmark nothing is sent: its windows stay in ranges of fingerprints, each shard of documents sends its distinct fingerprints there and
gets the windows that have one of them, so the texts are read twice whatever the benchmark's size. Both ways give the same rows. Windows are compared by 64-bit hashes.

Defined cases: null or empty texts have no words, no hits, no items; a null id stays a row;
items without words or without an id have no windows; repeated rows each give a row; an empty
benchmark hits nothing; other columns are not read by scan() and stay in decontaminated().
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _exchange as X, _text as T

#: Text of a benchmark whose index is sent to all executors.
CHUNK_BYTES = 8 << 20
SCANNED = "doc_id long, tag long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lowered = T.LOWER[data]
    starts, ends, bounds = T.word_bounds(lowered, offsets, T.ALNUM)
    return T.hash_words(lowered, starts, ends), bounds


def fingerprints(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash in each window, rows' ends ignored."""
    grams = T.hash_windows(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, T.U64)
    out = grams[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(out, grams[i : i + n], out=out)
    return out


def item_windows(items: list[tuple[str, str]], window: int, gram: int):
    """size, hashes, fingerprints and item of the windows of each item; windows of an item shorter than window are their own fingerprints."""
    for name, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        words, _ = words_of(raw, np.array([0, len(raw)], np.int64))
        if len(words):
            size = min(window, len(words))
            runs = T.hash_windows(words, size)
            yield size, runs, fingerprints(words, window, gram) if size == window else runs, name


class Index:
    """Windows of some benchmark items, by length."""

    def __init__(self, windows, window: int, gram: int, winnow: bool = True):
        """windows: as item_windows() gives them; without winnow all of them are looked for, as fingerprints have met already."""
        self.window, self.gram, self.winnow = window, gram, winnow
        windows = list(windows)
        self.names = sorted({name for *_, name in windows})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[int, list] = defaultdict(list)
        for size, runs, _, name in windows:
            found[size].append((runs, np.full(len(runs), number[name])))
        self.sizes = {}
        for size, parts in found.items():
            keys, item = (np.concatenate(x) for x in zip(*parts))
            pairs = np.unique(np.stack([keys, item.astype(T.U64)], 1), axis=0) if len(keys) else np.zeros((0, 2), T.U64)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.sizes[size] = (keys, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64), self.low(keys))
        prints = [p for size, _, p, _ in windows if size == window and winnow]
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, T.U64)
        self.print_low = self.low(self.prints)

    @staticmethod
    def low(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(keys & T.U64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    @staticmethod
    def among(values: np.ndarray, keys: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of the values that are keys."""
        maybe = np.flatnonzero(low[(values & T.U64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(keys):
            return maybe[:0]
        place = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
        return maybe[keys[place] == values[maybe]]

    def hits(self, words: np.ndarray, bounds: np.ndarray):
        """Start, size and place in the size's keys of every occurrence of a window."""
        for size, (keys, _, _, low) in self.sizes.items():
            at = T.window_starts(bounds, size)
            if not len(at):
                continue
            if size == self.window and self.winnow:
                at = at[self.among(fingerprints(words, size, self.gram)[at], self.prints, self.print_low)]
            runs = T.hash_windows(words, size)[at]
            keep = self.among(runs, keys, low)
            if len(keep):
                yield at[keep], size, np.searchsorted(keys, runs[keep])

    def scan(self, column: pa.Array):
        """n_words, n_hit, item numbers and word masks of every text."""
        data, offsets = T.buffers(column)
        for a, b in T.slices(offsets):
            words, bounds = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            step = np.zeros(len(words) + 1, np.int64)
            pairs = []
            for at, size, place in self.hits(words, bounds):
                np.add.at(step, at, 1)
                np.add.at(step, at + size, -1)
                _, first, item, _ = self.sizes[size]
                counts = first[place + 1] - first[place]
                rows = np.repeat(np.searchsorted(bounds, at, "right") - 1, counts)
                pairs.append(np.stack([rows, item[T.ragged(first[place], counts)]], 1))
            mask = np.cumsum(step[:-1]) > 0
            items = defaultdict(list)
            if pairs:
                for row, item in np.unique(np.concatenate(pairs), axis=0).tolist():
                    items[row].append(item)
            for row in range(b - a):
                lo, hi = bounds[row], bounds[row + 1]
                yield int(hi - lo), mask[lo:hi] if row in items else None, items.get(row, ())


def spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])]


def items_of(benchmark: DataFrame, ident: str, text: str) -> DataFrame:
    return benchmark.select(F.col(ident).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("item is not null and text is not null")


def scan(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 7, chunk_bytes: int = CHUNK_BYTES, tagged: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (word ranges that are hit) of every row of docs; with tagged also tag, a hash of the row's text."""
    body = F.col(text).cast("string")
    items = items_of(benchmark, item, item_text)
    source = docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= chunk_bytes
    found = source.mapInArrow(scanner(sent(docs, items, window, gram)), SCANNED) if small else scan_by_shards(source, items, window, gram)
    return found if tagged else found.drop("tag")


def sent(docs: DataFrame, items: DataFrame, window: int, gram: int):
    """The index of a benchmark of CHUNK_BYTES at most, on all executors."""
    return docs.sparkSession.sparkContext.broadcast(Index(item_windows([tuple(r) for r in items.collect()], window, gram), window, gram))


def scanned(index: Index, batch) -> pa.RecordBatch | pa.Table:
    """Rows of SCANNED of the rows of a batch or table."""
    columns = batch.column("text")
    found = [x for c in (columns.chunks if isinstance(columns, pa.ChunkedArray) else [columns]) for x in index.scan(c)]
    return type(batch).from_pydict(
        {
            "doc_id": batch.column("doc_id"),
            "tag": batch.column("tag"),
            "n_words": pa.array([n for n, _, _ in found], pa.int64()),
            "n_hit": pa.array([0 if m is None else int(m.sum()) for _, m, _ in found], pa.int64()),
            "items": pa.array([[index.names[i] for i in items] for _, _, items in found], pa.list_(pa.string())),
            "spans": pa.array([[] if m is None else spans(m) for _, m, _ in found], _SPAN),
        }
    )


def scanner(index):
    def run(batches):
        T.let_go()
        for batch in batches:
            yield scanned(index.value, batch)
        T.rest()

    return run


def scan_by_shards(source: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """SCANNED of source (doc_id, tag, text), for a benchmark of any size."""
    table, n = X.shards(source, "doc_id", "text", whole=True)
    edges = np.array([((b << 64) // n) for b in range(1, n)], T.U64)

    def windows(batches):
        for batch in batches:
            for size, runs, prints, name in item_windows(list(zip(batch.column("item").to_pylist(), batch.column("text").to_pylist())), window, gram):
                pairs = np.unique(np.stack([prints, runs], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.searchsorted(edges, pairs[:, 0], "right"), pa.int32()), "size": pa.array(np.full(len(pairs), size), pa.int32()), "print": pa.array(pairs[:, 0].view(np.int64)), "run": pa.array(pairs[:, 1].view(np.int64)), "item": pa.array([name] * len(pairs), pa.string())})

    indexed = X.checkpoint(items.mapInArrow(windows, "bucket int, size int, print long, run long, item string"))
    sizes = sorted(r[0] for r in indexed.select("size").distinct().collect())  # window at most

    def ask(shard: int, rows: pa.Table) -> pa.Table:
        parts = []
        for c in rows["text"].chunks:
            data, offsets = T.buffers(c)
            for a, b in T.slices(offsets):
                words, bounds = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for size in sizes:
                    at = T.window_starts(bounds, size)
                    if len(at):
                        parts.append(np.unique((fingerprints(words, size, gram) if size == window else T.hash_windows(words, size))[at]))
        keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, T.U64)
        return X.send(shard, keys, np.zeros(len(keys), np.uint8), n, whole=True)

    def tell(asked: pa.Table, held: pa.Table) -> pa.Table:
        """The windows with a fingerprint that a shard has."""
        known = held["print"].to_numpy().view(T.U64)
        parts = [nothing]
        for shard, keys in zip(asked["shard"].to_pylist(), asked["keys"].to_pylist()):
            keys = np.frombuffer(keys, T.U64)
            place = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
            rows = held.select(["size", "run", "item"]).filter(pa.array(keys[place] == known))
            parts.append(rows.add_column(0, "shard", pa.array(np.full(rows.num_rows, shard), pa.int64())).cast(nothing.schema))
        return pa.concat_tables(parts)

    def look(_, rows: pa.Table, told: pa.Table) -> pa.Table:
        held = defaultdict(list)
        for size, run, name in zip(told["size"].to_pylist(), told["run"].to_pylist(), told["item"].to_pylist()):
            held[size, name].append(run)
        index = Index(((size, np.array(runs, np.int64).view(T.U64), None, name) for (size, name), runs in held.items()), window, gram, winnow=False)
        return scanned(index, rows).cast(out)

    schema = "shard long, size int, run long, item string"
    nothing, out = X.to_arrow(schema), X.to_arrow(SCANNED).schema
    asked = X.per_shard(table, ask, X.SENT)
    told = asked.groupBy("bucket").cogroup(indexed.groupBy("bucket")).applyInArrow(tell, schema)
    return X.with_answers(table, told, look, SCANNED)


def judged(scanned: DataFrame) -> DataFrame:
    """With contaminated: a twentieth of a document's words or more are hit."""
    return scanned.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, all columns."""
    items = items_of(benchmark, item, item_text)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= chunk_bytes:
        index = sent(docs, items, window, gram)

        def keep(batches):
            T.let_go()
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text))
                yield batch.filter(pa.array([m is None or 20 * int(m.sum()) < n for n, m, _ in index.value.scan(column)], pa.bool_()))
            T.rest()

        return docs.mapInArrow(keep, docs.schema)
    bad = judged(scan(docs, benchmark, ident, text, item, item_text, window, gram, chunk_bytes, tagged=True)).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("__contaminated"), F.col("tag").alias("__tag")).distinct()
    # a row goes by its id and its text, so that rows of one id, or without one, are judged each on their own
    return docs.join(bad, docs[ident].cast("long").eqNullSafe(bad["__contaminated"]) & (F.xxhash64(docs[text].cast("string")) == bad["__tag"]), "left_anti")


def op2_winnowing(spark, sf_dir: str) -> DataFrame:
    found = judged(scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Words are cut as the operator does, with the texts' runs of words compared as joined strings.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark),
n AS (
  SELECT item, words, least(13, len(words)) AS size FROM b WHERE len(words) > 0),
s AS (
  SELECT item, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM n),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS run FROM s),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
hits AS (
  SELECT doc_id, i, p.size, item FROM (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS run FROM places) p JOIN windows w ON p.run = w.run AND p.size = w.size),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
