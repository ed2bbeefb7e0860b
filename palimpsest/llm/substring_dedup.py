"""Removal of repeated word runs by fixed-block anchors.

A run of `window` words that two documents share holds a whole block of `block` words
of the first document's blocks at 0, block, 2*block, ... if window >= 2*block - 1. So:

1. index the non-overlapping blocks of every document and probe them with every
   rolling run of `block` words; an anchor is a block that a rolling run of another
   document hits;
2. extend: only runs of `window` words around an anchor are compared exactly, each with
   the smallest document in which it starts;
3. overlapping repeated runs join to maximal repeats, whose words go.

A word goes if a run that covers it also starts in a document with a smaller id, on the
input as it is. Runs travel as packed hash keys between shards (see _exchange), once a shard and key,
so a passage of any number of documents makes no hot task. Runs are compared by 64-bit hashes.

Defined cases: null, empty or blank texts have no words and keep an empty text; rows with a
null id neither remove nor lose words; equal ids don't remove from each other, so repeated rows
both stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _exchange as X, _text as T

OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def shard_words(table: pa.Table) -> dict:
    """Word hashes of a shard, with ids and the rows' offsets."""
    words, counts = [], []
    for column in table["text"].chunks:
        data, offsets = T.buffers(column)
        for a, b in T.slices(offsets):
            raw = data[offsets[a] : offsets[b]]
            starts, ends, bounds = T.word_bounds(raw, offsets[a : b + 1] - offsets[a], T.SPACED)
            words.append(T.hash_words(raw, starts, ends))
            counts.append(np.diff(bounds))
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    ids = table["doc_id"].combine_chunks()
    return {"words": np.concatenate(words) if words else np.zeros(0, T.U64), "n": n, "bounds": np.concatenate([[0], np.cumsum(n)]).astype(np.int64), "known": np.array(ids.is_valid()), "ids": ids.fill_null(0).to_numpy(zero_copy_only=False)}


def starts_of(shard: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of that size starts within one text with an id, and the row of each."""
    counts = np.where(shard["known"], np.maximum(shard["n"] - size + 1, 0), 0)
    return T.ragged(shard["bounds"][:-1], counts), np.repeat(np.arange(len(counts)), counts)


def anchors(shard: dict, block: int) -> dict:
    """Distinct rolling runs of block words, sorted; a note for each: 1 if it is a block of the index, 2 if more than one id has it. group: which of them each rolling run is."""
    at, row = starts_of(shard, block)
    keys = T.hash_windows(shard["words"], block)[at]
    if not len(keys):
        return {"keys": keys, "notes": np.zeros(0, np.uint8), "at": at, "group": at}
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    ids = shard["ids"][row][order]
    indexed = ((at - shard["bounds"][row]) % block == 0)[order]
    notes = np.logical_or.reduceat(indexed, first).astype(np.uint8)
    notes |= (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)).astype(np.uint8) << 1
    return {"keys": ordered[first], "notes": notes, "at": at[order], "group": np.cumsum(new) - 1}


def hit(keys, notes, _):
    """1 for a block of the index that another document's rolling run equals."""
    value = np.where(notes & 2, 2, 1).astype(np.int64) + ((notes & 1).astype(np.int64) << 32)
    sums, _, _ = X.grouped_counts(keys, value)
    live = ((sums >> 32) > 0) & ((sums & 0xFFFFFFFF) > 1)
    return live.astype(np.uint8), int(live.sum()), 0


def extended(shard: dict, found: dict, codes: np.ndarray, block: int, window: int) -> dict:
    """Distinct runs of window words that hold an anchor, sorted, with the smallest id of each."""
    live = np.zeros(len(shard["words"]) + 1, np.int32)
    if len(codes):
        live[found["at"][codes[found["group"]] > 0]] = 1
    sums = np.concatenate([[0], np.cumsum(live)])
    at, row = starts_of(shard, window)
    keep = sums[at + (window - block + 1)] > sums[at]
    at, row = at[keep], row[keep]
    keys = T.hash_windows(shard["words"], window)[at]
    if not len(keys):
        return {"keys": keys, "least": np.zeros(0, np.int64), "at": at, "row": row, "group": at}
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    return {"keys": ordered[first], "least": np.minimum.reduceat(shard["ids"][row][order], first), "at": at[order], "row": row[order], "group": np.cumsum(new) - 1}


def earlier(keys, notes, _):
    """1 where another shard has the run in a smaller document."""
    if not len(keys):
        return np.zeros(0, np.uint8), 0, 0
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(notes[order], first), np.diff(np.append(first, len(keys))))
    codes = (least < notes).astype(np.uint8)
    return codes, int(codes.sum()), 0


def spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])]


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", window: int = 13, block: int = 7) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word ranges, maximal) and kept (text of the other words, one space between) of every row of docs."""
    if window < 2 * block - 1 or block < 1:
        raise ValueError("a run must hold a whole block: window >= 2 * block - 1")
    table, n = X.shards(docs, ident, text)

    def probe(shard: int, rows: pa.Table) -> pa.Table:
        found = anchors(shard_words(rows), block)
        return X.send(shard, found["keys"], found["notes"], n)

    def extend(shard: int, rows: pa.Table, answered: pa.Table) -> pa.Table:
        held = shard_words(rows)
        found = anchors(held, block)
        runs = extended(held, found, X.read_answers(answered, len(found["keys"])), block, window)
        return X.send(shard, runs["keys"], runs["least"], n, whole=True)

    def cut(_, table: pa.Table, answered: pa.Table) -> pa.Table:
        rows = {"doc_id": [], "n_words": [], "n_removed": [], "removed": [], "kept": []}
        if table.num_rows:
            shard = shard_words(table)
            found = anchors(shard, block)
            step = answered["step"].to_numpy()
            runs = extended(shard, found, X.read_answers(answered.filter(pa.array(step == 1)), len(found["keys"])), block, window)
            codes = X.read_answers(answered.filter(pa.array(step == 2)), len(runs["keys"]))
            gone = np.zeros(len(shard["words"]), bool)
            if len(runs["keys"]):
                repeated = (codes[runs["group"]] > 0) | (shard["ids"][runs["row"]] > runs["least"][runs["group"]])
                gone = T.covered(len(gone), np.sort(runs["at"][repeated]), window)
            row = 0
            for column in table["text"].chunks:
                for value in column.to_pylist():
                    words = (value or "").encode().split()
                    mask = gone[shard["bounds"][row] : shard["bounds"][row + 1]]
                    lost = int(mask.sum())
                    if lost:
                        words = [w for w, g in zip(words, mask.tolist()) if not g]
                    rows["n_removed"].append(lost)
                    rows["removed"].append(spans(mask) if lost else [])
                    rows["kept"].append(b" ".join(words).decode())
                    row += 1
            rows["doc_id"] = pa.array(shard["ids"], pa.int64(), mask=~shard["known"])
            rows["n_words"] = shard["n"]
        return pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "n_words": pa.array(rows["n_words"], pa.int64()), "n_removed": pa.array(rows["n_removed"], pa.int64()), "removed": pa.array(rows["removed"], _SPAN), "kept": pa.array(rows["kept"], pa.string())})

    def answered(sent: DataFrame, judge, key_kind, note_kind) -> DataFrame:
        return X.checkpoint(sent.groupBy("bucket").applyInArrow(X.answer(judge, key_kind, note_kind), X.ANSWER).select("shard", "bucket", "codes"))

    first = answered(X.per_shard(table, probe, X.SENT), hit, np.uint32, np.uint8)
    second = answered(X.with_answers(table, first, extend, X.SENT), earlier, np.uint64, np.int64)
    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return X.with_answers(table, both, cut, OUT)


def op8_fixed_blocks(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
runs AS (
  SELECT doc_id, i, hash(words[i:i + 12]) AS run FROM starts),
least AS (
  SELECT run, min(doc_id) AS least FROM runs GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM runs JOIN least USING (run) WHERE least < doc_id),
lost AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([words[p] FOR p IN range(1, len(words) + 1) IF NOT list_contains(coalesce(ps, []), p)], ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""
