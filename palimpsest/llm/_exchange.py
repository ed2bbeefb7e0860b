"""Shards of documents, packed key exchanges between shards, checkpoints and components.

Counting keys over a corpus with one Spark row a key costs far more than the keys
themselves. Here the documents of a shard send their distinct keys in one byte string for
each range of keys (a bucket), each bucket answers with one byte string for each
shard, and the shard reads the answers in the order of its own sorted keys. A key that
every document holds counts once a shard, so no key can make a bucket hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cluster import components
from ..scratch import checkpoint, release, remove_folder, scratch_folder, scratch_name
from ._text import U64, buffers, let_go, rest, slices

__all__ = ["checkpoint", "components", "release", "remove_folder", "scratch_folder", "scratch_name"]

#: Bytes of text that a shard should hold.
SHARD_BYTES = 4 << 20
#: Tables that shards() made, for drop_scratch().
_SHARD_TABLES: list[str] = []
SENT = "bucket int, shard long, keys binary, notes binary"
ANSWER = "shard long, bucket int, codes binary, n_sent long, n_live long, n_scan long"


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def shards(docs: DataFrame, ident: str, text: str, whole: bool = False) -> tuple[DataFrame, int]:
    """The texts in a table of shards (shard long, blob binary), each about SHARD_BYTES of text, and the number of its buckets.

    A blob holds doc_id and text of the shard's rows, or all columns of docs with whole, as a compressed Arrow stream. The table is bucketed by shard,
    so passes that meet the answers to a shard move the answers only. It stays in the
    warehouse until drop_scratch().
    """
    spark = docs.sparkSession
    n = max(-(-text_bytes(docs, text) // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs if whole else docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    of_text = text if whole else "text"

    def pack_rows(batches):
        from pyspark import TaskContext

        let_go()
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = buffers(batch.column(batch.schema.get_field_index(of_text)))
            for a, b in slices(offsets, SHARD_BYTES):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "blob": pa.array([to_blob(batch.slice(a, b - a))], pa.binary())})
                shard += 1
        rest()

    name = scratch_name("palimpsest_shards")
    _SHARD_TABLES.append(name)
    rows.mapInArrow(pack_rows, "shard long, blob binary").write.option("compression", "none").bucketBy(n, "shard").format("parquet").saveAsTable(name)
    return spark.table(name), n


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def of_blob(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def drop_scratch(spark: SparkSession) -> None:
    """Drops the tables of shards that this process made, and no others; results that still read them are lost."""
    while _SHARD_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_SHARD_TABLES.pop()}")


def per_shard(table: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(shard, rows) for every shard."""

    def run(batches):
        let_go()
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob")):
                yield from work(shard, of_blob(blob)).to_batches()
        rest()

    return table.mapInArrow(run, schema)


def with_answers(table: DataFrame, answers: DataFrame, work: Callable, schema: str, asked_only: bool = False) -> DataFrame:
    """work(shard, rows, answers to it) for every shard, or with asked_only for those that have answers; each shard is a row of the table."""

    nothing = to_arrow(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        let_go()
        if asked_only and not right.num_rows:
            return nothing
        parts = [work(left["shard"][i].as_py(), of_blob(left["blob"][i]), right) for i in range(left.num_rows)]
        rest()
        return pa.concat_tables(parts) if parts else nothing

    return table.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, schema)


def two_columns(rows: pa.Table, ident: str, text: str) -> pa.Table:
    """doc_id and text of a shard's rows."""
    return pa.table({"doc_id": rows[ident].cast(pa.int64()), "text": rows[text].cast(pa.string())})


def to_arrow(schema) -> pa.Table:
    """An empty table."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema).empty_table()


def send(shard: int, keys: np.ndarray, notes: np.ndarray, buckets: int, whole: bool = False) -> pa.Table:
    """Rows of SENT of a shard's sorted distinct keys; the low 32 bits go out, or all with whole. notes: a byte or a long for each key."""
    cuts = bucket_cuts(keys, buckets)
    filled = np.flatnonzero(np.diff(cuts))
    out = keys if whole else keys.astype(np.uint32)
    return pa.table(
        {
            "bucket": pa.array(filled, pa.int32()),
            "shard": pa.array(np.full(len(filled), shard, np.int64), pa.int64()),
            "keys": pa.array([out[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()),
            "notes": pa.array([pack(notes[cuts[b] : cuts[b + 1]]) for b in filled], pa.binary()),
        }
    )


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Places in sorted keys where each of the equal key ranges begins."""
    edges = [((b << 64) // buckets) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, U64)), [len(keys)]]).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def answer(judge: Callable, key_kind, note_kind) -> Callable:
    """For groupBy("bucket").applyInArrow: judge(keys, notes, shard index of each) gives a code for each and the two sums for the cost model."""

    def of_bucket(table: pa.Table) -> pa.Table:
        let_go()
        rows = table.sort_by("shard")
        held = rows["shard"].to_numpy()
        keys = [np.frombuffer(x, key_kind) for x in rows["keys"].to_pylist()]
        notes = [unpack(x, note_kind) for x in rows["notes"].to_pylist()]
        sizes = np.array([len(x) for x in keys])
        codes, live, scan = judge(np.concatenate(keys), np.concatenate(notes), np.repeat(np.arange(len(keys)), sizes))
        rest()
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "shard": pa.array(held, pa.int64()),
                "bucket": rows["bucket"].cast(pa.int32()),
                "codes": pa.array([pack(codes[e - s : e]) for s, e in zip(sizes, ends)], pa.binary()),
                "n_sent": pa.array(sizes, pa.int64()),
                "n_live": pa.array([live if i == 0 else 0 for i in range(len(sizes))], pa.int64()),
                "n_scan": pa.array([scan if i == 0 else 0 for i in range(len(sizes))], pa.int64()),
            }
        )

    return of_bucket


def grouped_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of counts of equal keys, given back for each key; also the order and the group starts."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    return back, order, first


def read_answers(table: pa.Table, n_keys: int, kind=np.uint8) -> np.ndarray:
    """Codes in the order of the shard's sorted keys."""
    if not table.num_rows:
        return np.zeros(n_keys, kind)
    rows = table.select(["bucket", "codes"]).sort_by("bucket")
    out = np.concatenate([unpack(x, kind) for x in rows["codes"].to_pylist()])
    if len(out) != n_keys:
        raise ValueError(f"{len(out)} answers for {n_keys} keys")
    return out
