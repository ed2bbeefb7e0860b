"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered list of its LIST nearest pivots out of N_PIVOTS. For a block of vectors the index
holds an inverted file for each pivot: the place that the pivot has in the list of each vector of the block, or FAR, where it is not in the list. (A quarter of the vectors are
in a file, so a byte for each is less than a number and a place for those.) A query
reads the files of the pivots in its own list and no others, and adds up LIST - |its place - the vector's place| for each
vector that it meets there: the footrule distance of the lists, counted from the other end. The SHARE of the block that is nearest by that (WANTED vectors for each
neighbour that is asked for, at least) is ranked by the exact inner product.

Nearness is the largest inner product, so vectors are lifted: with M the largest norm of all, a vector x gets one more
component sqrt(M^2 - |x|^2) and a query gets 0, and Euclidean nearness of lifted vectors is nearness by inner product.

Blocks hold vectors of about the same region (neighbouring pivots' vectors, by counts of all pivots; a pivot of many is cut by id) and have a centre c and a radius r. A query q looks
into the block of the nearest centre first. Its k-th score there bounds the rest: a block with q.c + |q| r below it can hold none of the k
nearest, and is not visited, and of a visited one only what reaches it goes on. Where vectors lie in clusters that leaves a few blocks; vectors without any structure take all of them.

Equal vectors are indexed k + 1 times at most, by their smallest ids, which is all that a result may hold; equal queries are asked once.
Pivots are a bounded sample, those of the smallest hashes; every valid vector is indexed. The blocks' centres go to all
executors: there are MOST_BLOCKS at most, blocks get larger beyond that.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors of
another length than the most frequent one (of equally frequent ones the smallest); ties go to the smaller id; rows of one id and
one vector count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _exchange as X

N_PIVOTS, LIST = 384, 96
#: The place of a pivot that is not in a list; lists are shorter.
FAR = 127
#: Of a block, what is ranked exactly: this share, and so many vectors for each neighbour wanted, at least.
SHARE, WANTED = 0.10, 25
#: Vectors of a block, queries that meet a block at once, and the most blocks.
BLOCK, PACK, MOST_BLOCKS = 8192, 1 << 16, 100_000
BLOCKS = "block long, ids binary, x binary, centre binary, radius double"
FOUND = "rep long, vec_id long, score double"


def valid(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part, whatever their length."""
    v = F.col("v")
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def first_of_equal(rows: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the smallest ids, so many at most, once each, with their rank. The rank limit holds before the shuffle too, so a frequent vector makes no task hot."""
    of_v = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("rank", F.dense_rank().over(of_v)).where(F.col("rank") <= most)
    return few.withColumn("before", F.lag("vec_id").over(of_v)).where("before is null or before <> vec_id").drop("before")


class Pivots:
    """Lifted pivots, and the largest norm."""

    def __init__(self, x: np.ndarray, norm: float, length: int):
        self.norm = norm
        self.x = self.lift(x)
        self.half = (self.x * self.x).sum(1) / 2
        self.length = min(length, len(x))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))])

    def lists(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The numbers of the nearest pivots of each vector, nearest first."""
        lifted = np.column_stack([x, np.zeros(len(x))]) if query else self.lift(x)
        near = self.half - lifted @ self.x.T
        if self.length < near.shape[1]:
            some = np.sort(np.argpartition(near, self.length - 1, axis=1)[:, : self.length], axis=1)
            return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
        return np.argsort(near, axis=1, kind="stable")


class Files:
    """The inverted files of a block, a row of bytes for each pivot."""

    def __init__(self, x: np.ndarray, pivots: Pivots):
        lists = pivots.lists(x)
        n, self.length = lists.shape
        if self.length >= FAR:
            raise ValueError(f"lists must be shorter than {FAR}")
        self.place = np.full((len(pivots.x), n), FAR, np.int8)
        self.place[lists.ravel(), np.repeat(np.arange(n), self.length)] = np.tile(np.arange(self.length, dtype=np.int8), n)

    def credit(self, wanted: np.ndarray) -> np.ndarray:
        """For each vector the sum of length - |difference of places| over the pivots that it shares with a query's list."""
        off = self.place[wanted]
        off -= np.arange(len(wanted), dtype=np.int8)[:, None]
        np.abs(off, out=off)
        np.subtract(np.int8(self.length), off, out=off)
        np.maximum(off, 0, out=off)
        half = off.view(np.uint8)[: len(wanted) // 2] + off.view(np.uint8)[len(wanted) // 2 : len(wanted) // 2 * 2]  # two credits fit into a byte
        total = half.sum(0, dtype=np.uint16)
        return total + off[-1] if len(wanted) % 2 else total


def best_of_block(ids: np.ndarray, x: np.ndarray, files: Files, wanted: np.ndarray, q: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and score of the k best of the block, ties to the smaller id; ids must be ascending."""
    reach = min(len(ids), max(int(np.ceil(share * len(ids))), WANTED * k))
    at = np.arange(len(ids))
    if reach < len(ids):
        credit = files.credit(wanted)
        bound = np.partition(credit, len(ids) - reach)[len(ids) - reach]
        inner, edge = np.flatnonzero(credit > bound), np.flatnonzero(credit == bound)
        at = np.sort(np.concatenate([inner, edge[: reach - len(inner)]]))
    score = (x[at] * q).sum(1)
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at[best]], score[best]


def block_names(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pivot its first block and into how many blocks its vectors are cut: pivots of few vectors share a block with their neighbours in number."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    name, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > size:
            name, held = name + 1, 0
        first[i] = name
        if n > size:
            parts[i] = -(-n // size)
            name, held = name + parts[i], 0
        else:
            held += n
    return first, parts


def packed(rows: DataFrame, pivots: Pivots, size: int) -> DataFrame:
    """BLOCKS: vectors dealt by their nearest pivot, and cut by a hash of the id where a pivot has too many, sorted by id each."""

    def near(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            first = pivots.lists(x)[:, 0] if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"pivot": pa.array(first, pa.int32()), "vec_id": batch.column("vec_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    dealt = X.checkpoint(rows.select("vec_id", "v").mapInArrow(near, "pivot int, vec_id long, x binary"))
    counts = np.zeros(len(pivots.x), np.int64)
    for pivot, n in dealt.groupBy("pivot").count().collect():  # N_PIVOTS at most
        counts[pivot] = n
    first, parts = block_names(counts, size)
    of = lambda values: F.get(F.lit(values).cast("array<long>"), F.col("pivot"))
    named = dealt.withColumn("block", of(first) + F.pmod(F.xxhash64("vec_id"), of(parts)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(len(ids), -1)
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        return pa.table({"block": table["block"][:1].cast(pa.int64()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius])})

    return named.select("block", "vec_id", "x").groupBy("block").applyInArrow(pack, BLOCKS)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles of one length."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Regions:
    """Centres and radii of all blocks."""

    def __init__(self, rows):
        self.blocks = np.array([r[0] for r in rows], np.int64)
        self.centres = np.array([np.frombuffer(r[1]) for r in rows])
        self.radii = np.array([r[2] for r in rows])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that a vector of each block can have with q, and a little more for rounding."""
        size = np.sqrt((q * q).sum())
        return self.centres @ q + size * self.radii * (1 + 1e-9) + 1e-9 * size


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, ident: str = "vec_id", vector: str = "embedding", n_pivots: int = N_PIVOTS, length: int = LIST, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (rows of the same two columns), never its own id."""
    spark = vectors.sparkSession
    every = valid(vectors, ident, vector)
    widths = every.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return every.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    same = F.size("v") == widths[0][0]
    rows = X.checkpoint(first_of_equal(every.where(same), k + 1))
    asked = valid(queries, ident, vector).where(same)
    reps = X.checkpoint(first_of_equal(asked, 1).select(F.xxhash64("v", "vec_id").alias("rep"), "v"))
    n, largest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    sample = rows.where("rank = 1").orderBy(F.xxhash64("v"), "v").select("v").limit(n_pivots).collect()
    pivots = Pivots(np.array([r[0] for r in sample]), largest, length)
    size = max(block, -(-n // MOST_BLOCKS))
    blocks = X.checkpoint(packed(rows, pivots, size))
    regions = spark.sparkContext.broadcast(Regions(blocks.select("block", "centre", "radius").collect()))
    parts = max(1, -(-reps.count() // PACK))

    def visits(chosen):
        """Rows of (block, part, rep, q, wanted, least) for the blocks that a query visits."""

        def run(batches):
            for batch in batches:
                x = matrix(batch.column("v"))
                wanted = pivots.lists(x, query=True).astype("<i2") if len(x) else []
                out = {name: [] for name in ("block", "part", "rep", "q", "wanted", "least")}
                least = batch.column("least").to_pylist() if "least" in batch.schema.names else [None] * batch.num_rows
                for i, rep in enumerate(batch.column("rep").to_pylist()):
                    for at in chosen(regions.value, x[i], batch, i):
                        for name, value in zip(out, (int(regions.value.blocks[at]), rep % parts, rep, x[i].tobytes(), wanted[i].tobytes(), least[i])):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({name: pa.array(value, kind) for (name, value), kind in zip(out.items(), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64()))})

        return run

    def look(held: pa.Table, met: pa.Table) -> pa.Table:
        rep, vec, score = [], [], []
        for b in range(held.num_rows if met.num_rows else 0):
            ids = np.frombuffer(held["ids"][b].as_buffer(), "<i8")
            x = np.frombuffer(held["x"][b].as_buffer()).reshape(len(ids), -1)
            files = Files(x, pivots)
            for one, q, wanted, least in zip(*(met[c].to_pylist() for c in ("rep", "q", "wanted", "least"))):
                at, value = best_of_block(ids, x, files, np.frombuffer(wanted, "<i2"), np.frombuffer(q), k + 1, share)
                if least is not None:
                    at, value = at[value >= least], value[value >= least]
                rep.append(np.full(len(at), one))
                vec.append(at)
                score.append(value)
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"rep": cat(rep, np.int64), "vec_id": cat(vec, np.int64), "score": cat(score, np.float64)})

    copies = blocks.select("block", "ids", "x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def found(met: DataFrame) -> DataFrame:
        return copies.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInArrow(look, FOUND)

    kind = "block long, part int, rep long, q binary, wanted binary, least double"
    nearest = lambda r, q, batch, i: [int(np.argmax(r.centres @ q))]
    first = X.checkpoint(found(reps.mapInArrow(visits(nearest), kind)))
    # the k-th of others than the query's own id: k + 1 may hold that id, so the last of k + 1 is a bound for sure
    least = first.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("rep", F.when(F.col("n") > k, F.col("least")).alias("least"))

    def others(r, q, batch, i):
        least = batch.column("least")[i].as_py()
        may = np.ones(len(r.blocks), bool) if least is None else r.bounds(q) >= least
        may[nearest(r, q, batch, i)[0]] = False
        return np.flatnonzero(may).tolist()

    rest = found(reps.join(least, "rep", "left").mapInArrow(visits(others), kind))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
    best = first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    listed = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("held"))  # k + 1 at most
    mine = asked.select(F.col("vec_id").alias("query_id"), "v").join(reps, "v").join(listed, "rep")
    kept = F.slice(F.filter("held", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(kept).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_permutation_index(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
