"""Exact n-gram Jaccard join by the size-aware heavy-light method.

A document is the set of its distinct k-word shingles (all its words, if fewer). Equal
sets are one class. Two classes link if their Jaccard similarity reaches threshold/100. A set of
n shingles with a partner shares one of its first n - ceil(t*n) + 1 shingles with it, in
any order that both use; here rare shingles come first, by counts over all documents,
so that shingles that are in one class only need not be posted at all.

* Small sets (n <= boundary) post every pair out of their first n - ceil(t*n) + 2
  shingles: fixed-size subsets, of which any two linked small sets share one.
* Large sets, and small sets that a large one may link to, post single shingles into
  inverted lists, which are scanned for pairs with a large set in them.
* The boundary has the least cost by sums over all sets of each size: a subset costs 1, a
  list entry 1 + log2 of the list's length; small sets near the boundary pay for both.

An entry stays in a list only while it may reach one of another component by the sizes and places that the list's size classes hold.
A list is kept in cells, one for each shard that has entries of it, so that a list which every document is in makes no task hot.
It is never expanded into all its pairs. First every entry meets the list's smallest id. Then,
in a few rounds, entries outside their list's largest component meet one member of it, another each time,
until few are left. At last the entries left outside meet all of the list in other components. That finds
every link that can change a component, and the work in a group of copies stays about linear.
That is for components only. jaccard_links() gives the join itself: all links between classes, out of the same lists, which are
expanded into all their pairs, in blocks of BLOCK entries so that no list makes a task hot; its work grows with the links.

Defined cases: null or empty text, or text of blanks, has an empty set and links with nothing;
a null id gives a row with a null component; repeated rows give a row each, of one vertex;
an empty table gives no rows; other columns are not read.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import _exchange as X, _text as T

#: The boundary between small and large sets is at most this.
MOST_SMALL = 200
#: Rounds go on while the last step would meet more than so many pairs for each list entry.
ENOUGH, ROUNDS = 2, 2
#: Entries of a list that meet each other at once when all pairs are wanted.
BLOCK = 256
#: Classes of set sizes for each power of two.
SIZE_CLASSES = 4
DOC = "shard long, at int, doc_id long, n long, s1 long, s2 long, posted array<struct<key:long,pos:int,code:int>>"


def shingle_sets(table: pa.Table, k: int) -> dict:
    """Sorted distinct shingles of every text: tok[bounds[i]:bounds[i+1]]."""
    parts, counts = [], []
    for column in table["text"].chunks:
        data, offsets = T.buffers(column)
        for a, b in T.slices(offsets):
            off = offsets[a : b + 1] - offsets[a]
            raw = data[offsets[a] : offsets[b]]
            starts, ends, bounds = T.word_bounds(raw, off, T.SPACED)
            words = T.hash_words(raw, starts, ends, T.LOWER)
            n = np.diff(bounds)
            windows = T.hash_windows(words, k)
            sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
            out = np.empty(int(sizes.sum()), T.U64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            first = np.ones(len(out), bool)
            for i in range(b - a):
                lo, hi = at[i], at[i + 1]
                if n[i] >= k:
                    out[lo:hi] = windows[bounds[i] : bounds[i] + hi - lo]
                    out[lo:hi].sort()
                elif n[i]:
                    out[lo] = T.hash_run(words, bounds[i], bounds[i + 1])
            if len(out):
                np.not_equal(out[1:], out[:-1], out=first[1:])
                first[at[:-1][sizes > 0]] = True
            at = np.concatenate([[0], np.cumsum(first)])[at]
            parts.append(out[first])
            counts.append(np.diff(at))
    tok = np.concatenate(parts) if parts else np.zeros(0, T.U64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    full = np.flatnonzero(n)
    s1, s2 = np.zeros(len(n), T.U64), np.zeros(len(n), T.U64)
    if len(full):
        with np.errstate(over="ignore"):
            s1[full] = np.add.reduceat(T.mix(tok), bounds[full])
            s2[full] = np.add.reduceat(T.mix(tok ^ T.U64(0x5851F42D4C957F2D)), bounds[full])
    ids = table["doc_id"].combine_chunks()
    known = np.array(ids.is_valid())
    return {"ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "known": known, "tok": tok, "bounds": bounds, "n": n, "s1": s1, "s2": s2, "first": first_of_class(ids.fill_null(0).to_numpy(zero_copy_only=False), known & (n > 0), s1, s2)}


def first_of_class(ids: np.ndarray, use: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """True for the smallest id of each class."""
    out = np.zeros(len(ids), bool)
    rows = np.flatnonzero(use)
    order = rows[np.lexsort((ids[rows], s2[rows], s1[rows]))]
    if len(order):
        new = np.concatenate([[True], (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])])
        out[order[new]] = True
    return out


def sent_tokens(sets: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a shard's classes, sorted, and in how many of these classes (255 at most) each is."""
    keep = np.repeat(sets["first"], sets["n"])
    tok = np.sort(sets["tok"][keep])
    if not len(tok):
        return tok, np.zeros(0, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    return tok[first], np.minimum(np.diff(np.append(first, len(tok))), 255).astype(np.uint8)


def frequency(keys, notes, _):
    """Code 0: in one class only; otherwise 1 + log2 of the count, finer in eighths."""
    counts, _, first = X.grouped_counts(keys, notes)
    codes = np.where(counts > 1, np.minimum(1 + (8 * np.log2(np.maximum(counts, 1))).astype(np.int64), 255), 0).astype(np.uint8)
    live = counts > 1
    return codes, int(live.sum()), int(counts[live].sum())


def ceil_share(n, threshold: int):
    return -(-threshold * n // 100)


def prefixes(sets: dict, codes: np.ndarray, tokens: np.ndarray, threshold: int):
    """For each first-of-class row with any: keys, places and codes of the shared shingles among its first n - ceil(t*n) + 2, rarest first."""
    place = np.searchsorted(tokens, sets["tok"])
    for i in np.flatnonzero(sets["first"]):
        a, b = sets["bounds"][i], sets["bounds"][i + 1]
        n = int(b - a)
        code = codes[place[a:b]]
        if not code.any():
            continue
        # tok is sorted, so a stable sort by code orders by (code, shingle)
        order = np.argsort(code, kind="stable")[: n - ceil_share(n, threshold) + 2]
        pos = np.flatnonzero(code[order] > 0)
        if len(pos):
            yield i, sets["tok"][a:b][order[pos]], pos, code[order[pos]]


def boundary_by_cost(costs: list[tuple[int, float, float]]) -> int:
    """The size up to which sets post subsets, from (size, subsets, cost of list entries) of sizes up to MOST_SMALL."""
    small, large = np.zeros(MOST_SMALL + 1), np.zeros(MOST_SMALL + 1)
    for n, subsets, entries in costs:
        small[n], large[n] = subsets, entries
    total = [small[: x + 1].sum() + large[x + 1 :].sum() + large[-(-3 * x // 4) : x + 1].sum() for x in range(2, MOST_SMALL + 1)]
    return 2 + int(np.argmin(total))


def jaccard_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (see the module's text)."""
    return classified(*X.shards(docs, ident, text), "doc_id", "text", k, threshold).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 75) -> tuple[DataFrame, DataFrame]:
    """The join's links and its classes: a, b (a < b) of every pair of representatives whose classes link; and doc_id, n_shingles, class_id
    (the smallest id of an equal set; null without an id, the row's own without shingles), n_links (of the class, with other classes) of every row of docs."""
    table, n = X.shards(docs, ident, text)
    rows, classes, cells, boundary = posted_lists(table, n, "doc_id", "text", k, threshold)
    links = X.checkpoint(verified(table, X.checkpoint(all_pairs(cells, threshold, boundary)), "doc_id", "text", k, threshold))
    each = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    of_class = classes.join(each, "rep", "left").select("s1", "s2", F.col("n").alias("n_of"), "rep", "n_links")
    out = rows.select("doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return links, out.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = 5, threshold: int = 75) -> DataFrame:
    """The row of the smallest id of each component of docs, all columns; rows that link with nothing stay."""
    table, n = X.shards(docs, ident, text, whole=True)
    found = X.checkpoint(classified(table, n, ident, text, k, threshold))
    linked = (F.col("n_shingles") > 0) & F.col("component_id").isNotNull()
    first = found.where(linked).groupBy("component_id").agg(F.min(F.struct("doc_id", "shard", "at")).alias("k")).select("k.shard", "k.at")
    keep = first.unionByName(found.where(~linked).select("shard", "at"))

    def take(_, rows: pa.Table, kept: pa.Table) -> pa.Table:
        return rows.take(pa.array(np.sort(kept["at"].to_numpy())))

    return X.with_answers(table, keep, take, docs.schema)


def posted_lists(table: DataFrame, n: int, ident: str, text: str, k: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows of a table of shards, their classes, the cells of the lists that hold more than one entry, and the boundary."""

    def count(shard: int, rows: pa.Table) -> pa.Table:
        tokens, notes = sent_tokens(shingle_sets(X.two_columns(rows, ident, text), k))
        return X.send(shard, tokens, notes, n)

    sent = X.per_shard(table, count, X.SENT)
    answers = X.checkpoint(sent.groupBy("bucket").applyInArrow(X.answer(frequency, np.uint32, np.uint8), X.ANSWER))
    def post(shard: int, rows: pa.Table, answered: pa.Table) -> pa.Table:
        sets = shingle_sets(X.two_columns(rows, ident, text), k)
        tokens, _ = sent_tokens(sets)
        codes = X.read_answers(answered, len(tokens))
        if not len(tokens):
            tokens, codes = np.zeros(1, T.U64), np.zeros(1, np.uint8)
        posted = [None] * len(sets["n"])
        for i, keys, places, rarity in prefixes(sets, np.append(codes, np.uint8(0)), tokens, threshold):
            posted[i] = [{"key": a, "pos": b, "code": c} for a, b, c in zip(keys.view(np.int64).tolist(), places.tolist(), rarity.tolist())]
        return pa.table(
            {
                "shard": pa.array(np.full(len(posted), shard), pa.int64()),
                "at": pa.array(np.arange(len(posted)), pa.int32()),
                "doc_id": pa.array(sets["ids"], pa.int64(), mask=~sets["known"]),
                "n": pa.array(sets["n"], pa.int64()),
                "s1": pa.array(sets["s1"].view(np.int64), pa.int64()),
                "s2": pa.array(sets["s2"].view(np.int64), pa.int64()),
                "posted": pa.array(posted, POSTED),
            }
        )

    rows = X.checkpoint(X.with_answers(table, answers.select("shard", "bucket", "codes"), post, DOC))
    named = rows.where("n > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    live = rows.where("posted is not null").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    single = F.expr(f"filter(posted, x -> x.pos <= n - ({threshold} * n + 99) div 100)")
    spent = live.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.sum(F.expr("size(posted) * (size(posted) - 1) / 2")), F.sum(F.aggregate(single, F.lit(0.0), lambda s, x: s + 1 + (x["code"] - 1) / 8)))
    boundary = boundary_by_cost([tuple(r) for r in spent.collect()])  # MOST_SMALL rows at most
    subsets = F.expr("flatten(transform(posted, (x, i) -> transform(slice(posted, i + 2, size(posted)), y -> named_struct('key', xxhash64(x.key, y.key), 'pos', y.pos - 1))))")
    lists = F.transform(single, lambda x: F.struct(x["key"].alias("key"), x["pos"].alias("pos")))
    of_small = live.where(F.col("n") <= boundary).select("shard", "doc_id", "n", F.lit(0).alias("kind"), F.explode(subsets).alias("p"))
    of_large = live.where(100 * F.col("n") >= threshold * (boundary + 1)).select("shard", "doc_id", "n", F.lit(1).alias("kind"), F.explode(lists).alias("p"))
    posts = of_small.unionByName(of_large).select("shard", "doc_id", "n", "kind", "p.key", "p.pos")
    return rows, classes, X.checkpoint(met_lists(posts, threshold, boundary)), boundary


def classified(table: DataFrame, n: int, ident: str, text: str, k: int, threshold: int) -> DataFrame:
    """shard, at (the row's place in it), doc_id, n_shingles, component_id of every row of a table of shards."""
    spark = table.sparkSession
    rows, classes, cells, boundary = posted_lists(table, n, ident, text, k, threshold)
    X.release(spark)
    tested = X.checkpoint(star_pairs(cells, threshold, boundary))
    links = X.checkpoint(verified(table, tested, ident, text, k, threshold))
    tested = tested.select("a", "b")
    found = X.components(links)
    mixed, n_entries = cells, cells.agg(F.sum(F.size("held"))).first()[0] or 0
    for turn in range(ROUNDS + 1):
        X.release(spark)
        mixed = X.checkpoint(mixed_lists(mixed, found, threshold, boundary))
        left = mixed.groupBy("kind", "key").agg(F.max(F.col("outside") * F.col("entries")).alias("met")).agg(F.sum("met")).first()[0] or 0
        if not left:
            break
        last = turn == ROUNDS or left <= ENOUGH * n_entries
        pairs = (cross_pairs if last else main_pairs)(mixed, turn, threshold, boundary)
        pairs = X.checkpoint(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.head(1):
            more = X.checkpoint(verified(table, pairs, ident, text, k, threshold))
            links, tested = links.unionByName(more), tested.unionByName(pairs.select("a", "b"))
            found = X.components(links) if more.head(1) else found
        if last:
            break
    X.release(spark)
    of_class = classes.join(found.withColumnRenamed("v", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("shard", "at", "doc_id", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    return out.select("shard", "at", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


POSTED = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("code", pa.int32())]))


def fits(n: str, pos: str, m: str, qos: str, kind: str, threshold: int, boundary: int):
    """Whether sets of sizes n and m that meet at these places can still reach the threshold, and belong to this kind of list."""
    n, pos, m, qos = map(F.col, (n, pos, m, qos))
    small, large = F.least(n, m), F.greatest(n, m)
    need = F.ceil((n + m) * threshold / F.lit(100 + threshold) - 1e-9)
    return (100 * small >= threshold * large) & (F.least(n - pos, m - qos) >= need) & ((F.col(kind) == 0) & (large <= boundary) | (F.col(kind) == 1) & (large > boundary))


def met_lists(posts: DataFrame, threshold: int, boundary: int) -> DataFrame:
    """The cells of the lists in which some entries may reach each other, with the list's smallest id.

    A cell (kind, key, shard, held: doc_id, n, pos) holds a list's entries of one shard, so a list that every document is in has a row a shard, not a row a document.
    """
    sized = posts.withColumn("component", F.col("doc_id"))
    head = F.min(F.struct("doc_id", "n", "pos", "shard")).alias("h")
    lists = size_classes(sized, head).agg(F.collect_list("class").alias("classes"), F.sum("class.held").alias("entries"), F.min("h").alias("h")).where("entries > 1")
    cells = posts.groupBy("kind", "key", "shard").agg(F.collect_list(F.struct("doc_id", "n", "pos")).alias("held")).join(lists, ["kind", "key"])
    return cells.withColumn("held", F.expr(f"filter(held, e -> {reachable('e.doc_id', threshold, boundary)})")).where(F.size("held") > 0).drop("classes", "entries")


def size_classes(entries: DataFrame, *more):
    """By list (kind, key): for each class of about equal sizes, the sizes, the most that is left of a set from its place on, the components and the number of entries."""
    facts = [F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("pos")).alias("left"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")]
    by_size = entries.groupBy("kind", "key", F.floor(SIZE_CLASSES * F.log2("n")).alias("size")).agg(*facts, *more)
    names = ["n_min", "n_max", "left", "lo", "hi", "held"]
    return by_size.select("kind", "key", F.struct(*names).alias("class"), *[c for c in by_size.columns if c not in ("kind", "key", "size", *names)]).groupBy("kind", "key")


def reachable(component: str, threshold: int, boundary: int) -> str:
    """SQL: whether an entry e may fit with one of another component in the list, by the list's size classes."""
    m = f"greatest(c.n_min, ({threshold} * e.n + 99) div 100)"
    return f"""exists(classes, c -> (c.lo <> {component} OR c.hi <> {component}) AND 100 * c.n_max >= {threshold} * e.n AND {threshold} * c.n_min <= 100 * e.n
        AND least(e.n - e.pos, c.left) >= ceil((e.n + {m}) * {threshold} / {100 + threshold}D - 1e-9) AND (kind = 0 OR greatest(e.n, c.n_max) > {boundary}))"""


def pair(doc: str, shard: str, hub: str, hub_shard: str) -> list:
    """Columns of a pair: a < b, and who is the hub, which many may meet."""
    way = F.struct(F.col(hub).alias("hub"), F.col(hub_shard).alias("hub_shard"), F.col(doc).alias("doc"), F.col(shard).alias("shard"))
    return [F.least(doc, hub).alias("a"), F.greatest(doc, hub).alias("b"), way.alias("way")]


def once(pairs: DataFrame) -> DataFrame:
    """Each pair once, wherever it was met; a is never b."""
    return pairs.where("a <> b").groupBy("a", "b").agg(F.min("way").alias("way")).select("a", "b", "way.*")


def star_pairs(cells: DataFrame, threshold: int, boundary: int) -> DataFrame:
    """Each list's smallest id with each other one, once."""
    each = cells.select("kind", "shard", F.col("h.doc_id").alias("hd"), F.col("h.shard").alias("hs"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hp"), F.inline("held"))
    return once(each.where(fits("n", "pos", "hn", "hp", "kind", threshold, boundary)).select(*pair("doc_id", "shard", "hd", "hs")))


def mixed_lists(cells: DataFrame, found: DataFrame, threshold: int, boundary: int) -> DataFrame:
    """The cells of the lists in which entries of different components may reach each other, each cell of one component now, without the entries that
    can't; with the list's largest component, its number of entries and how many are outside that one."""
    of = found.select(F.col("v").alias("doc_id"), F.col("component").alias("c"))
    placed = cells.select("kind", "key", "shard", F.inline("held")).join(of, "doc_id", "left").withColumn("component", F.coalesce("c", "doc_id"))
    lists = size_classes(placed).agg(F.collect_list("class").alias("classes"), F.min("class.lo").alias("lo"), F.max("class.hi").alias("hi")).where("lo <> hi").select("kind", "key", "classes")
    held = placed.groupBy("kind", "key", "component", "shard").agg(F.collect_list(F.struct("doc_id", "n", "pos")).alias("held")).join(lists, ["kind", "key"])
    held = X.checkpoint(held.withColumn("held", F.expr(f"filter(held, e -> {reachable('component', threshold, boundary)})")).where(F.size("held") > 0).drop("classes"))
    sizes = held.groupBy("kind", "key", "component").agg(F.sum(F.size("held")).alias("n_held"))
    mixed = sizes.groupBy("kind", "key").agg(F.count("*").alias("parts"), F.sum("n_held").alias("entries"), F.max(F.struct("n_held", "component")).alias("top")).where("parts > 1")
    return held.join(mixed.select("kind", "key", "entries", (F.col("entries") - F.col("top.n_held")).alias("outside"), F.col("top.component").alias("main")), ["kind", "key"])


def main_pairs(mixed: DataFrame, turn: int, threshold: int, boundary: int) -> DataFrame:
    """Entries outside their list's largest component with one member of it, another one each turn."""
    member = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id").alias("d"), F.col("shard").alias("ds"), F.col("n").alias("m"), F.col("pos").alias("qos"))
    chosen = mixed.where("component = main").select("kind", "key", "shard", F.inline("held")).groupBy("kind", "key").agg(F.min(member).alias("x")).select("kind", "key", "x.d", "x.ds", "x.m", "x.qos")
    met = mixed.where("component <> main").join(chosen, ["kind", "key"]).select("kind", "shard", "d", "ds", "m", "qos", F.inline("held"))
    return once(met.where(fits("n", "pos", "m", "qos", "kind", threshold, boundary)).select(*pair("doc_id", "shard", "d", "ds")))


def blocks_of(entries: str) -> Column:
    """Into how many parts a list of so many entries is cut, so that no list makes a task hot."""
    return F.ceil(F.col(entries) / BLOCK).cast("int")


def named_partner(rows: DataFrame, *more) -> DataFrame:
    return rows.select("kind", "key", F.col("shard").alias("ds"), F.col("doc_id").alias("d"), F.col("n").alias("m"), F.col("pos").alias("qos"), *more)


def cross_pairs(mixed: DataFrame, _: int, threshold: int, boundary: int) -> DataFrame:
    """Pairs of one list in different components; a list's largest component doesn't meet itself. The entries outside it go to each of the list's blocks."""
    each = mixed.select("kind", "key", "shard", "component", "main", blocks_of("entries").alias("blocks"), F.inline("held"))
    cut = each.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    outside = named_partner(each.where("component <> main"), F.col("component").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    fit = F.expr("component <> other AND (component = main OR component < other)") & fits("n", "pos", "m", "qos", "kind", threshold, boundary)
    return once(cut.join(outside, ["kind", "key", "block"]).where(fit).select(*pair("doc_id", "shard", "d", "ds")))


def all_pairs(cells: DataFrame, threshold: int, boundary: int) -> DataFrame:
    """All pairs of each list, once; a list is cut into blocks, and every two blocks of it meet on their own."""
    sizes = cells.groupBy("kind", "key").agg(F.sum(F.size("held")).alias("entries"))
    cut = cells.join(sizes, ["kind", "key"]).select("kind", "key", "shard", blocks_of("entries").alias("blocks"), F.inline("held")).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    left = cut.select("kind", "key", "shard", "doc_id", "n", "pos", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = named_partner(cut, F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    met = left.join(right, ["kind", "key", "i", "j"]).where("i < j and doc_id <> d or i = j and doc_id < d").where(fits("n", "pos", "m", "qos", "kind", threshold, boundary))
    return once(met.select(*pair("doc_id", "shard", "d", "ds")))


def verified(table: DataFrame, pairs: DataFrame, ident: str, text: str, k: int, threshold: int) -> DataFrame:
    """a, b of the pairs whose whole sets reach the threshold.

    The set of each hub goes once to each shard that holds a partner of it, and is compared there with sets made from the texts, so that no set moves by the pair.
    """

    def some_sets(rows: pa.Table, asked: pa.ChunkedArray) -> tuple[np.ndarray, dict]:
        rows = X.two_columns(rows, ident, text)
        rows = rows.filter(pc.is_in(rows["doc_id"], value_set=asked.combine_chunks()))
        return rows["doc_id"].to_numpy(), shingle_sets(rows, k)

    def fetch(_, rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, sets = some_sets(rows, asked["doc_id"])
        cuts, of = sets["bounds"], {}
        for i, x in enumerate(ids.tolist()):
            of.setdefault(x, set()).add(sets["tok"][cuts[i] : cuts[i + 1]].tobytes())
        out = [(to, x, packed) for to, x in zip(asked["dest"].to_pylist(), asked["doc_id"].to_pylist()) for packed in of[x]]
        return pa.table({"shard": pa.array([r[0] for r in out], pa.int64()), "hub": pa.array([r[1] for r in out], pa.int64()), "doc": pa.nulls(len(out), pa.int64()), "packed": pa.array([r[2] for r in out], pa.binary())})

    def judge(_, rows: pa.Table, sent: pa.Table) -> pa.Table:
        known = np.array(sent["doc"].combine_chunks().is_valid())
        hubs: dict[int, list] = {}
        for x, packed in zip(sent["hub"].filter(pa.array(~known)).to_pylist(), sent["packed"].filter(pa.array(~known))):
            hubs.setdefault(x, []).append(np.frombuffer(packed.as_buffer(), T.U64))
        asked = sent.filter(pa.array(known))
        ids, sets = some_sets(rows, asked["doc"])
        places: dict[int, list] = {}
        for i, x in enumerate(ids.tolist()):
            places.setdefault(x, []).append(i)
        links = []
        for x, y in zip(asked["hub"].to_pylist(), asked["doc"].to_pylist()):
            if any(reaches(p, sets["tok"][sets["bounds"][i] : sets["bounds"][i + 1]], threshold) for p in hubs[x] for i in places[y]):
                links.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    wanted = pairs.select(F.col("hub_shard").alias("shard"), F.col("hub").alias("doc_id"), F.col("shard").alias("dest")).distinct()
    sent = X.with_answers(table, wanted, fetch, "shard long, hub long, doc long, packed binary", asked_only=True)
    asked = pairs.select("shard", "hub", "doc", F.lit(None).cast("binary").alias("packed"))
    return X.with_answers(table, sent.unionByName(asked), judge, "a long, b long", asked_only=True)


def reaches(p: np.ndarray, q: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have the similarity."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small) or 100 * len(small) < threshold * len(large):
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * common >= threshold * (len(p) + len(q) - common)


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sets as joined strings; every pair with a common shingle is counted, and components are reached step by step.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
both_ AS (SELECT a AS v, b AS w FROM e UNION SELECT b, a FROM e),
reach(v, r) AS (SELECT v, v FROM both_ UNION SELECT both_.w, r FROM reach JOIN both_ ON reach.v = both_.v),
c AS (SELECT v AS doc_id, min(r) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
