"""Ordered folds, and connected parts of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import checkpoint


def fold_by(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Column, step, finish=None) -> DataFrame:
    """keys and state: a left fold over each group's rows in order. The group's rows are one array, so a group must be small (a page, a document)."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("rows"))
    return held.select(*keys, (F.aggregate("rows", start, step, finish) if finish else F.aggregate("rows", start, step)).alias("state"))


def start_clusters(rows: DataFrame, keys: list[str], at: str, ident: str, tolerance: float) -> DataFrame:
    """Clusters along one axis: a value that lies more than the tolerance after its cluster's first value starts a new one. keys, ident, at, cluster (from 0).

    A gap of more than the tolerance between neighbours starts a cluster whatever was before, so groups are cut at such gaps first (window functions only), and the
    fold goes over the distinct places of one stretch, each once; a fold keeps the running starts only. A group that is one dense stretch is still folded in one task, by its distinct places.
    """
    spots = rows.select(*keys, F.col(at).cast("double").alias("__x")).distinct()
    place = Window.partitionBy(*keys).orderBy("__x")
    opens = (F.col("__x") - F.lag("__x").over(place) > tolerance).cast("int")
    stretch = spots.withColumn("__open", F.coalesce(opens, F.lit(1))).withColumn("__stretch", F.sum("__open").over(place))
    held = stretch.groupBy(*keys, "__stretch").agg(F.array_sort(F.collect_list("__x")).alias("__xs"))
    # the starts of a stretch's clusters: the first place, then each first one that lies beyond
    starts = F.aggregate("__xs", F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("all")), lambda s, x: F.when(s["last"].isNull() | (x - s["last"] > tolerance), F.struct(x.alias("last"), F.concat(s["all"], F.array(x)).alias("all"))).otherwise(s), lambda s: s["all"])
    begin = held.select(*keys, F.explode(starts).alias("__x")).withColumn("__first", F.lit(1))
    marked = spots.join(begin, [*keys, "__x"], "left").withColumn("cluster", (F.count("__first").over(place) - 1).cast("int"))
    return rows.select(*keys, F.col(ident), F.col(at).cast("double").alias(at)).join(marked.select(*keys, F.col("__x").alias(at), "cluster"), [*keys, at]).select(*keys, ident, at, "cluster")


def components(edges: DataFrame, on: list[str] | tuple = ()) -> DataFrame:
    """on, v, component (the smallest v that it is joined to) of every vertex of edges (on, a, b).

    Alternating large-star and small-star steps over the edges until nothing changes, a number of rounds that grows with the logarithm of the longest chain. Each vertex's
    neighbours are reduced to a minimum before the shuffle and joined back, so that
    a vertex of very many edges is a skewed join that the planner may split.
    """
    on = list(on)
    key = [*on, "u"]
    turned = lambda rows: rows.select(*on, F.col("v").alias("u"), F.col("u").alias("v"))
    now = checkpoint(edges.select(*on, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(turned(now))
        least = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, key).where("v > u").select(*on, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(*key).agg(F.min("v").alias("m"))
        joined = large.join(least, key)
        now = checkpoint(joined.where("v <> m").select(*on, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select(*on, "u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64(*on, "u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(*on, F.col("u").alias("v"), F.col("v").alias("component")).unionByName(now.select(*on, "v", F.col("v").alias("component")).distinct())


def page_components(edges: DataFrame, on: list[str]) -> DataFrame:
    """on, v, component (smallest member) of the vertices of edges (a, b) on one page each; a vertex whose only edge leads to itself is a component."""
    found = components(edges, on)
    alone = edges.where("a = b").select(*on, F.col("a").alias("v")).distinct().join(found, [*on, "v"], "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("v")))


def stacks(spans: DataFrame, pairs: DataFrame, on: list[str], order: str = "ord") -> DataFrame:
    """on, component, n_members, texts (distinct but for white space, in order of place), strongest (order of the two spans that overlap most, and how much) of the stacks of different texts.

    pairs: on, a_<order>, b_<order>, overlap, as stacked_pairs() gives them.
    """
    edges = pairs.select(*on, F.col(f"a_{order}").alias("a"), F.col(f"b_{order}").alias("b"), "overlap")
    found = page_components(edges, on)
    member = found.join(spans.select(*on, F.col(order).alias("v"), "text", F.regexp_replace("text", r"\s+", "").alias("bare")), [*on, "v"])
    # one row for each distinct text of a stack, its first one
    first = member.groupBy(*on, "component", "bare").agg(F.count("*").alias("n"), F.min(F.struct("v", "text")).alias("first"))
    texts = first.groupBy(*on, "component").agg(F.sum("n").alias("n_members"), F.transform(F.array_sort(F.collect_list("first")), lambda x: x["text"]).alias("texts")).where(F.size("texts") >= 2)
    strength = F.struct(F.col("overlap"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))  # of equally strong ones the first
    strong = edges.join(found.select(*on, F.col("v").alias("a"), "component"), [*on, "a"]).groupBy(*on, "component").agg(F.max(strength).alias("s"))
    return texts.join(strong, [*on, "component"]).select(*on, "component", "n_members", "texts", (-F.col("s.na")).alias("a"), (-F.col("s.nb")).alias("b"), F.col("s.overlap").alias("overlap"))
