"""Numeric outliers within groups, by window functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Fixed values.
LEAST_GROUP, Z_LEAST, STD_LEAST, TRIM_PERCENT = 4, 3.0, 0.01, 10
WINDOW_SIZE, WINDOW_STEP, WINDOW_Z, WINDOW_GROUP = 10, 5, 2.5, 30
RATIO_LEAST, RATIO_GROUP = 10.0, 3
EXTREME_Z, BOOST = 5.0, 15


def leave_one_out(rows: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """rows with n, mean, std and z of each value against the trimmed others of its group.

    The others lose a tenth at either end, one at least. Which ranks stay when one value is left out
    differs from the ranks k+1 to n-k of the whole group by one value only, so sums over these
    ranks, the value itself and the two values at their ends are enough. Sums are of differences from the group's mean.
    """
    group = Window.partitionBy(*keys)
    v = F.col(value)
    out = rows.withColumn("__r", F.row_number().over(group.orderBy(v, *order))).withColumn("n", F.count("*").over(group)).withColumn("__c", v - F.avg(v).over(group))
    out = out.withColumn("__k", F.greatest(F.lit(1), F.floor((F.col("n") - 1) * TRIM_PERCENT / 100)))
    c, r, k, n = F.col("__c"), F.col("__r"), F.col("__k"), F.col("n")
    inner = (r > k) & (r <= n - k)
    sums = {"__a": F.sum(F.when(inner, c)), "__a2": F.sum(F.when(inner, c * c)), "__t": F.sum(c), "__t2": F.sum(c * c), "__lo": F.max(F.when(r == k + 1, c)), "__hi": F.max(F.when(r == n - k, c))}
    out = out.withColumns({name: s.over(group) for name, s in sums.items()})
    whole = (n - 1 <= 2) | (n - 1 - 2 * k < 2)
    left_out = F.when(whole, c).when(r <= k, F.col("__lo")).when(r > n - k, F.col("__hi")).otherwise(c)
    s = F.when(whole, F.col("__t")).otherwise(F.col("__a")) - left_out
    s2 = F.when(whole, F.col("__t2")).otherwise(F.col("__a2")) - left_out * left_out
    held = F.when(whole, F.nullif(n - 1, F.lit(0))).otherwise(n - 1 - 2 * k)  # a value alone has no mean of others: null
    spread = F.when(held > 1, F.sqrt(F.greatest((s2 - s * s / held) / (held - 1), F.lit(0.0)))).otherwise(0.0)
    out = out.withColumn("mean", v - c + s / held).withColumn("std", F.greatest(spread, F.lit(STD_LEAST)))
    return out.withColumn("z", F.abs(v - F.col("mean")) / F.col("std")).drop("__r", "__c", "__k", *sums)


def outliers(rows: DataFrame, keys: list[str], order: list[str], line: list[str], value: str = "value") -> DataFrame:
    """The values of z >= Z_LEAST in groups of LEAST_GROUP or more; the first of each line of a group counts."""
    found = leave_one_out(rows, keys, order, value).where((F.col("n") >= LEAST_GROUP) & (F.col("z") >= Z_LEAST))
    first = F.row_number().over(Window.partitionBy(*keys, *line).orderBy(*order))
    return found.withColumn("__first", first).where("__first = 1").drop("__first")


def magnitude_ratios(rows: DataFrame, keys: list[str], order: list[str], least: float = RATIO_LEAST, value: str = "value") -> DataFrame:
    """Values of at least so many times the largest other value of their group, with max_other and ratio."""
    top = Window.partitionBy(*keys).orderBy(F.desc(value), *order)
    out = rows.withColumn("__r", F.row_number().over(top)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    # only the largest can exceed all others; the second is the largest of these
    out = out.withColumn("max_other", F.lead(value).over(top)).where((F.col("__r") == 1) & (F.col("n") >= RATIO_GROUP) & (F.col("max_other") > 0))
    return out.withColumn("ratio", F.col(value) / F.col("max_other")).where(F.col("ratio") >= least).drop("__r")


def rolling(rows: DataFrame, keys: list[str], order: list[str], line: list[str], value: str = "value") -> DataFrame:
    """In groups of more than WINDOW_GROUP: outliers within windows of WINDOW_SIZE values, every WINDOW_STEP; the first hit of a line counts."""
    group = Window.partitionBy(*keys)
    placed = rows.withColumn("__i", F.row_number().over(group.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(group)).where(F.col("__n") > WINDOW_GROUP)
    slot = F.floor(F.col("__i") / WINDOW_STEP)
    span = WINDOW_SIZE // WINDOW_STEP
    windows = placed.withColumn("win", F.explode(F.sequence(F.greatest(slot - span + 1, F.lit(0)), slot))).where(F.col("win") * WINDOW_STEP <= F.col("__n") - WINDOW_SIZE)
    scored = leave_one_out(windows, [*keys, "win"], order, value).where(F.col("z") >= WINDOW_Z)
    first = F.row_number().over(Window.partitionBy(*keys, *line).orderBy("win", *order))
    return scored.withColumn("__first", first).where("__first = 1").drop("__first", "__i", "__n")


def boosted(found: DataFrame, line: list[str]) -> DataFrame:
    """found with z raised by BOOST where a line has more than one."""
    many = F.count("*").over(Window.partitionBy(*line)) > 1
    return found.withColumn("boosted", many).withColumn("z", F.col("z") + F.when(many, BOOST).otherwise(0))


def layer_score(found: DataFrame, keys: list[str]) -> DataFrame:
    """n_extreme, n_high and score (0 to 100) by key."""
    z = F.bround("z", 2)
    counts = found.groupBy(*keys).agg(F.count_if(z >= EXTREME_Z).alias("n_extreme"), F.count_if((z >= Z_LEAST) & (z < EXTREME_Z)).alias("n_high"))
    score = F.least(F.lit(100), F.least(F.lit(60), 20 * F.col("n_extreme")) + F.least(F.lit(30), 10 * F.col("n_high")))
    return counts.withColumn("score", score.cast("long"))


def running_balance(rows: DataFrame, keys: list[str], order: list[str], tolerance: float = 1.0, high: float = 1000.0) -> DataFrame:
    """Rows whose balance isn't the one before, less withdrawal, plus deposit; with expected, diff, diff_pct and confidence."""
    before = F.lag("balance").over(Window.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn("prev_balance", before).where("prev_balance is not null")
    out = out.withColumn("expected", F.col("prev_balance") - F.coalesce("withdrawal", F.lit(0.0)) + F.coalesce("deposit", F.lit(0.0)))
    out = out.withColumn("diff", F.abs(F.col("expected") - F.col("balance"))).where(F.col("diff") > tolerance)
    return out.withColumn("diff_pct", F.col("diff") / F.greatest("balance", F.lit(1.0)) * 100).withColumn("confidence", F.when(F.col("diff") > high, "HIGH").otherwise("MEDIUM"))
