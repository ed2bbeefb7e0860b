"""Numbers that must add up: totals of a column, payslips, bank statements."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lines import is_total, label_matches
from .cluster import start_clusters
from .outliers import RATIO_GROUP, RATIO_LEAST, running_balance

#: Labels that make a document a payslip or a bank statement, and a line one of its fields, the first that fits.
PAYSLIP = ("basic salary", "basic", "hra", "gross", "net pay", "net salary", "deductions", "allowance", "earnings", "pf", "tds", "professional tax", "take home")
STATEMENT = ("opening balance", "closing balance", "total deposits", "total withdrawals", "withdrawal", "deposit", "balance")
EARNINGS = ("basic", "hra", "da", "conveyance", "allowance", "bonus", "incentive", "other")
LABELS = (
    ("basic salary", "basic"),
    ("basic", "basic"),
    ("house rent allowance", "hra"),
    ("hra", "hra"),
    ("dearness allowance", "da"),
    ("da", "da"),
    ("conveyance", "conveyance"),
    ("other allowance", "other"),
    ("special allowance", "allowance"),
    ("allowance", "allowance"),
    ("bonus", "bonus"),
    ("incentive", "incentive"),
    ("gross salary", "gross"),
    ("gross pay", "gross"),
    ("gross earnings", "gross"),
    ("total earnings", "gross"),
    ("gross", "gross"),
    ("total deductions", "total_deductions"),
    ("total deduction", "total_deductions"),
    ("net salary payable", "net_pay"),
    ("net amount payable", "net_pay"),
    ("net pay", "net_pay"),
    ("net salary", "net_pay"),
    ("take home", "net_pay"),
    ("opening balance", "opening_balance"),
    ("closing balance", "closing_balance"),
    ("total deposits", "total_deposits"),
    ("total deposit", "total_deposits"),
    ("total withdrawals", "total_withdrawals"),
    ("total withdrawal", "total_withdrawals"),
)
#: Tolerances and points of the checks, per cent.
PAYSLIP_TOLERANCE, BANK_TOLERANCE, HIGH_PERCENT, RECONCILED = 2.0, 0.5, 20.0, 2.0
EARNINGS_POINTS, NET_POINTS, BANK_POINTS, BALANCE_POINTS, BALANCE_MOST, WEIGHT = 40, 50, 60, 30, 90, 0.4
COLUMN_TOLERANCE, BALANCE_SHARE, LEAST_ROWS, MOST_NUMBERS = 40, 0.8, 5, 3
#: Labels of number groups across pages; a number must follow.
GROUP_LABELS = ("balance", "salary", "amount", "total", "marks", "income", "debit", "credit", "arrears", "deduction", r"net\s*pay", "performance", "bonus")


def label_groups(numbers: DataFrame) -> DataFrame:
    """numbers (text, value) once for each label that the line has with a number after it, with label."""
    found = F.array_compact(F.array(*[F.when(F.lower("text").rlike(rf"{label}\s*:?\s*[0-9,.]+"), F.lit(label.replace(r"\s*", "_"))) for label in GROUP_LABELS]))
    return numbers.where("value > 0").withColumn("label", F.explode(found))


def kinds(lines: DataFrame, key: str) -> DataFrame:
    """key, is_payslip, is_statement; labels are looked for in each line."""
    low = F.lower("text")
    any_of = lambda labels: F.bool_or(reduce(or_, [label_matches(low, x) for x in labels]))
    return lines.groupBy(key).agg(any_of(PAYSLIP).alias("is_payslip"), any_of(STATEMENT).alias("is_statement"))


def labelled_values(lines: DataFrame, key: str) -> DataFrame:
    """key, field, page, line, value: lines with a number (value: the last one) by the first of LABELS that fits; of a field's lines the last."""
    low = F.lower("text")
    field = F.coalesce(*[F.when(label_matches(low, label), F.lit(name)) for label, name in LABELS])
    rows = lines.where("value is not null").withColumn("field", field).where("field is not null")
    return rows.groupBy(key, "field").agg(F.max(F.struct("page", "line", "value")).alias("x")).select(key, "field", "x.*")


def arithmetic_checks(lines: DataFrame, key: str) -> DataFrame:
    """key, check, page, line, expected, stated, diff_pct, confidence, points of the sums that don't hold; lines: page, line, text, value (the line's last number or null)."""
    fields = sorted({name for _, name in LABELS})
    one = lambda name, part: F.max(F.when(F.col("field") == name, F.col(part)))
    wide = labelled_values(lines, key).groupBy(key).agg(*[one(n, "value").alias(n) for n in fields], *[F.max(F.when(F.col("field") == n, F.struct("page", "line"))).alias(f"at_{n}") for n in ("gross", "net_pay", "closing_balance")])
    rows = wide.join(kinds(lines, key), key)
    earned = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in EARNINGS), F.lit(0.0))

    def check(name: str, when: Column, expected: Column, stated: str, points: int, tolerance: float) -> Column:
        off = F.abs(expected - F.col(stated)) / F.greatest(F.col(stated), F.lit(1.0)) * 100
        found = F.struct(F.lit(name).alias("check"), F.col(f"at_{stated}").alias("at"), F.round(expected, 2).alias("expected"), F.col(stated).alias("stated"), F.round(off, 2).alias("diff_pct"), F.when(off > HIGH_PERCENT, "HIGH").otherwise("MEDIUM").alias("confidence"), F.lit(points).alias("points"))
        return F.when(F.coalesce(when & (off > tolerance), F.lit(False)), found)

    checks = F.array(
        check("earnings_sum", F.col("is_payslip") & (earned > 0), earned, "gross", EARNINGS_POINTS, PAYSLIP_TOLERANCE),
        check("net_pay_equation", F.col("is_payslip"), F.col("gross") - F.col("total_deductions"), "net_pay", NET_POINTS, PAYSLIP_TOLERANCE),
        check("bank_balance", F.col("is_statement"), F.col("opening_balance") + F.col("total_deposits") - F.col("total_withdrawals"), "closing_balance", BANK_POINTS, BANK_TOLERANCE),
    )
    return rows.select(key, F.explode(F.array_compact(checks)).alias("c")).select(key, "c.check", "c.at.page", "c.at.line", "c.expected", "c.stated", "c.diff_pct", "c.confidence", "c.points")


def reconciled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (text, value) with reconciles: a total that is, within RECONCILED per cent, the sum of the two or more others of its group that are no totals."""
    group = Window.partitionBy(*keys)
    total = is_total(F.col("text"))
    plain = F.when(~total, F.col("value"))
    out = rows.withColumn("__sum", F.sum(plain).over(group)).withColumn("__n", F.count(plain).over(group))  # a total is none of them, so nothing is to be taken off
    off = F.abs(F.col("__sum") - F.col("value")) / F.greatest(F.abs("value"), F.lit(1.0)) * 100
    return out.withColumn("reconciles", F.coalesce(total & (F.col("__n") >= 2) & (off <= RECONCILED), F.lit(False))).drop("__sum", "__n")


def ratio_outliers(rows: DataFrame, keys: list[str], order: list[str], found: DataFrame, line: list[str], least: float = RATIO_LEAST) -> DataFrame:
    """Values of at least so many times the largest other value of their group, on lines that found (outliers of the same groups) does not have; with max_other and ratio."""
    top = Window.partitionBy(*keys).orderBy(F.desc("value"), *order)
    out = rows.withColumn("__r", F.row_number().over(top)).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).withColumn("max_other", F.lead("value").over(top))
    out = out.where((F.col("__r") == 1) & (F.col("n") >= RATIO_GROUP) & (F.col("max_other") > 0)).withColumn("ratio", F.col("value") / F.col("max_other")).where(F.col("ratio") >= least).drop("__r")
    return out.join(found.select(*keys, *line).distinct(), [*keys, *line], "left_anti")


def transactions(entries: DataFrame, key: str) -> DataFrame:
    """key, page, line, withdrawal, deposit, balance of the rows of a bank statement; entries: page, line, ord, x, value of every number above 0.

    Rows have one to MOST_NUMBERS numbers. Columns are clusters by x over all of a document's rows; the balance is the rightmost column that BALANCE_SHARE of the rows have, deposit and withdrawal are the next ones to its left. Without all three
    a document has no rows, nor with fewer than LEAST_ROWS. Of several numbers of a row in a column the last by x counts.
    """
    row = [key, "page", "line"]
    few = entries.withColumn("__n", F.count("*").over(Window.partitionBy(*row))).where(F.col("__n") <= MOST_NUMBERS).drop("__n")
    few = few.withColumn("__at", F.struct("page", "line", "ord"))
    placed = start_clusters(few, [key], "x", "__at", COLUMN_TOLERANCE).select(key, F.col("__at.page").alias("page"), F.col("__at.line").alias("line"), F.col("__at.ord").alias("ord"), "x", "cluster").join(few.select(*row, "ord", "value"), [*row, "ord"])
    n_rows = placed.groupBy(key).agg(F.countDistinct("page", "line").alias("n_rows"))
    columns = placed.groupBy(key, "cluster").agg(F.avg("x").alias("x_mean"), F.countDistinct("page", "line").alias("held")).join(n_rows, key).where(F.col("n_rows") >= LEAST_ROWS)
    balance = columns.where(F.col("held") / F.col("n_rows") >= BALANCE_SHARE).groupBy(key).agg(F.max(F.struct("x_mean", "cluster")).alias("b"))
    left = columns.join(balance, key).where(F.col("x_mean") < F.col("b.x_mean"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("x_mean")))
    sides = left.withColumn("__r", rank).groupBy(key).agg(F.max(F.when(F.col("__r") == 1, F.col("cluster"))).alias("d"), F.max(F.when(F.col("__r") == 2, F.col("cluster"))).alias("w"))
    roles = balance.select(key, F.col("b.cluster").alias("b")).join(sides.where("d is not null and w is not null"), key)
    last = lambda c: F.max_by(F.when(F.col("cluster") == F.col(c), F.col("value")), F.when(F.col("cluster") == F.col(c), F.struct("x", "ord")))
    out = placed.join(roles, key).groupBy(*row).agg(last("w").alias("withdrawal"), last("d").alias("deposit"), last("b").alias("balance"))
    return out.where("balance > 0 and (withdrawal is not null or deposit is not null)")


def statement_balances(entries: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Rows of bank statements whose balance does not follow from the one before; see running_balance()."""
    banks = kinds(lines, key).where("is_statement").select(key)
    return running_balance(transactions(entries, key).join(banks, key, "left_semi"), [key], ["page", "line"])


def numeric_score(n_extreme: Column, n_high: Column, arithmetic: Column, n_balances: Column) -> Column:
    """0 to 100: outliers, then arithmetic checks and balances, weighted."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.least(F.lit(100), F.least(F.lit(60), 20 * zero(n_extreme)) + F.least(F.lit(30), 10 * zero(n_high)))
    base = F.least(F.lit(100), base + F.bround(F.least(F.lit(100), zero(arithmetic)) * WEIGHT, 0))
    return F.least(F.lit(100), base + F.bround(F.least(F.lit(BALANCE_MOST), BALANCE_POINTS * zero(n_balances)) * WEIGHT, 0)).cast("long")
