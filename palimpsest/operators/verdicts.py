"""Scores of layers to verdicts."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, functions as F

#: Weights of metadata, content, numeric, ela, pymupdf by kind of document, and thresholds.
WEIGHTS = {
    "native_text": (0.20, 0.35, 0.20, 0.15, 0.10),
    "scanned": (0.15, 0.05, 0.10, 0.50, 0.20),
    "mixed": (0.20, 0.20, 0.15, 0.30, 0.15),
    "scanned_native": (0.20, 0.10, 0.15, 0.35, 0.20),
}
LAYERS = ("metadata", "content", "numeric", "ela", "pymupdf")
THRESHOLD, SCANNED_THRESHOLD, BAND = 20, 25, 5
CONFIDENCE_BASE, CONFIDENCE_STEP, CONFIDENCE_CAP = 50, 1.8, 99
ESCALATION, ESCALATION_CAP = {"HIGH": 10, "MEDIUM": 5}, 15


def weight(kind: Column, layer: str) -> Column:
    i = LAYERS.index(layer)
    out = F.lit(WEIGHTS["native_text"][i])
    for name, row in WEIGHTS.items():
        out = F.when(kind == name, row[i]).otherwise(out)
    return out


def verdict_of(score: Column, threshold: Column) -> Column:
    return F.when(F.abs(score - threshold) <= BAND, "UNCERTAIN").when(score >= threshold, "MODIFIED").otherwise("ORIGINAL")


def confidence_of(score: Column, threshold: Column) -> Column:
    return F.least(F.lit(CONFIDENCE_CAP), CONFIDENCE_BASE + (F.abs(score - threshold) * CONFIDENCE_STEP).cast("int"))


def combine(scores: DataFrame) -> DataFrame:
    """scores: pdf_type, one column a layer, cleared, was_modified, suspicion. Adds threshold, combined (one decimal), verdict, confidence."""
    kind = F.col("pdf_type")
    combined = sum((F.coalesce(F.col(x), F.lit(0)) * weight(kind, x) for x in LAYERS[1:]), F.coalesce(F.col("metadata"), F.lit(0)) * weight(kind, "metadata"))
    base = F.when(kind == "scanned", SCANNED_THRESHOLD).otherwise(THRESHOLD)
    lowered = F.col("cleared") & F.col("was_modified") & (F.col("suspicion") == "UNKNOWN")
    out = scores.withColumn("threshold", F.when(lowered, F.greatest(F.lit(12), base - 8)).otherwise(base)).withColumn("__score", combined)
    out = out.withColumn("verdict", verdict_of(F.col("__score"), F.col("threshold"))).withColumn("confidence", confidence_of(F.col("__score"), F.col("threshold")))
    return out.withColumn("combined", F.bround("__score", 1)).drop("__score")


def rescored(rows: DataFrame, combined: Column, when: Column) -> DataFrame:
    """rows with a new combined score, and verdict and confidence after it, where when holds."""
    out = rows.withColumn("__new", F.when(when, F.bround(combined, 1)))
    new, threshold = F.col("__new"), F.col("threshold")
    out = out.withColumn("verdict", F.when(new.isNotNull(), verdict_of(new, threshold)).otherwise(F.col("verdict")))
    out = out.withColumn("confidence", F.when(new.isNotNull(), confidence_of(new, threshold)).otherwise(F.col("confidence")))
    return out.withColumn("combined", F.coalesce(new, F.col("combined"))).drop("__new")


def escalate(verdicts: DataFrame, fused: DataFrame, key: str) -> DataFrame:
    """Clean verdicts gain points for regions that several layers agree on."""
    points = F.coalesce(*[F.when(F.col("region_confidence") == k, v) for k, v in ESCALATION.items()], F.lit(0))
    gain = fused.groupBy(key).agg(F.least(F.lit(ESCALATION_CAP), F.sum(points)).alias("__gain"))
    rows = verdicts.join(gain, key, "left")
    return rescored(rows, F.least(F.lit(100.0), F.col("combined") + F.col("__gain")), (F.col("verdict") == "ORIGINAL") & (F.col("__gain") > 0)).drop("__gain")


def timeline(rows: DataFrame, text: str, created_year: Column) -> DataFrame:
    """rows with printed (distinct years 2000 to 2030 of printed dates) and timeline (points for years over one away from the creation year)."""
    body = F.coalesce(F.col(text), F.lit(""))
    # a day, a month's name or its first three letters, a year
    named = F.lit(r"\b[0-9]{1,2}\s+([A-Za-z]+)\s+([0-9]{4})\b")
    spelt = F.arrays_zip(F.regexp_extract_all(body, named, F.lit(1)).alias("m"), F.regexp_extract_all(body, named, F.lit(2)).alias("y"))
    months = F.array(*[F.lit(n.lower()) for n in (*calendar.month_name[1:], *calendar.month_abbr[1:])])
    spelt = F.transform(F.filter(spelt, lambda x: F.array_contains(months, F.lower(x["m"]))), lambda x: x["y"])
    # words of digits, slashes and hyphens: the year comes last, or first
    words = F.split(body, r"[^\p{L}\p{N}_/\-]+")
    last = F.transform(F.filter(words, lambda w: w.rlike("^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}$")), lambda w: F.right(w, F.lit(4)))
    first = F.transform(F.filter(words, lambda w: w.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), lambda w: F.left(w, F.lit(4)))
    years = F.concat(spelt, last, first)
    printed = F.array_sort(F.filter(F.array_distinct(F.transform(years, lambda y: y.cast("int"))), lambda y: (y >= 2000) & (y <= 2030)))
    out = rows.withColumn("printed", printed).withColumn("__year", created_year)
    points = F.aggregate("printed", F.lit(0), lambda s, y: s + F.when(F.col("__year") - y > 1, 35).when(y - F.col("__year") > 1, 10).otherwise(0))
    return out.withColumn("timeline", F.least(F.lit(70), points)).drop("__year")


def authenticity(rows: DataFrame) -> DataFrame:
    """rows: xmp_mismatch, multiple_producers, stripped, delta_seconds, combined, verdict. Adds authenticity and assessment."""
    lost = F.when(F.col("xmp_mismatch"), 25).otherwise(0) + F.when(F.col("multiple_producers"), 15).otherwise(0) + F.when(F.col("stripped"), 30).otherwise(0)
    lost = lost + F.when((F.col("delta_seconds") > 0) & (F.col("delta_seconds") < 60), 10).otherwise(0) + F.when(F.col("combined") > 0, F.least(F.lit(80.0), "combined")).otherwise(0.0)
    score = F.lit(100) - lost
    score = F.when(F.col("verdict") == "MODIFIED", F.least(score, F.lit(30.0))).when(F.col("verdict") == "UNCERTAIN", F.least(score, F.lit(60.0))).otherwise(score)
    out = rows.withColumn("authenticity", F.greatest(score, F.lit(0.0)))
    return out.withColumn("assessment", F.when(F.col("authenticity") >= 80, "high").when(F.col("authenticity") >= 50, "medium").otherwise("low"))


def accuracy(rows: DataFrame, truth: str, verdict: str) -> DataFrame:
    """One row: tp, fn, fp, tn, accuracy, precision, recall; MODIFIED and UNCERTAIN count as found."""
    t, p = F.col(truth), F.col(verdict).isin("MODIFIED", "UNCERTAIN")
    out = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return out.select("tp", "fn", "fp", "tn", share(tp + tn, tp + fn + fp + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def gated(findings: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Findings of documents whose verdict isn't ORIGINAL."""
    return findings.join(verdicts.where("verdict = 'ORIGINAL'").select(key), key, "left_anti")
